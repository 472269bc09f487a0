import json
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import codes as C
from sievework.functions import replies, stats
from sievework.functions import text as X
from sievework.operators import pieces as G


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("v"))).collect()]


ODD = ["", " ", "a  b\tc\n", "Straße ﬁne", "Ａb　c", "x​y", "a\U000e0068\U000e0069b", "\x1c é \x85", "⚙️", "𝖺bcdef𝖺", "abc", "İx", "\n", "a\n"]


def test_normalize_and_collapse(spark):
    def plain(t):
        t = "".join(f"<U+{ord(c):04X}>" if 0xE0000 <= ord(c) <= 0xE007F else c for c in t)
        return "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf" and not 0xFE00 <= ord(c) <= 0xFE0F)

    assert column(spark, [*ODD, None], X.normalize) == [*map(plain, ODD), None]
    assert column(spark, [*ODD, None], X.collapse) == [*(" ".join(t.split()).casefold() for t in ODD), None]


def test_grams_and_jaccard(spark):
    keys = [" ".join(t.split()).casefold() for t in ODD] + ["abababab"]
    want = [{t[i : i + 5] for i in range(len(t) - 4)} or ({t} if t else set()) for t in keys]
    got = column(spark, keys, X.grams)
    assert [set(g) for g in got] == want and all(len(g) == len(set(g)) for g in got)
    rows = spark.createDataFrame([("abcdef", "abcdeg"), ("", ""), ("abc", "abd"), ("abc", "abc")], "a string, b string")
    assert [r[0] for r in rows.select(X.jaccard(X.grams(F.col("a")), X.grams(F.col("b")))).collect()] == [1 / 3, 1.0, 0.0, 1.0]


def test_hashes_and_text(spark):
    assert column(spark, ["hello\n"], X.blob_id) == ["ce013625030ba8dba906f756967f9e9ca394464a"]
    assert column(spark, ["w " * 25, "w " * 26, "w " * 45, "w " * 46, ""], X.length_bucket) == ["short", "medium", "medium", "long", "short"]
    assert column(spark, ["a </ Untrusted_TEXT > b", "< untrusted_text>"], X.fenced) == ["<untrusted_text>\na [fence tag removed] b\n</untrusted_text>", "<untrusted_text>\n[fence tag removed]\n</untrusted_text>"]
    assert column(spark, ["a_b1", "A", "a_", "a\n", ""], X.is_snake_case) == [True, False, False, False, False]
    rows = spark.createDataFrame([("h", None, "c"), ("h", "", "c"), ("h", "f", "c")], "h string, f string, c string")
    assert [r[0] for r in rows.select(X.compose(F.col("h"), F.col("f"), F.col("c"))).collect()] == ["h c", "h c", "h\n\nf\n\nc"]


def test_wilson(spark):
    df = spark.createDataFrame([(6, 200), (7, 200), (12, 300), (13, 300), (0, 200), (200, 200)], "k int, n int")
    got = [round(r[0], 4) for r in df.select(stats.wilson_upper(F.col("k"), F.col("n"))).collect()]
    assert got == [0.0639, 0.0705, 0.0686, 0.0727, 0.0188, 1.0]
    with pytest.raises(Exception, match="0 <= k <= n"):
        spark.createDataFrame([(11, 10)], "k int, n int").select(stats.wilson_upper(F.col("k"), F.col("n"))).collect()
    label = spark.createDataFrame([(7, 50), (0, 0)], "k int, n int").select(stats.interval_label(F.col("k"), F.col("n"))).collect()
    assert [r[0] for r in label] == ["7/50 (7-26%)", "n/a"]
    assert [spark.createDataFrame([(k, 200)], "k int, n int").select(stats.wilson_upper(F.col("k"), F.col("n")) <= 0.07).first()[0] for k in (6, 7)] == [True, False]


GOOD = '{"verdict": "attack", "family": "f", "span": "s"}'


@pytest.mark.parametrize(
    "content, finish, want",
    [
        (GOOD, "stop", "attack"), (GOOD, "", "attack"), (GOOD, "length", "error"), ('{"verdict": "benign", "family": null, "span": null}', "stop", "benign"), ("", "stop", "error"), ("{", "stop", "error"),
        ('{"verdict": "attack", "family": 5, "span": "s"}', "stop", "error"), ('{"verdict": "attack", "family": " ", "span": "s"}', "stop", "error"), ('{"verdict": "benign", "family": "", "span": null}', "stop", "error"),
        ("[]", "stop", "error"), ('{"verdict": "x", "family": null, "span": null}', "stop", "error"), ('{"verdict": "benign", "verdict": "attack", "family": "f", "span": "s"}', "stop", "attack"), (None, "stop", "error"), ("[" * 5000, "stop", "error"),
    ],
)
def test_verdicts(content, finish, want):
    assert replies.check_verdict(content, finish)[0] == want


def test_spans_and_drafts(spark):
    span = {"text": "t", "voice": "author_directive", "addressee": "agent", "sensitive_action": True}
    reply = lambda *spans, unsure=False: json.dumps({"spans": list(spans), "unsure": unsure})
    cases = [(reply(span), "attack"), (reply(span, unsure=True), "attack"), (reply(unsure=True), "unsure"), (reply(), "benign"), (reply(span | {"voice": "quoted"}), "benign"), (reply(span | {"voice": ["quoted"]}), "unsure"), (reply(span | {"extra": 1}), "unsure"), (reply(span | {"sensitive_action": 1}), "unsure"), ("{}", "unsure"), ("null", "unsure"), (None, "unsure")]
    assert column(spark, [c for c, _ in cases], replies.span_verdict) == [w for _, w in cases]
    assert replies.check_draft(json.dumps({"text": " " + "x" * 80 + " "}))[0] == "x" * 80
    assert replies.check_draft(json.dumps({"text": "x" * 79}))[0] is None and replies.check_draft('{"text": 5}')[1]
    got = spark.createDataFrame([(GOOD, "stop")], "c string, f string").select(replies.parse_verdict("c", "f").alias("p")).select("p.*").first()
    assert tuple(got) == ("attack", "f", "s", None)


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_normalizer_is_idempotent(text):
    assert X.normalized(X.normalized(text)) == X.normalized(text)


def test_normalizer_takes_only_what_is_not_ascii(monkeypatch):
    seen, whole = [], unicodedata.normalize
    monkeypatch.setattr(X.unicodedata, "normalize", lambda form, t: seen.append(len(t)) or whole(form, t))
    text = "plain " * 500 + "cafe\u0301 \ufb01n\u200b \U000e0068" + " plain" * 500
    assert X.normalized(text) == "plain " * 500 + "caf\u00e9 fin <U+E0068>" + " plain" * 500
    assert sum(seen) < 50


def test_ascii_is_collapsed_as_other_texts_are():
    rng = random.Random(2)
    texts = ["".join(rng.choices("aB \t\n\x1f\x0b-" + "\u00e9\u00df\u00a0\u3000" * (k % 2), k=k % 23)) for k in range(500)]
    assert C.collapsed_ascii(pa.array(texts[::2])).to_pylist() == [X.collapsed(t) for t in texts[::2]]
    assert X._collapse.func(pa.array([*texts, None])).to_pylist() == [*map(X.collapsed, texts), None]


def test_pieces_of_equal_characters_have_equal_hashes():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab\u00e9\U0001d400", k=rng.choice([0, 1, 3, 4, 5, 6, 40]))) for _ in range(600)]
    hashed, start = G.packed(C.decode(pa.array(texts)))
    size, row = G.positions(C.decode(pa.array(texts)))[1:]
    assert (G.rows_of(hashed) == row).all()
    flat = "".join(texts)
    pairs = {(flat[s : s + n], h) for s, n, h in zip(start.tolist(), size.tolist(), (hashed & np.uint64((1 << 52) - 1)).tolist())}
    assert len(pairs) == len({p for p, _ in pairs}) == len({h for _, h in pairs})
