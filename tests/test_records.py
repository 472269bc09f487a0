"""Whole reports, drafts, frozen runs, remembered calls and sources that live elsewhere."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import calls, drafts, frozen, manifest, reports
from sievework.plans import queries
from sievework.sources import files


def shadow(k, **other):
    rng = random.Random(k)
    text = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(24))
    return {"id": f"r{k}", "author": "gpt", "channel": "tool_description", "family": "shadowing", "technique": f"t_{k % 7}", "clause_position": "end", "host_tool": "a", "target_tool": "b", "text": text} | other


def lines_of(spark, rows):
    return spark.createDataFrame([(k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(rows, 1)], "line_no long, line string")


def test_check_shadowing(spark):
    good = [shadow(k) for k in range(35)]
    out = reports.check_shadowing(lines_of(spark, good + [shadow(99, technique="TEMPLATE", text="x")])).collect()
    assert not [r for r in out if r.severity in ("error", "warning")] and [(r.rule, r.value) for r in out if r.severity == "note"] == [("templates_ignored", 1)]
    assert {(r.subject, r.value) for r in out if r.rule == "author"} == {("human", 0), ("gpt", 35)}
    bad = [shadow(0, author=5), "{", "[1]", shadow(1, extra="x"), shadow(2, technique="Not Snake"), shadow(3), shadow(3, text="other"), shadow(4, text=good[3]["text"] + "."), {k: v for k, v in shadow(5).items() if k != "text"}]
    got = errors_set(reports.check_shadowing(lines_of(spark, bad)))
    assert got == {("wrong_type", 1, "author"), ("invalid_json", 2, ""), ("no_object", 3, ""), ("unknown_field", 4, "extra"), ("rule", 5, "technique must be lowercase snake_case"), ("duplicate_id", 7, "r3"), ("near_duplicate", None, "r3"), ("missing_field", 9, "text"), ("size", None, None)}
    few = reports.check_shadowing(lines_of(spark, [shadow(k, technique="one") for k in range(36)]))
    assert {r.rule for r in few.where("severity = 'warning'").collect()} == {"few_techniques", "technique_share"}
    assert errors_set(reports.check_shadowing(lines_of(spark, []))) == {("size", None, None)}


def errors_set(df):
    return {(r.rule, r.line_no, r.subject) for r in df.where("severity = 'error'").collect()}


def quote(k, slice_name, **other):
    row = shadow(k)
    return {"id": f"{slice_name}-{k}", "author": "human", "slice": slice_name, "source_type": reports.validate.SOURCE_TYPES[k % 10], "form": reports.validate.FORMS[k % 2], "channel": "other", "reviewed": True, "text": row["text"]} | other


def test_check_slice(spark):
    frozen_rows = [quote(100, "frozen")]
    attacks = spark.createDataFrame([("a1", "Quite another attack of thirty letters and more", 1)], "id string, text string, place int")
    dev = [quote(k, "dev") for k in range(40)]
    assert errors_set(reports.check_slice("dev", lines_of(spark, dev), lines_of(spark, frozen_rows), attacks)) == set()
    bad = dev[:38] + [quote(38, "dev", text="so QUITE  another attack of thirty letters it was"), quote(39, "dev", text=frozen_rows[0]["text"]), quote(1, "frozen"), quote(2, "dev", reviewed="yes"), quote(3, "dev", id="TEMPLATE-1")]
    out = reports.check_slice("dev", lines_of(spark, bad), lines_of(spark, frozen_rows), attacks)
    assert errors_set(out) == {("overlap", None, "dev-38"), ("exact_duplicate_across", None, "dev-39"), ("other_slice", 41, "frozen-1"), ("wrong_type", 42, "reviewed")}
    out = reports.check_slice("frozen", lines_of(spark, [quote(1, "frozen", reviewed=False)]), lines_of(spark, []), attacks)
    assert errors_set(out) == {("size", None, None), ("not_reviewed", 1, "frozen-1")}


def test_report_of_a_slice_has_a_small_plan(spark):
    attacks = spark.createDataFrame([("a1", "Quite another attack of thirty letters and more", 1)], "id string, text string, place int")
    rows = [quote(k, "dev", source_type="docs", form="discussion", author="nemotron-super") for k in range(6)]
    out = reports.check_slice("dev", lines_of(spark, [*rows, quote(6, "frozen", id="dev-0", text=rows[0]["text"])]), lines_of(spark, [quote(6, "frozen", id="dev-0", text=rows[0]["text"])]), attacks)
    plan = out._jdf.queryExecution().optimizedPlan().toString()  # the driver holds it, and as text with each change of it
    assert plan.count("Relation [") <= 8 and "Join" not in plan and "Aggregate" not in plan
    assert {(r.rule, r.subject, r.value) for r in out.collect() if r.severity == "warning"} == {("source_share", "docs", 6), ("verbatim_share", None, 0), ("human_share", None, 0)}
    assert {tuple(r)[1:5] for r in out.where("severity = 'error'").collect()} == {("size", None, None, None), ("other_slice", 7, "dev-0", "frozen"), ("exact_duplicate_across", None, "dev-0", "dev-0")}
    nothing = {(r.rule, r.subject, r.value) for r in reports.check_slice("dev", lines_of(spark, []), lines_of(spark, []), attacks).collect()}
    assert ("size", None, 0) in nothing and ("author", "human", 0) in nothing and len(nothing) == 20


def test_check_slice_reads_repeated_rows(spark, tmp_path):
    rows = [quote(k, "dev") for k in range(42)]
    kinds = "id string, slice string, author string, source_type string, form string, channel string, reviewed boolean, text string"
    write = lambda name, found: spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in found], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}.parquet")
    write("quoting_dev", [*rows, rows[3], rows[5] | {"text": "quite another text"}, rows[3]])
    write("quoting_frozen", [quote(100, "frozen"), quote(101, "frozen"), quote(101, "frozen")])
    spark.createDataFrame([("a", "shadowing", "an attack that nobody quotes at all")], "id string, family string, text string").write.parquet(f"{tmp_path}/item.parquet")
    out = queries.check_slice(spark, str(tmp_path)).collect()
    assert {(r.rule, r.line_no, r.subject, r.other) for r in out if r.severity == "error"} == {("duplicate_id", k, f"dev-{n}", str(n + 1)) for k, n in ((43, 3), (44, 5), (45, 3))}
    assert {(r.subject, r.value) for r in out if r.rule == "author"} == {("human", 42), ("nemotron-super", 0)}
    write("quoting_dev", [rows[0], rows[1]])  # a second file
    lines = queries._file_lines(spark, str(tmp_path), "quoting_dev").collect()
    assert sorted(r.line_no for r in lines) == list(range(1, 48))
    assert sum(r.severity == "error" and r.rule == "duplicate_id" for r in queries.check_slice(spark, str(tmp_path)).collect()) == 5


def scored_rows(spark, errors=0, benign=200):
    rows = [(f"{f}/{k}", f, "tool_result", "attack", "gpt", "attack") for f in manifest.HELD_OUT for k in range(25)]
    rows += [(f"q{k}", "quoting", "other", "benign", "human", "error" if k < errors else "benign") for k in range(benign)]
    return spark.createDataFrame(rows, "id string, family string, channel string, label string, author string, verdict string")


def test_frozen_run(spark, tmp_path):
    r = frozen.evaluate(scored_rows(spark)).first()
    assert r.valid and r.passed and len(r.families) == 4
    r = frozen.evaluate(scored_rows(spark, errors=7)).first()
    assert not r.valid and r.passed is None and r.fp_flagged == 7
    with pytest.raises(Exception, match="200 benign"):
        frozen.evaluate(scored_rows(spark, benign=199)).collect()
    with pytest.raises(Exception, match="held-out families"):
        frozen.evaluate(scored_rows(spark).where("family <> 'shadowing'")).collect()
    (tmp_path / "p.txt").write_bytes(b"be\r\nstrict\r\n")
    text, sha = files.prompt(str(tmp_path / "p.txt"))
    assert text == "be\nstrict\n"
    toml = f'[classifier]\nprompt_path = "p.txt"\nprompt_sha256 = "{sha}"\nmodel = "m"\nendpoint = "e"\nmax_tokens = 256\ntemperature = 0\n[classifier.extra_body]\nx = 1\n[measurement]\nverdict_rule = "attack"\nerror_scoring = "pessimistic"\nnormalizer_version = 1\n'
    (tmp_path / "p.toml").write_text(toml)
    values, wrong = files.protocol(str(tmp_path / "p.toml"))
    settings = {"endpoint": "e", "model": "m", "extra_body": {"x": 1}}
    assert wrong == [] and frozen.protocol_problems(values, sha, settings) == [] and values["prompt_path"] == str(tmp_path / "p.txt")
    assert [p[0] for p in frozen.protocol_problems(values, "0", settings | {"model": "n"})] == ["prompt_sha256", "model"]
    (tmp_path / "q.toml").write_text(toml.replace("temperature = 0", "temperature = true").replace('model = "m"\n', ""))
    assert files.protocol(str(tmp_path / "q.toml"))[1] == ["classifier.model", "classifier.temperature"] and files.protocol(str(tmp_path / "q.toml"), False)[1] == []
    ledger = spark.createDataFrame([("start",), ("finish",)], "event string")
    assert frozen.earlier_starts(ledger) == 1 and frozen.earlier_starts(ledger, True) == 0
    assert frozen.refusals([], True, 0) == [] and frozen.refusals([1], False, 1, False) == ["protocol", "uncommitted changes", "1 earlier runs", "order of commits"]
    history = spark.createDataFrame([("d", "b"), ("d", "c"), ("c", "a"), ("b", "a"), ("a", None)], "id string, parent string")
    assert {r.id for r in frozen.strict_ancestors(history, "d").collect()} == {"a", "b", "c"} and frozen.strict_ancestors(history, "a").count() == 0


def test_drafts(spark):
    texts = [shadow(k)["text"] for k in range(4)]
    old = spark.createDataFrame([("o", texts[0])], "id string, text string")
    new = spark.createDataFrame([("z", texts[1], 1), ("a", texts[1] + ".", 2), ("b", texts[0] + "!", 3), ("c", texts[2], 4)], "id string, text string, place long")
    assert {(r.id, r.kept, r.of) for r in drafts.new_drafts(new, old, "place").collect()} == {("z", True, None), ("a", False, "new/z"), ("b", False, "old/o"), ("c", True, None)}
    ledger = spark.createDataFrame([("blog",)] * 39 + [("docs",)] * 3, "source_type string")
    wanted = spark.createDataFrame([("blog", 2), ("docs", 5), ("new", 1)], "source_type string, n long")
    assert [tuple(r) for r in drafts.over_caps(ledger, wanted).collect()] == [("blog", 39, 2, 40)]
    assert [r.source_type for r in drafts.over_caps(ledger, wanted, 100, 45).collect()] == [None]
    pending = spark.createDataFrame([(f"p{k}", "dev") for k in range(5)], "id string, slice string")
    have = spark.createDataFrame([("dev", 58)], "slice string, n long")
    batch = spark.createDataFrame([("p0", "accept", None), ("p0", "accept", None), ("p1", "reject", "because"), ("x", "accept", None), ("p2", "reject", "malformed"), ("p3", "accept", None)], "id string, decision string, reason string")
    assert {tuple(r) for r in drafts.batch_problems(batch, pending, have, ("malformed",)).collect()} == {("listed twice", "p0"), ("no decision", "p1"), ("not pending", "x"), ("over its limit", "dev")}
    source = spark.createDataFrame([("a", "h", None, "c"), ("b", "h", "", "c"), ("c", "h", "f", "c")], "id string, host_description string, fenced_block string, clause string")
    committed = spark.createDataFrame([("a", "h c"), ("c", "h f c")], "id string, text string")
    assert {tuple(r) for r in drafts.composed_problems(source, committed).collect()} == {("b", "missing"), ("c", "differs")}


def test_calls(spark):
    rows = spark.createDataFrame([("k1", "good", 1), ("k1", "good", 2), ("k2", "bad", 3), ("k3", "old", 4), ("k4", "raise", 5), ("k5", "late", 6)], "key string, text string, place int")
    cache = spark.createDataFrame([("k3", "benign", None, None)], "key string, verdict string, family string, span string")

    def chat(text):
        if text == "raise":
            raise OSError("down")
        return ('{"verdict": "benign", "family": null, "span": null}' if text != "bad" else "no", "stop")

    out, lines = calls.ask_with_cache(rows, cache, chat, 6)
    assert {(r.key, r.verdict, r.error, r.attempts, r.cached) for r in out.collect()} == {("k1", "benign", None, 1, False), ("k2", "error", "reply is not JSON", 2, False), ("k3", "benign", None, 0, True), ("k4", "error", "OSError: down", 1, False), ("k5", "error", "budget exhausted", 0, False)}
    assert out.count() == 6 and [r.key for r in lines.collect()] == ["k1"]
    seen = []
    fail = iter([ValueError(), ValueError(), "done"])

    def call():
        x = next(fail)
        if isinstance(x, Exception):
            raise x
        return x

    assert calls.with_retries(call, sleep=seen.append, wait_of=lambda e: 3.0 if not seen else None) == "done" and seen[0] == 3.0 and 1 <= seen[1] <= 2
    probe = calls.probe_endpoints([("a", "chat"), ("b", "embed"), ("c", "chat")], lambda m, j: (_ for _ in ()).throw(OSError()) if m == "c" else "{}", lambda m: [[0.0] * 4])
    assert [(r["ok"], r["json_mode_ok"], r["embed_dim"]) for r in probe] == [(True, True, None), (True, None, 4), (False, None, None)]
    runs = spark.createDataFrame([("r", k, k % 50 == 0 or 70 <= k < 73) for k in range(300)] + [("s", k, False) for k in range(3)], "run string, k int, bad boolean")
    got = calls.circuit_break(runs, "run", [F.col("k")], F.col("bad")).groupBy("run").agg(F.min(F.when(F.col("stopped"), F.col("k"))).alias("k"), F.count(F.lit(1)).alias("n"))
    assert {tuple(r) for r in got.collect()} == {("r", 73, 300), ("s", None, 3)}
    budget = calls.within_budget(runs, "run", [F.col("k")], ~F.col("bad"), 100).where("blocked")
    assert budget.agg(F.min("calls_before")).first()[0] == 100 and budget.count() == 300 - 9 - 100


def test_quota_sample(spark):
    rows = spark.createDataFrame([(f"{g}{k}", g) for g, n in (("a", 90), ("b", 2), ("c", 40)) for k in range(n)], "id string, g string")
    assert {tuple(r) for r in calls.quota_sample(rows, 11, "g", "s").groupBy("g").count().collect()} == {("a", 4), ("b", 2), ("c", 3)}
    assert calls.quota_sample(rows, 0, "g", "s").count() == 0 and calls.quota_sample(rows.limit(0), 5, "g", "s").count() == 0
    with pytest.raises(Exception, match="held-out"):
        calls.quota_sample(rows, 5, "g", "s", forbidden=F.col("g") == "b").collect()


def test_sources_by_uri(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "e.json").write_text('{"id": "x"}\n')
    for at in (str(tmp_path), tmp_path.as_uri()):
        assert files.event_dirs(spark, [f"{at}/run", f"{at}/none"], "id string").count() == 1
        assert files.strict_lines(spark, f"{at}/none.jsonl", "id string").count() == 0 and files.text_or_empty(spark, f"{at}/none.txt") == ""
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(files.LoadError, match="not valid JSON"):
        files.template_collection(spark, (tmp_path / "bad.json").as_uri())
    with pytest.raises(files.LoadError, match="not found"):
        files.template_collection(spark, (tmp_path / "none.json").as_uri())
    text = "\n".join(json.dumps({"n": k}) if k % 10 else "\t " for k in range(1, 5001))
    (tmp_path / "l.jsonl").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = files.json_lines(spark, str(tmp_path / "l.jsonl")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 4500 and all(json.loads(r.line)["n"] == r.line_no for r in got)
    blobs = {"a": b"hello\n", "b": b"other"}
    pins = [("a", "a", "ce013625030ba8dba906f756967f9e9ca394464a"), ("b", "b", "0"), ("c", "c", "0")]
    assert files.fetch_verified(pins, str(tmp_path / "raw"), lambda p: blobs[p]) == ["b: another blob id", "c: KeyError"] and not (tmp_path / "raw" / "b").exists()
    own = "\n".join(json.dumps(shadow(k, technique="TEMPLATE" if k == 0 else f"t_{k % 7}")) for k in range(37))
    (tmp_path / "own.jsonl").write_text(own)
    assert files.own_collection(spark, str(tmp_path / "own.jsonl")).count() == 36
    (tmp_path / "own.jsonl").write_text(own + "\n{}")
    with pytest.raises(files.LoadError, match="line 38"):
        files.own_collection(spark, str(tmp_path / "own.jsonl")).count()


def test_text_functions(spark):
    rows = [(t,) for t in ("", "  A  b\tC ", "Straße ﬁn", "ẞİ", "\x1c\x85x\x1f", None, "plain", "a" * 5000 + " 　 " + "É" * 300)]
    for t, c, n in spark.createDataFrame(rows, "t string").select("t", X.collapse(F.col("t")), X.normalize(F.col("t"))).collect():
        assert (c, n) == ((None, None) if t is None else (X.collapsed(t), X.normalized(t)))
    every = "".join(chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    assert spark.createDataFrame([(every,)], "t string").select(X.collapse(F.col("t"))).first()[0] == X.collapsed(every)
