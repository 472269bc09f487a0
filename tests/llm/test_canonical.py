import random

import pytest

from sievework.llm.canonical import Canon, Strings, canonical, words_of

NAMES = ["reply_rerouting", "argument_swapping", "scope_widening", "scope_narrowing", "maintenance_pretext", "deprecation_pretext", "table_smuggling", "comment_smuggling", "quota_scare", "version_pinning_claim"]


def labels(spark):
    return spark.createDataFrame([(n, n.replace("_", " ").capitalize()) for n in NAMES], "label string, title string")


CASES = {
    "Reply rerouting": "reply_rerouting", "REROUTING, reply": "reply_rerouting", "reply of rerouting": "reply_rerouting", "Replyrerouting": "reply_rerouting", "repl rerouti": "reply_rerouting",
    "Type=reply / rerouting": "reply_rerouting", "repl yrerouting": "reply_rerouting", "ѕсоре_widening (v2)": "scope_widening", "scope narowing": "scope_narrowing", "Commentsmuggling": "comment_smuggling",
    "see the table smuggling row, please": "table_smuggling", "Claim, Pinning, Version": "version_pinning_claim", "quot scar": "quota_scare", "depercation pretxt": "deprecation_pretext",
    "misc": "unmatched", "-": "unmatched", "": "unmatched", "   ": "unmatched", "table": "unmatched", "claim_circular": "unmatched", "quote_chart": "unmatched", "only a spelling slip in the greeting": "unmatched",
    "reply rerouting and scope widening": "reply_rerouting", "x" * 20000: "unmatched",
}


def test_cases(spark):
    rows = [(k, v) for k, v in enumerate([*CASES, None, "misc"])]
    df = spark.createDataFrame(rows, "label int, technique string")
    want = [(k, CASES.get(v) if v is not None else None) for k, v in rows]
    for block in (20_000, 3):
        got = canonical(df, "technique", labels(spark), out="found", block=block).orderBy("label")
        assert [(r.label, r.found) for r in got.collect()] == want and got.columns == ["label", "technique", "found"]
    assert canonical(df, "technique", labels(spark), out="technique").columns == ["label", "technique"]
    assert canonical(df, "technique", labels(spark).limit(0), out="f").where("f <> 'unmatched'").count() == 0
    assert canonical(df.limit(0), "technique", labels(spark)).count() == 0


@pytest.mark.parametrize("noise", [1, 2])
def test_slips_keep_their_label(noise):
    rng = random.Random(noise)
    canon = Canon([(n, n.replace("_", " ")) for n in NAMES])
    right = 0
    for _ in range(300):
        label = rng.choice(NAMES)
        t = list(label.replace("_", " "))
        for _ in range(noise):
            k = rng.randrange(len(t) - 1)
            match rng.randrange(4):
                case 0:
                    t[k], t[k + 1] = t[k + 1], t[k]
                case 1:
                    del t[k]
                case 2:
                    t.insert(k, t[k])
                case 3:
                    t[k] = rng.choice("abcdefgh")
        words = words_of("".join(t))
        right += (canon.mention(words)[0] or canon.similar(words)[0]) == label
    assert right >= 297


def edits(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours, one cell after the other."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_likeness_of_all_at_once():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdé1", k=rng.randint(1, 9))) for _ in range(200)]
    held = Strings(texts)
    for least in (0.5, 0.68):
        for t in [*texts[:25], "z", "a" * 40]:
            want = [1 - edits(t, u) / max(len(t), len(u)) for u in texts]
            assert held.likeness(t, least) == pytest.approx([w if w >= least - 1e-9 else 0.0 for w in want])
    assert list(Strings([]).likeness("a", 0.5)) == []


def test_decoration_is_learned(spark):
    """A word beside mentions of three labels is decoration wherever it stands, one that stands with one label isn't."""
    rows = [(n.replace("_", " ") + " zzdeco zzdeco2",) for n in NAMES[:3]] + [("quot scar zzdeco zzdeco2 zzdeco zzdeco2",), ("quot scar zzother zzother zzother zzother",)]
    got = canonical(spark.createDataFrame(rows, "technique string"), "technique", labels(spark), out="found")
    assert [r.found for r in got.orderBy("technique").collect()] == sorted_labels(rows)


def sorted_labels(rows):
    want = {rows[0][0]: NAMES[0], rows[1][0]: NAMES[1], rows[2][0]: NAMES[2], rows[3][0]: "quota_scare", rows[4][0]: "unmatched"}
    return [want[v] for v in sorted(want)]


def test_the_longest_mention_wins_over_all_blocks(spark):
    names = spark.createDataFrame([("z", "long name of it"), ("a", "name"), ("b", "it")], "label string, title string")
    for block in (1, 2, 100):
        assert canonical(spark.createDataFrame([("the long name of it",)], "v string"), "v", names, out="f", block=block).first().f == "z"
