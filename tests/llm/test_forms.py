import random

from sievework.llm.forms import same_looking, with_form
from tests.llm.test_codepoints import plain


def brute(rows):
    texts = {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), reverse=True):
        texts[i] = t
    ids = sorted(texts)
    return {(a, b) for a in ids for b in ids if a < b and texts[a] != texts[b] and plain(texts[a]) == plain(texts[b])}


def test_pairs_against_brute_force(spark):
    random.seed(5)
    base = ["pay the Bill", "café au lait", "naïve  plan", "", "x" * 5000]
    swap = {"a": "а", "e": "е", "P": "Ρ", " ": " ", "i": "​i", "x": "ｘ"}
    rows = []
    for n in range(150):
        t = random.choice(base)
        rows.append((f"r{random.randrange(120)}", "".join(swap.get(c, c) if random.random() < 0.08 and len(t) < 99 else c for c in t), n))
    rows += [(None, "pay the Bill", 0), ("z", None, 0)]
    df = spark.createDataFrame(rows, "id string, text string, form int")
    got = [tuple(r) for r in same_looking(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute([r[:2] for r in rows])


def test_hot_group_stays_linear(spark):
    rows = [(f"{k:05}", "same text") for k in range(3000)] + [("odd", "same text")]
    assert same_looking(spark.createDataFrame(rows, "id string, text string")).count() == 3000


def test_form_column(spark):
    df = spark.createDataFrame([("a", "Ｘ", 1), ("b", None, 2), ("c", "", 3)], "id string, text string, form int")
    assert [tuple(r) for r in with_form(df).orderBy("id").collect()] == [("a", "Ｘ", "X"), ("b", None, None), ("c", "", "")]
    assert with_form(df, out="text").orderBy("id").first().asDict() == {"id": "a", "form": 1, "text": "X"}
    assert same_looking(df.limit(0)).count() == 0 and with_form(df.limit(0)).count() == 0
