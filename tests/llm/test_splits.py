import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import codepoints as C
from sievework.llm.splits import banded_distances, cross_split, overlap_report
from tests.llm.test_codepoints import plain

WORDS = "the a tool returns plain yarrow message inside dossier for given quartz anchor lists each leaked squid claim to of code kd-6327 and".split()


def key(t):
    return " ".join(plain(t).casefold().split())


def grams(t):
    return {t[i : i + 5] for i in range(len(t) - 4)} or ({t} if t else set())


def score(a, b):
    x, y = grams(key(a)), grams(key(b))
    return len(x & y) / len(x | y) if x | y else 1.0


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def mutate(t, rng):
    t = list(t)
    for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
        k = rng.randrange(len(t) + 1)
        match rng.randrange(5):
            case 0:
                t[k:k] = rng.choice("xyz ")
            case 1:
                del t[k : k + rng.choice([1, 1, 2, 9])]
            case 2:
                t[k : k + 1] = rng.choice("ABCе　")
            case 3:
                t = t[k:] + list(" ") + t[:k]
            case 4:
                t[k:k] = " and more"
    return "".join(t)


def corpus(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            texts.append(mutate(rng.choice(texts), rng))
        else:
            texts.append(" ".join(rng.choices(WORDS, k=rng.choice([1, 2, 3, 4, 8, 20, 40, 90]))))
    return texts + ["", "", " ", "ab", "AB", "abcde", "abcdef", "a" * 900, "a" * 950, "ab " * 300, "ab " * 310]


def test_banded_distance():
    rng = random.Random(1)
    texts = [t for t in corpus(2, 60) if len(t) < 300]
    a, b = texts, [mutate(t, rng) if rng.random() < 0.7 else rng.choice(texts) for t in texts]
    for share in (0.1, 0.5, 0.02):
        band = np.array([int(np.ceil(share * max(len(x), len(y)))) for x, y in zip(a, b)])
        got = banded_distances(C.decode(pa.array(a)), C.decode(pa.array(b)), band)
        want = [d if (d := edit(x, y)) <= k else -1 for x, y, k in zip(a, b, band)]
        assert got.tolist() == want


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_of_brute_force(spark, seed):
    texts = corpus(seed, 260)
    rng = random.Random(seed)
    rows = [(f"i{k:04}", t, rng.random() < 0.5, "s") for k, t in enumerate(texts)]
    rows += rows[:5] + [("n1", None, True, "s"), (None, "ab", False, "s")]
    df = spark.createDataFrame(rows, "id string, text string, held boolean, kid string")
    got = {(r.id_a, r.id_b): r.score for r in cross_split(df, F.col("held")).collect()}
    seen = {r[0]: r for r in rows if r[0] and r[1] is not None}.values()
    want = {(min(a[0], b[0]), max(a[0], b[0])): s for a in seen if a[2] for b in seen if not b[2] if (s := score(a[1], b[1])) >= 0.85}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(want) > 60


def test_empty_and_report(spark):
    df = spark.createDataFrame([("a", "one two three four", True, "x"), ("b", "One two  three four", False, "y"), ("c", "other", False, "y")], "id string, text string, held boolean, source string")
    pairs = cross_split(df, F.col("held"))
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 0, 1.0)]
    report = {tuple(r) for r in overlap_report(df, pairs, F.col("held")).collect()}
    assert report == {("frozen", "x", 1, 1, 1), ("dev", "y", 2, 1, 1)}
    assert cross_split(df.limit(0), F.col("held")).count() == 0
    assert cross_split(df.where("held"), F.col("held")).count() == 0
