import random

import pytest

from sievework.llm.spans import shared_amounts, shared_spans


def brute(rows, length=100):
    texts = {}
    for t, i, x in sorted((r for r in rows if None not in r), reverse=True):
        texts[t, i] = x
    seen = {}
    for (_, i), x in texts.items():
        for p in range(len(x) - length + 1):
            seen.setdefault(x[p : p + length], set()).add(i)
    out = set()
    for (t, i), x in texts.items():
        mark = [False] * len(x)
        for p in range(len(x) - length + 1):
            if len(seen[x[p : p + length]]) > 1:
                mark[p : p + length] = [True] * length
        p = 0
        while p < len(x):
            q = p
            while q < len(x) and mark[q] == mark[p]:
                q += 1
            if mark[p]:
                out.add((t, i, p, q))
            p = q
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = "of anchor lists each leaked squid claim to a código kd-6327 and, the. 記録一覧 " + "x" * 130
    pool = ["".join(rng.choice(words.split(" ")) + rng.choice([" ", "", ", ", "\n"]) for _ in range(80)) for _ in range(8)]
    pool += ["ab" * 200, "a" * 400, " " * 300, "".join(rng.choices("ab", k=500)), "é" * 250]
    rows = []
    for k in range(120):
        text = ""
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            text += p[a : a + rng.choice([40, 99, 100, 101, 130, 300])] + rng.choice(["", "", "own words here %d " % rng.randrange(999)])
        rows.append((rng.choice(["item", "other"]), f"r{rng.randrange(100)}", text))
    rows += rows[:5] + [("item", "n", None), ("item", None, "x" * 200)]
    df = spark.createDataFrame(rows, "table_name string, rec_id string, text string")
    got = [tuple(r) for r in shared_spans(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    assert len(got) > 40


def test_amounts_and_empty(spark):
    rows = [("item", "a", "x1 " * 50), ("item", "b", "x1 " * 50), ("item", "c", "short"), ("item", "d", "")]
    df = spark.createDataFrame(rows, "table_name string, rec_id string, text string")
    got = {r.rec_id: (r.chars, r.shared_chars, r.spans, r.share) for r in shared_amounts(df, shared_spans(df)).collect()}
    assert got == {"a": (150, 150, 1, 1.0), "b": (150, 150, 1, 1.0), "c": (5, 0, 0, 0.0), "d": (0, 0, 0, 0.0)}
    assert shared_spans(df.limit(0)).count() == 0
