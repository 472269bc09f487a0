import random

import numpy as np
import pyarrow as pa

from sievework.llm import codepoints as C
from sievework.llm.components import components
from sievework.llm.neardup import groups, least_matches, near_duplicates, pruned, signatures
from tests.llm.test_splits import corpus, score


def test_pairs_and_groups_against_brute_force(spark):
    texts = corpus(7, 260)
    rows = [(f"i{k:04}", t, "x", 1.0) for k, t in enumerate(texts)]
    rows += rows[:6] + [("n", None, "x", 1.0), (None, "ab", "x", 1.0)]
    df = spark.createDataFrame(rows, "id string, text string, kid string, score double")
    seen = list({r[0]: r for r in rows if r[0] and r[1] is not None}.values())
    want = {(a[0], b[0]): s for a in seen for b in seen if a[0] < b[0] if (s := score(a[1], b[1])) >= 0.85}
    got = {(r.id_a, r.id_b): r.score for r in near_duplicates(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    parent = {r[0]: r[0] for r in seen}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    out = {r.id: r for r in groups(df).collect()}
    assert {k: r.class_id for k, r in out.items()} == {k: find(k) for k in parent}
    assert all(r.members == sum(q.class_id == r.class_id for q in out.values()) for r in out.values())
    assert near_duplicates(df.limit(0)).count() == 0 and groups(df.limit(0)).count() == 0


def test_components_of_chains(spark):
    rng = random.Random(2)
    edges = [(f"{k:03}", f"{k + 1:03}") for k in range(200) if k % 50] + [("500", f"{k}") for k in range(600, 700)]
    edges = [rng.choice([(a, b), (b, a)]) for a, b in edges]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got[f"{k:03}"] == f"{(k - 1) // 50 * 50 + 1:03}" for k in range(1, 201) if k % 50) and got["650"] == "500"


def test_pruning_keeps_what_reaches_the_threshold():
    assert (np.diff(least_matches(0.85, 1e-6)) > 0).all()
    rng = random.Random(4)
    kept = 0
    for _ in range(300):
        base = "".join(rng.choices("abcdefgh ", k=300))
        other = base[: 300 - 38] if rng.random() < 0.5 else base[:240] + "".join(rng.choices("xyz", k=60))
        s = signatures(C.decode(pa.array([base, other])))
        alive = len(pruned(s[:1], s[1:], 0.85, 1e-6)) == 1
        assert alive or score(base, other) < 0.85
        kept += alive
    assert kept > 100
