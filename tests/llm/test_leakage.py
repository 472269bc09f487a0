import random
import re

import numpy as np
import pytest

from sievework.llm.leakage import FMIndex, WaveletMatrix, leaks, removal_spans, suffix_array
from tests.llm.test_codepoints import plain


def words(t):
    return [w.casefold() for w in re.findall(r"[^\W_]+", plain(t))]


def brute(docs, items, n=12):
    runs = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, t in items if (w := words(t)) is not None}
    out = set()
    for d, t in docs:
        w = words(t)
        mine = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        out |= {(d, i) for i, r in runs.items() if r & mine}
    return out


def test_suffix_array_and_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        rows = int(rng.integers(1, 6))
        docs = [rng.integers(0, 3, int(rng.integers(0, 30))) for _ in range(rows)]
        row = np.repeat(np.arange(rows), [len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.uint64) if len(row) else np.zeros(0, np.uint64)
        index = FMIndex(flat, row, rows)
        text = [x for k, d in enumerate(docs) for x in [*d.tolist(), None]]
        for m in (1, 2, 3):
            patterns = rng.integers(0, 4, (20, m)).astype(np.uint64)
            low, high = index.search(patterns)
            for p, a, b in zip(patterns.tolist(), low, high):
                want = [k for k in range(len(text) - m + 1) if text[k : k + m] == p]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    s = np.array([5, 5, 5, 0, 5, 5, 1])
    assert suffix_array(s).tolist() == sorted(range(7), key=lambda k: s[k:].tolist())
    v = rng.integers(0, 13, 300)
    tree = WaveletMatrix(v, 4)
    i, c = rng.integers(0, 301, 200), rng.integers(0, 13, 200)
    assert tree.rank(c, i).tolist() == [(v[:a] == b).sum() for a, b in zip(i, c)]
    assert tree.access(np.arange(300)).tolist() == v.tolist()


@pytest.mark.parametrize("block, piece", [(100_000, 100_000), (60, 30)])
def test_against_brute_force(spark, block, piece):
    rng = random.Random(3)
    vocabulary = "alpha Beta gamma Straße É x9 the of naïve İ ﬁx Οne".split()
    item_rows = [(f"q{k}", " ".join(rng.choices(vocabulary, k=rng.choice([5, 11, 12, 13, 40]))), 1) for k in range(25)]
    item_rows += [item_rows[3], ("null", None, 1), (None, "x " * 20, 1)]
    docs = []
    for k in range(300):
        w = rng.choices(vocabulary, k=rng.choice([0, 3, 50]))
        if rng.random() < 0.6:
            src = re.findall(r"[^\W_]+", plain(rng.choice(item_rows[:25])[1]))
            a = rng.randrange(max(1, len(src) - 10))
            part = src[a : a + rng.choice([11, 12, 13, 40])]
            w[rng.randrange(len(w) + 1) : 0] = [x.upper() if x == "alpha" else x for x in part]
        docs.append((k, rng.choice([" ", ", ", "\n— "]).join(w), "n"))
    docs += [(500, None, "n"), (501, "", "n"), (None, docs[0][1], "n")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(item_rows, "id string, text string, doc_id int")
    found = leaks(d, q, block=block, piece=piece)
    rows = found.collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    want = brute([r[:2] for r in docs if r[0] is not None and r[1]], [r[:2] for r in item_rows if r[0] and r[1]])
    assert len(rows) == len(got) and got == want and len(want) > 20
    texts, items = {r[0]: plain(r[1] or "") for r in docs}, {r[0]: r[1] for r in item_rows}
    for r in rows:
        for s in r.spans:
            w, v = words(texts[r.doc_id][s.start : s.end]), words(items[r.item_id])
            assert len(w) >= 12 and any(w[:12] == v[k : k + 12] for k in range(len(v)))
    assert removal_spans(found).count() > 0
    assert leaks(d.limit(0), q).count() == 0 and leaks(d, q.limit(0)).count() == 0
