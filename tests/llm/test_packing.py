import numpy as np
import pytest

from sievework.llm.packing import best_fit, cross, evolve, fill, load_tokenizer, mutate, pack, packed, read_tokenizer, tokenizer_path


def valid(p):
    loads = np.bincount(p.of, weights=p.sizes, minlength=len(p.loads)).astype(int)
    return loads.tolist() == list(p.loads) and (loads <= p.capacity).all() and len(set(p.of.tolist())) == len(p.loads)


def test_operators_keep_packings_valid_and_do_no_harm():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(0, 101, int(rng.integers(1, 120)))
        a, b = pack(sizes, 100), pack(sizes, 100, rng)
        assert valid(a) and valid(b)
        for _ in range(5):
            a, b = cross(a, b, rng), mutate(b, rng)
            assert valid(a) and valid(b)
        best = evolve(sizes, 100, [b.of], rng)
        assert valid(best) and len(best.loads) <= min(len(b.loads), len(pack(sizes, 100).loads))


def test_improves_on_best_fit():
    # triples that fill a container exactly, which best fit misses
    rng = np.random.default_rng(5)
    triples = [(x := int(rng.integers(380, 490)), y := int(rng.integers(260, 1000 - x - 250)), 1000 - x - y) for _ in range(20)]
    sizes = rng.permutation(np.array(triples).ravel())
    assert len(evolve(sizes, 1000, [], rng, generations=300, population=10).loads) < len(pack(sizes, 1000).loads)


def test_whole_operator(spark):
    words = "harbor violet ledger chimney parsley gasket ".split()
    rng = np.random.default_rng(2)
    docs = [(k, " ".join(rng.choice(words, int(rng.integers(0, 60)))), "x") for k in range(300)] + [(900, "ledger " * 1000, "x"), (901, "", "y"), (902, None, "z"), (None, "ledger", "z"), (5, "ledger", "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string")
    budgets = spark.createDataFrame([("small", 100, 1), ("large", 512, 2), ("none", 0, 3), (None, 9, 4)], "budget_id string, capacity_tokens int, size int")
    rows = packed(df, budgets, block=64).collect()
    tokenizer = load_tokenizer(*read_tokenizer(tokenizer_path()))
    texts = {}
    for d, t, _ in docs:
        if d is not None and t is not None:
            texts[d] = min(t, texts.get(d, t))
    for name, capacity in (("small", 100), ("large", 512)):
        mine = [r for r in rows if r.budget_id == name]
        tokens, loads, parts = {}, {}, {}
        for r in mine:
            tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.tokens
            parts[r.doc_id] = parts.get(r.doc_id, 0) + 1
            loads.setdefault(r.container, []).append(r)
        assert tokens == {d: len(tokenizer.encode_ordinary(t)) for d, t in texts.items()}
        assert all(sum(r.tokens for r in c) <= capacity and sorted(r.place for r in c) == list(range(len(c))) for c in loads.values())
        assert all(parts[d] == 1 for d in tokens if tokens[d] <= capacity)
    assert {r.budget_id for r in rows} == {"small", "large"}
    for r in fill(packed(df, budgets, block=64)).collect():
        assert r.least <= r.containers <= 1.1 * r.least + 1 and 0 < r.used <= 1
    assert packed(df.limit(0), budgets).count() == 0 and packed(df, budgets.limit(0)).count() == 0


def test_best_fit_takes_the_least_room():
    of, loads = np.zeros(1, np.int64), [50, 70, 60]
    best_fit(np.array([30]), 100, np.array([0]), of, loads)
    assert of.tolist() == [1]


@pytest.mark.parametrize("sizes", [[], [0, 0], [7]])
def test_small(sizes):
    assert len(evolve(np.array(sizes, np.int64), 7, [], np.random.default_rng(1)).loads) == (1 if sizes else 0)
