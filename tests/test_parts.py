import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievework.functions import codes as C
from sievework.operators import parts, similarity, validate

from .test_operators import score

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "rant sel tim von wex".split()]


def common_pieces(seed, n):
    """Texts of one small vocabulary, so that no piece is rare, of many lengths; a tenth are others with a few changes."""
    rng = random.Random(seed)
    texts = []
    while len(texts) < n:
        if texts and rng.random() < 0.1:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([1, 1, 2, 3])):
                k = rng.randrange(len(words) + 1)
                words[k : k + rng.choice([0, 1])] = rng.choice([[], [rng.choice(WORDS)]])
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choices(WORDS, k=rng.choice([4, 12, 30, 40, 55]))))
    return list(dict.fromkeys(t for t in texts if t))


def test_no_pair_is_lost_where_no_piece_is_rare(spark):
    texts = common_pieces(3, 700)
    df = spark.createDataFrame([(f"t{k:03}", t) for k, t in enumerate(texts)], "id string, text string").repartition(3)
    want = {(f"t{i:03}", f"t{j:03}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if score(texts[i], texts[j]) >= 0.85}
    assert len(want) > 30
    assert {(r.id_a, r.id_b) for r in similarity.self_pairs(df, "id", F.col("text")).collect()} == want
    for seed in (1, 2):
        left = (F.hash("id") + seed) % 3 == 0
        of = {r.id: r.left for r in df.select("id", left.alias("left")).collect()}
        cross = {(r.left_id, r.right_id) for r in similarity.cross_pairs(df.where(left), df.where(~left), "id", F.col("text")).collect()}
        assert cross == {(a, b) if of[a] else (b, a) for a, b in want if of[a] != of[b]}


def test_pairs_within_ranges(monkeypatch):
    monkeypatch.setattr(parts, "PAIRS", 3)
    token = np.repeat(np.array([1, 2, 3], np.uint64), [5, 1, 2]) << np.uint64(32)
    entries = token | np.array([0, 1, 2, 3, 4 | 1 << parts.NUMBER_BITS, 7, 5 | 1 << parts.NUMBER_BITS, 6 | 1 << parts.NUMBER_BITS], np.uint64)
    got = [p for a, b in parts._meetings(entries, True) for p in zip(a.tolist(), b.tolist())]
    assert sorted(got) == [(a, b) for a in range(5) for b in range(a + 1, 5)]  # each once, none of two that visit
    sided = token[:5] | np.array([0, 1 | 1 << parts.NUMBER_BITS, 2 | 1 << 31, 3 | 1 << 31, 4 | 1 << 31 | 1 << parts.NUMBER_BITS], np.uint64)
    got = [p for a, b in parts._meetings(sided, False) for p in zip(a.tolist(), b.tolist())]
    assert sorted(got) == [(0, 2), (0, 3), (0, 4), (1, 2), (1, 3)]


def test_partners_share_several_tokens(spark):
    """Of texts that share a token by chance none is left; none that scores is lost (sizes about all edges of classes)."""
    edges, k = parts.classes(0.85, 3000)
    need = parts.needs(0.85, edges, k)
    assert need.min() == 1 and need.max() == parts.COMMON and (need <= k - parts._apart(0.85, 2 * (edges[1:] - 1))).all()
    rng, rows = random.Random(8), []
    for n in [4, 5, 6, 8, 9, 12, 14, 16, 20, 25, 30, 36, 45, 60, 80, 110, 150, 220, 300, 420] * 6:
        text = "".join(rng.choices("abcdefgh", k=n))
        at = rng.randrange(n)
        rows += [text, text[:at] + rng.choice(["", "xy", "z"]) + text[at + rng.choice([0, 1]) :], text + "".join(rng.choices("ab", k=n // 7))]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame([(f"t{k:03}", t) for k, t in enumerate(rows)], "id string, text string")
    want = {(f"t{i:03}", f"t{j:03}") for i in range(len(rows)) for j in range(i + 1, len(rows)) if 0.8 < len(rows[i]) / len(rows[j]) < 1.25 if score(rows[i], rows[j]) >= 0.85}
    assert len(want) > 100 and {(r.id_a, r.id_b) for r in similarity.self_pairs(df, "id", F.col("text")).collect()} == want
    common = spark.createDataFrame([(f"t{k:03}", t) for k, t in enumerate(" ".join(rng.choices(WORDS, k=40)) for _ in range(600))], "id string, text string")
    texts = parts.numbered(similarity.keyed(common, "id", F.col("text")))
    found = parts.candidates(texts, None, 0.85)
    assert found.count() == 0 and "hits" in found._jdf.queryExecution().optimizedPlan().toString()


def chain(n):
    """Texts each of which is like its neighbours only."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60 + 4 * n)]
    return [(f"c{k:03}", " ".join(words[4 * k : 4 * k + 60])) for k in range(n)]


def test_long_chains_take_no_round_each(spark, monkeypatch):
    rows = chain(30)
    assert score(rows[0][1], rows[1][1]) >= 0.85 > score(rows[0][1], rows[2][1])
    df = spark.createDataFrame(rows, "id string, text string")
    want = {i: k % 2 == 0 for k, (i, _) in enumerate(rows)}  # each second one is dropped by the one before
    written, write = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df, *by: written.append(1) or write(df, *by))
    got = similarity.greedy(df, F.col("text"), F.lit(True)).collect()
    assert {r.id: r.kept for r in got} == want and all(r.kept or r.of == f"c{int(r.id[1:]) - 1:03}" for r in got)
    assert len(written) < 12
    short = df.where("id < 'c008'")
    monkeypatch.setattr(similarity, "FEW", 0)  # by rounds only
    assert {r.id: r.kept for r in similarity.greedy(short, F.col("text"), F.lit(True)).collect()} == {i: k for i, k in want.items() if i < "c008"}


def test_settled_links():
    rng = random.Random(9)
    for _ in range(50):
        links = [(a, b) for a in range(20) for b in range(a + 1, 20) if rng.random() < 0.15]
        gone = set()
        for v in range(20):
            if any(b == v and a not in gone for a, b in links):
                gone.add(v)
        rng.shuffle(links)
        batches = [pa.RecordBatch.from_arrays([pa.array([bytes([x[k]]) for x in part], pa.binary()) for k in (0, 1)], ["before", "after"]) for part in (links[:7], links[7:])]
        assert {x[0] for b in similarity._settled(batches) for x in b.column("kid").to_pylist()} == gone
    assert list(similarity._settled([])) == []


def test_closest_rows(spark, monkeypatch):
    texts = common_pieces(5, 250)
    once = [(f"t{k:03}", t) for k, t in enumerate(texts)]
    copies = [*once, *((f"s{k:03}", texts[7]) for k in range(9)), *((f"u{k}", texts[100]) for k in range(2)), ("t003", texts[3])]
    same_set = [*once, ("v", "pa " * 9 + "pa"), ("w", "pa " * 12 + "pa")]  # unequal texts of the same pieces
    for rows in (once, copies, same_set):
        df = spark.createDataFrame(rows, "id string, text string")
        want = [tuple(r) for r in similarity.closest(similarity.self_pairs(df.distinct(), "id", F.col("text"))).collect()]
        assert [tuple(r) for r in similarity.closest_rows(df, "id", F.col("text")).collect()] == want
    asked, find = [], parts.candidates
    monkeypatch.setattr(parts, "candidates", lambda x, y, t: asked.append(t) or find(x, y, t))
    assert similarity.closest_rows(spark.createDataFrame(copies, "id string, text string"), "id", F.col("text")).count() == 5
    assert asked == [1.0]  # five copies: nothing else is looked for
    assert similarity.closest_rows(df.limit(0), "id", F.col("text")).count() == 0


def test_overlap_with_many_attacks(spark, monkeypatch):
    monkeypatch.setattr(validate, "MANY", 1)  # attack stretches that no row has are held back
    attacks = spark.createDataFrame([("b", "x" * 10 + "the quick brown fox jumps over the lazy dog", 1), ("a", "THE quick brown fox jumps over the lazy", 2), ("s", "tiny", 3)], "id string, text string, place int")
    texts = spark.createDataFrame([("1", "so the quick  brown fox jumps over the moon"), ("2", "nothing of that sort stands in here at all"), ("3", "Tiny"), ("4", "")], "id string, text string")
    assert {tuple(r) for r in validate.window_overlap(texts, attacks).collect()} == {("1", "b"), ("3", "s")}
    assert validate.window_overlap(texts.where("id = '2'"), attacks).count() == 0 and validate.window_overlap(texts, attacks.limit(0)).count() == 0


def test_sections_hold_every_stretch_once():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab c", k=rng.choice([0, 3, 29, 30, 31, 80, 300]))) for _ in range(200)] + ["a" * 100, "", "\u00e9\U0001d11e" * 40]
    anchors, got = {}, []
    for row, pos, length, anchor in zip(*(x.tolist() for x in validate._sections(C.decode(pa.array(texts)), 30))):
        part = texts[row][pos : pos + length]
        for k in range(max(1, length - 29)):
            assert anchors.setdefault(part[k : k + 30], anchor) == anchor  # equal stretches meet in one bucket
            got.append((row, pos + k))
    assert sorted(got) == [(row, k) for row, t in enumerate(texts) for k in range(max(1, len(t) - 29))]
    known, one = validate._Known(), np.array([7, 7, 9, 7], np.int64)
    known.add(one, np.array([1, 2, 3, 1]), np.array([0, 1, 1, 2]))
    known.settle()
    known.add(one[:2], np.array([2, 5]), np.array([3, 4]))
    assert known.find(np.array([7, 7, 7, 7, 9, 9, 8]), np.array([1, 2, 5, 6, 3, 4, 1])).tolist() == [0, 1, 4, -1, 1, -1, -1]
    assert validate._Known().find(one, one).tolist() == [-1] * 4


def test_overlap_as_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    phrases = ["".join(rng.choices("abc de", k=rng.choice([12, 30, 45]))) for _ in range(12)]
    text = lambda: " ".join(rng.choice(phrases) if rng.random() < 0.5 else "".join(rng.choices("fghij", k=rng.choice([4, 25]))) for _ in range(rng.choice([1, 1, 4, 9])))
    attacks, rows = [(f"a{k}", text(), rng.randrange(9)) for k in range(60)], [(f"r{k}", text()) for k in range(120)]
    squash = lambda t: " ".join(t.split())
    cuts = lambda t: [t[k : k + 30] for k in range(max(1, len(t) - 29))]
    first = {}
    for name, t, _ in sorted(attacks, key=lambda x: (x[2], x[0])):
        for x in cuts(squash(t)):
            first.setdefault(x, name)
    want = {(name, next(first[x] for x in cuts(squash(t)) if x in first)) for name, t in rows if any(x in first for x in cuts(squash(t)))}
    assert 20 < len(want) < 120
    for many in (1, 1 << 17):
        monkeypatch.setattr(validate, "MANY", many)
        got = validate.window_overlap(spark.createDataFrame(rows, "id string, text string"), spark.createDataFrame(attacks, "id string, text string, place int"))
        assert {tuple(r) for r in got.collect()} == want
