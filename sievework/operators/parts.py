"""Candidate pairs from equal parts of both texts' sets of pieces.

Of two sets of ``n`` and ``m`` pieces that score t, at most ``h = (1 - t) / (1 + t) * (n + m)`` pieces stand in one only. Let a hash
deal all pieces out to K parts: a piece that stands in one set only changes one part, so at least K - h parts hold the same pieces in
both. A part with what it holds is a token; both texts have K tokens and share K - h, so in any fixed order of tokens the first h + 1
of the one and of the other have a common one (the prefix filter, over tokens). Parts that weigh most come first: those of many and of
rare pieces, by counts in a table of fixed size, which orders tokens and decides nothing else. A token holds some five pieces, so texts
that share common pieces only don't meet, as they do by single pieces once a table is so large that no piece is rare.

K follows from the size, by classes: a text has the tokens of its own class and, if a text of the next class can be its partner, those of
the next. Tokens go to the shuffle as numbers of eight bytes, packed, and meet by sorting. No part is capped.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.batches import pieces as cuts
from ..session import cut
from . import pieces as G
from . import segments as S

SPREAD = 1.2  # parts for each token that a text can need
WEIGHTS = 24  # of a piece that one text has; of one that all have 1
COMMON = 3  # tokens that partners share at least, where their class has so many; below 4, see NEED
NEED = np.uint64(3)  # bits of a token that say how many of its class partners share
NUMBER_BITS, SPLIT_BITS = 30, 33  # of a text's number; of a row within its task, as the engine counts
ENTRIES, PAIRS, SENT = 1 << 22, 1 << 21, 1 << 19  # tokens for each task that brings them together; pairs at a time; tokens sent at a time


class Numbered(NamedTuple):
    """Texts (TEXTS and no), how often the pieces of each counter stand in them, where each task's numbers begin, and their sizes."""

    texts: DataFrame
    counts: np.ndarray
    tasks: np.ndarray
    begins: np.ndarray
    most: int
    total: int


def numbered(rows: DataFrame) -> Numbered:
    """Distinct key texts (kid, key), written once, with the counts of their pieces."""
    written = cut(S.with_counts(rows, True).withColumn("no", F.monotonically_increasing_id()))
    texts = written.where("tally is null").drop("tally")
    found = texts.groupBy(F.shiftright("no", SPLIT_BITS).alias("task")).agg(F.max("no").alias("last"), F.max("n").alias("most"), F.sum("n").alias("total")).orderBy("task").collect()
    tasks = np.array([r.task for r in found], np.int64)
    sizes = np.array([r["last"] & ((1 << SPLIT_BITS) - 1) for r in found], np.int64) + 1
    if sizes.sum() >= 1 << NUMBER_BITS:
        raise ValueError("more texts than numbers")
    return Numbered(texts, S.tallied(written), tasks, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), max((r.most for r in found), default=0), sum(r.total for r in found))


def classes(t: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes at which classes begin, so that partners are of one class or of neighbours, and the parts of each."""
    edges = [1]
    while edges[-1] <= most / t + 1:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] / t**2))))
    edges = np.array([*edges, max(edges[-1] + 1, int(np.ceil(edges[-1] / t**2)))], np.int64)
    needed = _apart(t, 2 * (edges[1:] - 1)) + 1
    return edges, np.maximum(needed, (SPREAD * needed).astype(np.int64))


def needs(t: float, edges: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Common tokens of any two partners that meet in a class, COMMON at most: all of its parts but those that can differ."""
    return np.minimum(COMMON, parts - _apart(t, 2 * (edges[1:] - 1)))


def _apart(t: float, both: np.ndarray) -> np.ndarray:
    """How many pieces stand in one set only, at most, of two sets that score t and have ``both`` pieces together."""
    return np.floor((1 - t) / (1 + t) * both + 1e-9).astype(np.int64)


def _first(tokens: np.ndarray, weight: np.ndarray, row: np.ndarray, begin: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Places of the ``take`` tokens of each row (they stand row by row) that come first: by weight, then by token, then by place."""
    rank = np.arange(len(tokens)) - begin[row]
    if len(tokens) < 1 << 24 and len(begin) <= 1 << G.ROW_BITS:
        light = np.uint64(255) - np.minimum(weight, 255).astype(np.uint64)
        order = (row.astype(np.uint64) << np.uint64(52)) | (light << np.uint64(44)) | ((tokens >> np.uint64(44)) << np.uint64(24)) | np.arange(len(tokens), dtype=np.uint64)
        order.sort()
        order = (order & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.lexsort((tokens >> np.uint64(44), -np.minimum(weight, 255), row))
    return order[rank < take[row]]


def _entries(texts: Numbered, shipped, t: float, buckets: int, side: int) -> DataFrame:
    """bucket, entries: the first tokens of all texts, each as 32 bits of the token, the side, whether the text visits the next
    class, and the text's number."""
    tasks, begins = texts.tasks, texts.begins

    def tokens(piece: pa.RecordBatch):
        weights, edges, parts, need = shipped.value
        pack = G.distinct(G.packed(C.decode(piece.column("key")))[0])
        piece_row, h = G.rows_of(pack), C.mix(pack & np.uint64((1 << (64 - G.ROW_BITS)) - 1), 31)
        n = np.bincount(piece_row, minlength=piece.num_rows)
        no = np.asarray(piece.column("no"))
        number = (begins[np.searchsorted(tasks, no >> SPLIT_BITS)] + (no & ((1 << SPLIT_BITS) - 1))).astype(np.uint64)
        weigh, content, high = weights[(h & np.uint64(S.COUNTERS - 1)).astype(np.int64)].astype(np.float64), C.mix(h, 5), h >> np.uint64(32)
        for visits in (0, 1):
            own = np.maximum(np.searchsorted(edges, n, "right") - 1, 0) + visits
            most = np.minimum(edges[own + 1] - 1, np.floor(n / t + 1e-9).astype(np.int64))  # the largest partner there
            live = (n > 0) & (most >= edges[own])
            k = np.where(live, parts[own], 0)
            begin, all_parts = np.cumsum(k) - k, int(k.sum())
            if not all_parts:
                continue
            many = np.where(live, n, 0)
            mine = slice(None) if many.sum() == len(h) else live[piece_row]
            at = ((high[mine] * np.repeat(k.astype(np.uint64), many)) >> np.uint64(32)).view(np.int64) + np.repeat(begin, many)
            token = np.zeros(all_parts, np.uint64)
            np.add.at(token, at, content[mine])
            weight = np.bincount(at, weights=weigh[mine], minlength=all_parts).astype(np.int64)
            row = np.repeat(np.arange(piece.num_rows), k)
            name = (own[row].astype(np.uint64) << np.uint64(48)) | (np.arange(all_parts) - begin[row]).astype(np.uint64)
            token = (C.mix(token ^ C.mix(name, 9), 3) & ~NEED) | need[own[row]].astype(np.uint64)
            first = _first(token, weight, row, begin, _apart(t, n + most) + need[own])
            token, row = token[first], row[first]
            yield (token << np.uint64(32)) | np.uint64(side << 31 | visits << NUMBER_BITS) | number[row], ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def packed(found) -> pa.RecordBatch:
        entries, bucket = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        offsets = np.concatenate([[0], ends]).astype(np.int64) * 8
        blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), buckets, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries[order].tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), blobs], ["bucket", "entries"])

    def run(batches):
        found = []
        for batch in batches:
            for piece in cuts(batch, "key", size=G.BYTES):
                found.extend(tokens(piece))
                if sum(len(x) for x, _ in found) > SENT:
                    yield packed(found)
                    found = []
        if found:
            yield packed(found)

    return texts.texts.select("key", "no").mapInArrow(run, "bucket int, entries binary")


def _ranges(i: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Places i and j of all pairs with low[i] <= j < high[i], some at a time."""
    many = high - low
    i, low, many = i[many > 0], low[many > 0], many[many > 0]
    ends, at = np.cumsum(many), 0
    while at < len(i):
        before = ends[at - 1] if at else 0
        if many[at] > PAIRS:  # a token of very many texts
            for start in range(low[at], low[at] + many[at], PAIRS):
                j = np.arange(start, min(start + PAIRS, low[at] + many[at]))
                yield np.full(len(j), i[at]), j
            at += 1
            continue
        to = int(np.searchsorted(ends, before + PAIRS, "right"))
        m = many[at:to]
        yield np.repeat(i[at:to], m), np.repeat(low[at:to] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        at = to


def _meetings(entries: np.ndarray, same: bool):
    """Numbers of the texts that share a token, one pair for each of them; of two that visit a class none, for they meet in their own."""
    entries.sort()
    token, visits, side = entries >> np.uint64(32), ((entries >> np.uint64(NUMBER_BITS)) & np.uint64(1)).astype(bool), (entries >> np.uint64(31)) & np.uint64(1)
    number = (entries & np.uint64((1 << NUMBER_BITS) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    last = np.repeat(np.append(starts[1:], len(token)), np.diff(np.append(starts, len(token))))
    place = np.arange(len(token))
    if same:
        own = np.flatnonzero(~visits & (last > place + 1))
        for i, j in _ranges(own, own + 1, last[own]):
            yield np.minimum(number[i], number[j]), np.maximum(number[i], number[j])
        return
    # in order: the one side's own and visitors, the other's own and visitors
    kinds = (side << np.uint64(1)) | visits
    bounds = [np.repeat(np.add.reduceat((kinds <= k).astype(np.int64), starts) + starts, np.diff(np.append(starts, len(token)))) for k in (1, 2)]
    for kind, high in ((0, last), (1, bounds[1])):
        i = np.flatnonzero(kinds == kind)
        for i, j in _ranges(i, bounds[0][i], high[i]):  # noqa: B020
            yield number[i], number[j]


def candidates(queries: Numbered, others: Numbered | None, t: float) -> DataFrame:
    """no_a, no_b, kid_a, kid_b: every pair of different key texts that can score t, and more; of one table if there are no others.

    Pairs whose sizes or parities show that their sets can't score t are left out.
    """
    spark, same = queries.texts.sparkSession, others is None
    tables = (queries,) if same else (queries, others)
    counts = sum(x.counts.astype(np.int64) for x in tables)
    edges, parts = classes(t, max(x.most for x in tables))
    texts = sum(int(x.begins[-1]) for x in tables)
    scale = (WEIGHTS - 1) / np.log2(max(texts, 2))
    weights = (1 + np.clip(np.log2(max(texts, 1) / np.maximum(counts, 1)), 0, None) * scale).astype(np.uint8)
    shipped = spark.sparkContext.broadcast((weights, edges, parts, needs(t, edges, parts)))
    tokens = 3 * sum(x.total for x in tables) * (1 - t) / (1 + t)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens) // ENTRIES + 1)
    sent = _entries(queries, shipped, t, buckets, 0)
    if not same:
        sent = sent.unionByName(_entries(others, shipped, t, buckets, 1))

    def run(batches):
        blobs = [np.frombuffer(x, np.uint64) for batch in batches for x in batch.column("entries").to_pylist()]
        entries = np.concatenate(blobs) if blobs else np.zeros(0, np.uint64)
        del blobs
        need = (entries >> np.uint64(32)) & NEED
        for k in range(1, COMMON + 1):
            some = entries[need == k]
            for a, b in _meetings(some, same) if len(some) else ():
                pair, hits = np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_counts=True)
                numbers = [pa.array(_no(x, y).astype(np.int64)) for x, y in ((pair >> np.uint64(32), places[0]), (pair & np.uint64(0xFFFFFFFF), places[-1]))]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(hits), pa.array(np.full(len(pair), k))], ["no_a", "no_b", "hits", "need"])

    places = [(x.tasks, x.begins) for x in tables]
    pairs = sent.repartitionById(buckets, "bucket").select("entries").mapInArrow(run, "no_a long, no_b long, hits long, need long").groupBy("no_a", "no_b").agg(F.sum("hits").alias("hits"), F.min("need").alias("need")).where("hits >= need").drop("hits", "need")
    sketch = lambda x, s: x.texts.select(*(F.col(c).alias(f"{c}_{s}") for c in ("no", *S.CARRIED)))
    found = pairs.join(sketch(tables[0], "a").hint("shuffle_hash"), "no_a").join(sketch(tables[-1], "b").hint("shuffle_hash"), "no_b")
    differ = f"{' + '.join(f'bit_count({x}_a ^ {x}_b)' for x in S.BITS)} <= {(1 - t) / (1 + t)} * (n_a + n_b) + 1e-9"
    return found.where(f"kid_a <> kid_b and n_a >= {t} * n_b - 1e-9 and n_b >= {t} * n_a - 1e-9 and {differ}").select("no_a", "no_b", "kid_a", "kid_b")


def _no(number: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The engine's number of a text from its place among all."""
    tasks, begins = places
    number = number.astype(np.int64)
    task = np.searchsorted(begins, number, "right") - 1
    return (tasks[task] << SPLIT_BITS) + number - begins[task]
