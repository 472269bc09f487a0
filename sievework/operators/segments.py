"""Candidate pairs from the rarest pieces of both texts (prefix filter).

Let all pieces of five characters have one fixed order. Two texts of ``n`` and ``m`` distinct pieces that score t share at least
``ceil(t * max(n, m))`` of them, so among the first ``n - ceil(t * n) + 1`` pieces of the one and the first ``m - ceil(t * m) + 1`` of
the other there is a common one, wherever it stands and however the rest is rearranged. Any order will do; rare pieces come first,
by counts in a table of fixed size, so that few texts meet. No bucket is capped and no position is excluded. Pieces that stand among the
first ones of no other text are held back by a bitmap before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.batches import map_arrow
from ..functions.batches import pieces as cuts
from ..functions.bitmaps import bitmap, within
from ..session import cut
from . import pieces as G

COUNTERS = 1 << 20  # of pieces by hash; pieces that share one are taken as equally rare

BITS = tuple(f"b{k}" for k in range(6))  # 64 parities each
CARRIED = ("kid", "n", *BITS)
TEXTS = "kid binary, key string, n int, " + ", ".join(f"{b} long" for b in BITS)


def with_counts(texts: DataFrame, tally: bool = False) -> DataFrame:
    """TEXTS: distinct key texts, their numbers of distinct pieces, and parities of those pieces.

    Two sets differ in at least as many elements as their parities do, so a pair whose parities differ in too many is no pair.
    With tally, a further column and one more row for each task, of nothing else: in how many of its texts the pieces of each counter stand.
    """
    names = ["kid", "key", "n", *BITS]

    def run(piece: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
        pack = G.distinct(G.packed(C.decode(piece.column("key")))[0])
        row = G.rows_of(pack)
        if tally:
            found.append((C.mix(pack & np.uint64((1 << (64 - G.ROW_BITS)) - 1), 31) % np.uint64(COUNTERS)).astype(np.int32))
        n = np.bincount(row, minlength=piece.num_rows)
        bit = (C.mix(pack & np.uint64((1 << (64 - G.ROW_BITS)) - 1), 41) % np.uint64(64 * len(BITS))).astype(np.int64)
        odd = (np.bincount(row * (64 * len(BITS)) + bit, minlength=piece.num_rows * 64 * len(BITS)) & 1).astype(np.uint8)
        words = np.packbits(odd.reshape(piece.num_rows, len(BITS), 64), axis=2).reshape(piece.num_rows, len(BITS), 8).view(np.int64)[:, :, 0]
        columns = [piece.column("kid"), piece.column("key"), pa.array(n.astype(np.int32)), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(len(BITS)))]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(piece.num_rows, pa.binary())] if tally else columns, [*names, "tally"] if tally else names)

    def each(batches):
        total, found = np.zeros(COUNTERS, np.uint32), []
        for batch in batches:
            for piece in cuts(batch, "key", size=G.BYTES):
                yield run(piece, found)
                if sum(map(len, found)) > 2 * COUNTERS:
                    total += np.bincount(np.concatenate(found), minlength=COUNTERS).astype(np.uint32)
                    found.clear()
        if found:
            total += np.bincount(np.concatenate(found), minlength=COUNTERS).astype(np.uint32)
        if tally and total.any():
            kinds = [pa.binary(), pa.string(), pa.int32(), *(pa.int64() for _ in BITS)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([total.tobytes()], pa.binary())], [*names, "tally"])

    return texts.select("kid", "key").dropDuplicates(["kid"]).mapInArrow(each, TEXTS + ", tally binary" if tally else TEXTS)


def tallied(rows: DataFrame) -> np.ndarray:
    """In how many texts the pieces of each counter stand: the sum of all tallies, by blocks of counters."""
    blocks = 16

    def add(batches):
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for x in batch.column("tally"):
                total += np.frombuffer(x.as_py(), np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array([x.tobytes() for x in total.reshape(blocks, -1)], pa.binary())], ["block", "tally"])

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("block").to_pylist(), batch.column("tally")):
                total[k] = total.get(k, np.uint32(0)) + np.frombuffer(x.as_py(), np.uint32)
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "tally"])

    kinds = "block int, tally binary"
    found = rows.select("tally").where("tally is not null").mapInArrow(add, kinds).repartition("block").mapInArrow(sums, kinds).collect()
    out = np.zeros((blocks, COUNTERS // blocks), np.uint32)
    for r in found:
        out[r.block] = np.frombuffer(r.tally, np.uint32)
    return out.reshape(-1)


def _hashed(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct piece of the batch's texts."""
    pack = G.distinct(G.packed(C.decode(piece.column("key")))[0])
    return G.rows_of(pack), C.mix(pack & np.uint64((1 << (64 - G.ROW_BITS)) - 1), 31)


def counts(texts: DataFrame) -> np.ndarray:
    """In how many texts the pieces of each counter stand."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for piece in cuts(batch, "key"):
                total += np.bincount((_hashed(piece)[1] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)  # one sum for each task
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "many"])

    found = texts.select("key").mapInArrow(run, "at int, many long").groupBy("at").agg(F.sum("many").alias("many")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("at").to_numpy()] = found.column("many").to_numpy()
    return out


def rarest(texts: DataFrame, shipped, t: float, wanted=None) -> DataFrame:
    """ROWS: of each text the pieces of which a text that scores t has one among its own such pieces; only the wanted ones."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        row, h = _hashed(piece)
        order = np.lexsort((h, shipped.value[(h % np.uint64(COUNTERS)).astype(np.int64)], row))
        row, h = row[order], h[order]
        n = np.bincount(row, minlength=piece.num_rows)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        few = rank < n[row] - np.ceil(t * n[row] - 1e-9) + 1
        if wanted is not None:
            few[few] = within(wanted.value, h[few])
        at = pa.array(row[few])
        return pa.RecordBatch.from_arrays([pa.array(h[few].view(np.int64)), *(piece.column(c).take(at) for c in CARRIED)], ["h", *CARRIED])

    return map_arrow(texts, run, ROWS, "key")


ROWS = "h long, kid binary, n int, " + ", ".join(f"{b} long" for b in BITS)


def candidates(queries: DataFrame, others: DataFrame, t: float = G.THRESHOLD, same: bool = False, alike: float | None = None) -> DataFrame:
    """kid_a (of queries), kid_b (of others), hits: every pair of different key texts that can score t, and more.

    Both tables: TEXTS. same: they are one table; each pair then comes once, with its smaller text first. Pairs whose parities
    show that their sets can't score ``alike`` (default t) are left out within the join.
    """
    context = queries.sparkSession.sparkContext
    shipped = context.broadcast(counts(others if same else queries.unionByName(others)))
    asked = cut(rarest(queries, shipped, t))
    wanted = context.broadcast(bitmap(asked, "h", 2 if same else 1))
    if same:
        asked = map_arrow(asked, lambda piece: piece.filter(pa.array(within(wanted.value, np.asarray(piece.column("h")).view(np.uint64)))), ROWS, rows=1 << 16)
    a, b = asked.alias("a"), (asked if same else rarest(others, shipped, t, wanted)).alias("b")
    apart = "(a.n < b.n or a.n = b.n and a.kid < b.kid)" if same else "a.kid <> b.kid"
    u = alike or t
    differ = f"{' + '.join(f'bit_count(a.{x} ^ b.{x})' for x in BITS)} <= {(1 - u) / (1 + u)} * (a.n + b.n) + 1e-9"
    found = a.join(b, "h").where(f"{apart} and a.n >= {t} * b.n - 1e-9 and b.n >= {t} * a.n - 1e-9 and {differ}")
    return found.groupBy(F.col("a.kid").alias("kid_a"), F.col("b.kid").alias("kid_b")).agg(F.count(F.lit(1)).alias("hits"))
