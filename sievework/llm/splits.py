"""Problem 1: same or near-same records across splits, by an edit-distance segment join.

A place at which an evaluation text was edited costs it four of its pieces at least, so a text that scores t against it was edited at
``k = (1 - t) n / 4`` places at most (n: its distinct pieces). It is cut into k + 1 parts, one of which stands unchanged in the other
text, at a position that differs by no more than the edits that the band allows. The beginnings of the parts are looked up among all
substrings of their length of the training texts; a bitmap of the evaluation side holds back what can match nothing before the
shuffle. A banded dynamic program decides over the candidates: a pair whose edit distance lies within the band and which reaches the
score is found, with its distance.

The score doesn't see where a passage stands, and edits that repeat what a text has already cost less than that. Pairs that reach the
score through moved passages or such repetitions come by a second path: the prefix filter of ``segments``, whose candidates lose no
pair; the exact score decides for what the first path doesn't find, and the distance is null.

Defined cases: rows without id, text or group belong to no pair; texts with one key are paired without a search; empty texts pair
with empty ones (score 1); rows delivered twice count once; an empty side gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import map_arrow
from ..functions.bitmaps import bitmap, within
from ..operators import segments as S
from ..session import cut
from . import codepoints as C
from . import grams as G

BAND = 0.1  # of the longer text's length: half the width of the dynamic program's band
CELLS = 1 << 20
LONG, SHORT, FEW = 16, 8, 32  # characters of a part that are looked up: LONG in texts of FEW characters or more, SHORT in others
SPOT = 4  # pieces that an edited place costs at least
PARTS = "h long, pos int, long int, kid binary, n int, " + ", ".join(f"{b} long" for b in S.BITS)


def banded_distances(a: C.Codes, b: C.Codes, band: np.ndarray) -> np.ndarray:
    """Edit distance of row i of a and of b where it is at most band[i], else -1; all rows of a batch advance together."""
    la, lb = np.diff(a.off), np.diff(b.off)
    out = np.full(len(la), -1, np.int64)
    todo = np.flatnonzero(np.abs(la - lb) <= band)  # a band below 0: none
    todo = todo[np.lexsort((la[todo], band[todo]))]
    at = 0
    while at < len(todo):
        width = 2 * int(band[todo[at]]) + 1
        many = max(1, CELLS // (4 * width))
        rows = todo[at : at + many]
        rows = rows[band[rows] <= 1.25 * band[rows[0]] + 1]
        at += len(rows)
        out[rows] = _distances(a, b, rows, int(band[rows].max()))
    return np.where(out > band, -1, out)


def _distances(a: C.Codes, b: C.Codes, rows: np.ndarray, k: int) -> np.ndarray:
    la, lb = np.diff(a.off)[rows], np.diff(b.off)[rows]
    offsets = np.arange(-k, k + 1)
    far = np.int32(1 << 20)
    state = np.where(offsets >= 0, offsets, far)[None, :].repeat(len(rows), 0).astype(np.int32)
    result = np.full(len(rows), far, np.int32)
    lane = np.arange(len(rows))
    base_a, base_b = a.off[rows], b.off[rows]
    for i in range(int(la.max(initial=0)) + 1):
        if i:
            j = i + offsets  # column of each cell
            col = j[None, :] - 1
            inside = (col >= 0) & (col < lb[lane][:, None])
            y = b.cp[np.clip(base_b[lane][:, None] + col, 0, max(len(b.cp) - 1, 0))] if len(b.cp) else np.zeros((len(lane), len(offsets)), np.uint32)
            x = a.cp[np.minimum(base_a[lane] + i - 1, len(a.cp) - 1)][:, None]
            step = np.where(inside, state + (x != y), far)
            up = np.concatenate([state[:, 1:], np.full((len(lane), 1), far, np.int32)], 1) + 1
            new = np.minimum(step, up)
            new = np.where((j[None, :] < 0) | (j[None, :] > lb[lane][:, None]), far, new)
            new[:, j == 0] = i
            new = np.minimum.accumulate(new - offsets, 1) + offsets
            state = np.where((j[None, :] < 0) | (j[None, :] > lb[lane][:, None]), far, new).astype(np.int32)
        ended = la[lane] == i
        if ended.any():
            end = (lb[lane] - i + k)[ended]
            ok = (end >= 0) & (end < len(offsets))
            result[lane[ended]] = np.where(ok, state[ended, np.clip(end, 0, len(offsets) - 1)], far)
        alive = ~ended & (state.min(1) <= k)
        if not alive.all():
            lane, state = lane[alive], state[alive]
        if not len(lane):
            break
    return result


def _part_rows(piece: pa.RecordBatch, codes: C.Codes, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    h = C.mix(C.window_hashes(codes.cp, codes.off[row] + at, size, 33) + size.astype(np.uint64), 33)
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(np.diff(codes.off)[row].astype(np.int32)), *(piece.column(c).take(take) for c in S.CARRIED)], ["h", "pos", "long", *S.CARRIED])


def parts(texts: DataFrame, t: float) -> DataFrame:
    """PARTS: the beginnings of the k + 1 parts of evaluation texts."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        codes = C.decode(piece.column("key"))
        sizes, n = np.diff(codes.off), np.asarray(piece.column("n")).astype(np.int64)
        size = np.where(sizes >= FEW, LONG, SHORT)
        many = np.minimum(((1 - t) * n / SPOT + 1e-9).astype(np.int64) + 1, np.maximum(sizes // size, 1)) * (sizes >= SHORT)
        row = np.repeat(np.arange(len(sizes)), many)
        j = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        return _part_rows(piece, codes, row, j * sizes[row] // many[row], size[row])

    return map_arrow(texts, run, PARTS, "key")


def substrings(texts: DataFrame, t: float, wanted) -> DataFrame:
    """PARTS: the substrings of training texts that can be such a beginning."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        codes = C.decode(piece.column("key"))
        sizes = np.diff(codes.off)
        found = []
        for size, some in ((LONG, sizes >= LONG), (SHORT, (sizes >= SHORT) & (sizes * t <= FEW))):
            many = np.where(some, np.maximum(sizes - size + 1, 0), 0)
            row = np.repeat(np.arange(len(sizes)), many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            h = C.mix(C.window_hashes(codes.cp, codes.off[row] + at, size, 33) + np.uint64(size), 33)
            k = within(wanted.value, h)
            found.append((row[k], at[k], np.full(int(k.sum()), size, np.int64)))
        return _part_rows(piece, codes, *(np.concatenate(x) for x in zip(*found)))

    return map_arrow(texts, run, PARTS, "key")


def candidates(ours: DataFrame, theirs: DataFrame, t: float, band: float) -> DataFrame:
    """kid_a (of ours), kid_b: evaluation and training texts with a part at an allowed position."""
    asked = cut(parts(ours, t))
    wanted = ours.sparkSession.sparkContext.broadcast(bitmap(asked, "h"))
    a, b = asked.alias("a"), substrings(theirs, t, wanted).alias("b")
    differ = f"{' + '.join(f'bit_count(a.{x} ^ b.{x})' for x in S.BITS)} <= {(1 - t) / (1 + t)} * (a.n + b.n) + 1e-9"
    sizes = f"a.n >= {t} * b.n - 1e-9 and b.n >= {t} * a.n - 1e-9"
    near = f"abs(a.pos - b.pos) <= ceil({band} * greatest(a.long, b.long))"
    found = a.join(b, "h").where(f"a.kid <> b.kid and {sizes} and {near} and {differ}")
    return found.select(F.col("a.kid").alias("kid_a"), F.col("b.kid").alias("kid_b"))


FOUND = "kid_a binary, kid_b binary, edits long, score double"


def verified(pairs: DataFrame, a: DataFrame, b: DataFrame, t: float, band: float) -> DataFrame:
    """FOUND: of the candidates (kid_a, kid_b, first, second: the paths they come by) those of the first path within the band, with
    their edits, and others of the second path, that reach t."""
    rows = pairs.join(a.select(F.col("kid").alias("kid_a"), F.col("key").alias("key_a")), "kid_a").join(b.select(F.col("kid").alias("kid_b"), F.col("key").alias("key_b")), "kid_b")

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        first, second = (np.asarray(piece.column(c)) for c in ("first", "second"))
        x, y = C.decode(piece.column("key_a")), C.decode(piece.column("key_b"))
        score = G.scores(x, y)
        high = score >= t - 1e-12
        longer = np.maximum(np.diff(x.off), np.diff(y.off))
        # both conditions hold for a pair of the first path; the cheaper one is looked at first
        edits = banded_distances(x, y, np.where(first & high, np.ceil(band * longer).astype(np.int64), -1))
        keep = np.flatnonzero(high & ((edits >= 0) | second))
        at = pa.array(keep)
        return pa.RecordBatch.from_arrays([piece.column("kid_a").take(at), piece.column("kid_b").take(at), pa.array(edits[keep], pa.int64(), mask=edits[keep] < 0), pa.array(score[keep])], ["kid_a", "kid_b", "edits", "score"])

    return map_arrow(rows.select("kid_a", "kid_b", "first", "second", "key_a", "key_b"), run, FOUND, "key_a", "key_b", size=1 << 19)


def cross_split(df: DataFrame, held_out: Column, id_col: str = "id", text: str = "text", t: float = G.THRESHOLD, band: float = BAND) -> DataFrame:
    """Pairs of a held-out row and another one that score t or more: id_a, id_b (id_a first in byte order), edits (null for pairs of
    the second path), score."""
    named = df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), held_out.alias("held"))
    rows = cut(G.keyed(named.where("held"), "id", "text").withColumn("held", F.lit(True)).unionByName(G.keyed(named.where("not held"), "id", "text").withColumn("held", F.lit(False))))
    ids = rows.select("id", "kid", "held")
    # a text on both sides is looked up too: it may be near other texts
    texts = cut(S.with_counts(rows.where("held")).withColumn("held", F.lit(True)).unionByName(S.with_counts(rows.where("not held")).withColumn("held", F.lit(False))))
    ours, theirs = texts.where("held").drop("held"), texts.where("not held").drop("held")
    path = lambda rows, first: rows.select("kid_a", "kid_b", F.lit(first).alias("first"), F.lit(not first).alias("second"))
    both = path(candidates(ours, theirs, t, band), True).unionByName(path(S.candidates(ours, theirs, t), False))
    near = verified(both.groupBy("kid_a", "kid_b").agg(F.bool_or("first").alias("first"), F.bool_or("second").alias("second")), ours, theirs, t, band)
    equal = ours.select("kid").intersect(theirs.select("kid")).select(F.col("kid").alias("kid_a"), F.col("kid").alias("kid_b"), F.lit(0).cast("long").alias("edits"), F.lit(1.0).alias("score"))
    return G.expand_pairs(near.unionByName(equal), ids.where("held"), ids.where("not held"), "edits", "score")


def overlap_report(df: DataFrame, pairs: DataFrame, held_out: Column, id_col: str = "id", source: str = "source") -> DataFrame:
    """For each split and source: rows that have a near-same row in the other split, pairs they are in, and rows in all."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(source).alias("source"), F.when(held_out, "frozen").otherwise("dev").alias("split")).dropDuplicates(["id"])
    links = pairs.select(F.col("id_a").alias("id")).unionByName(pairs.select(F.col("id_b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    joined = rows.join(links, "id", "left")
    return joined.groupBy("split", "source").agg(F.count(F.lit(1)).alias("rows"), F.count("links").alias("overlapping_rows"), F.coalesce(F.sum("links"), F.lit(0)).alias("pairs"))
