"""Problem 5: long exact spans shared between records, over a De Bruijn graph of token k-mers.

Texts are cut into tokens at places that depend on the sixteen characters before them only, so a stretch is cut alike wherever it
stands. An edge of the graph is a run of tokens of at least 48 characters; every shared stretch of 100 characters holds one. Edges
that occur with one id only are dropped. Edges that all their occurrences follow with the same edge, which all its occurrences
follow after them, are compacted: such a path stands as a whole wherever one of its edges does, so a path of 100 characters or
more is a shared span at all its coordinates. Around branches, and at the ends of paths, stretches of 100 characters are verified
at their source coordinates by the hashes of the characters themselves, for those positions only whose edges are all repeated.

Nothing pairs records: an edge or a stretch counts by its least and greatest owner, which partial aggregation finds. A bitmap of the
repeated edges holds back the others before their occurrences are shuffled.

Defined cases: rows without id or text are left out; texts shorter than the length share nothing; rows delivered twice count once;
copies of one text are worked on once and share all of it; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import map_arrow
from ..functions.bitmaps import bitmap, within
from ..session import cut
from . import codepoints as C

LENGTH, CONTEXT, EDGE = 100, 16, 48  # EDGE + 3 * CONTEXT may not exceed LENGTH


def edges(codes: C.Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of every edge, in order of their starts."""
    cp, off = codes
    if not len(cp):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    word = C.word_table()[cp]
    natural = word.copy()
    natural[1:] &= ~word[:-1]
    natural[off[:-1][off[:-1] < off[1:]]] = True
    at = np.arange(len(cp))
    since = at - np.maximum.accumulate(np.where(natural, at, 0))
    b = np.flatnonzero(natural | (since >= CONTEXT))
    row = np.searchsorted(off, b, "right") - 1
    j = np.searchsorted(b, b + EDGE)
    ok = j < len(b)
    ok[ok] &= row[j[ok]] == row[ok]
    s, e = b[ok], b[j[ok]]
    return s, e, row[ok], C.window_hashes(cp, s, e - s, 61)


def _occurrences(piece: pa.RecordBatch, wanted) -> pa.RecordBatch:
    codes = C.decode(piece.column("text"))
    s, _, row, h = edges(codes)
    h = h.view(np.int64)
    same = row[1:] == row[:-1]
    after, before = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)  # 0: none
    after[:-1][same], before[1:][same] = h[1:][same], h[:-1][same]
    k = np.flatnonzero(within(wanted.value, h.view(np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array(h[k]), piece.column("tid").take(pa.array(row[k])), pa.array((s - codes.off[row])[k].astype(np.int32)), pa.array(after[k]), pa.array(before[k])], ["h", "tid", "pos", "after", "before"])


def _owned(piece: pa.RecordBatch) -> pa.RecordBatch:
    """Edges with the least and the greatest of the batch's owners that have them."""
    _, _, row, h = edges(C.decode(piece.column("text")))
    owner = np.asarray(piece.column("owner"))[row]
    order = np.lexsort((owner, h))
    h, owner = h[order].view(np.int64), owner[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(h))[: len(first)] - 1
    return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(owner[first]), pa.array(owner[last])], ["h", "low", "high"])


def _verify(piece: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Spans of compacted paths (w1, w2 null) and hashes of the stretches that are left to verify."""
    codes = C.decode(piece.column("text"))
    cp, off = codes
    s, e, row, _ = edges(codes)
    found = piece.column("found")
    counts = np.diff(np.asarray(found.offsets))
    of = np.repeat(np.arange(piece.num_rows), counts)
    pos, right, left = (np.asarray(x) for x in found.flatten().flatten())
    k = np.searchsorted(s, off[of] + pos)
    repeated, follow, lead = (np.zeros(len(s), bool) for _ in range(3))
    repeated[k], follow[k], lead[k] = True, right, left
    # paths
    linked = np.zeros(len(s), bool)
    linked[1:] = (row[1:] == row[:-1]) & repeated[1:] & repeated[:-1] & follow[:-1] & lead[1:]
    first = np.flatnonzero(~linked)
    last = np.append(first[1:], len(s)) - 1
    long = repeated[first] & (e[last] - s[first] >= length)
    ps, pe, pr = s[first[long]], e[last[long]], row[first[long]]
    # stretches to verify
    change = np.zeros(len(cp) + 2, np.int32)
    bad = ~repeated
    low, high = np.maximum(e[bad] - length + 1, off[row[bad]]), s[bad] - CONTEXT
    some = high >= low
    np.add.at(change, low[some], 1)
    np.add.at(change, high[some] + 1, -1)
    np.add.at(change, ps, 1)
    np.add.at(change, pe - length + 1, -1)
    sizes = np.diff(off)
    r = np.repeat(np.arange(piece.num_rows), np.maximum(sizes - length + 1, 0))
    p = np.flatnonzero(np.arange(len(cp)) + length <= np.repeat(off[1:], sizes))
    free = np.cumsum(change)[p] == 0
    p, r = p[free], r[free]
    w1, w2 = C.window_hashes(cp, p, length, 62).view(np.int64), C.window_hashes(cp, p, length, 63).view(np.int64)
    start, rows = np.concatenate([ps, p]), np.concatenate([pr, r])
    none = np.arange(len(start)) < len(ps)
    fill = np.zeros(len(ps), np.int64)
    return pa.RecordBatch.from_arrays(
        [piece.column(c).take(pa.array(rows)) for c in ("tid", "owner")]
        + [pa.array(start - off[rows]), pa.array(np.concatenate([pe, p + length]) - off[rows]), pa.array(np.concatenate([fill, w1]), mask=none), pa.array(np.concatenate([fill, w2]), mask=none)],
        ["tid", "owner", "start", "end", "w1", "w2"],
    )


def merged(spans: DataFrame, *key: str) -> DataFrame:
    """Unions of overlapping or touching spans (start, end) of each key."""
    over = Window.partitionBy(*key).orderBy("start", "end")
    marked = spans.withColumn("_fresh", (F.col("start") > F.coalesce(F.max("end").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    return marked.withColumn("_island", F.sum("_fresh").over(over.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def shared_spans(records: DataFrame, length: int = LENGTH) -> DataFrame:
    """table_name, rec_id, span_start, span_end: maximal stretches of each record (table_name, rec_id, text) whose characters lie
    in runs of ``length`` characters that occur with another rec_id too."""
    if length < EDGE + 3 * CONTEXT:
        raise ValueError(f"length must be {EDGE + 3 * CONTEXT} or more")
    named = records.where("rec_id is not null and text is not null").groupBy("table_name", "rec_id").agg(F.min("text").alias("text"))
    stored = cut(named.withColumn("key", F.unhex(F.md5("text"))))
    # numbers, not hashes, of ids: no two ids are ever taken for one
    owners = cut(stored.select("rec_id").distinct().withColumn("owner", F.monotonically_increasing_id()))
    rows = stored.select("table_name", "rec_id", "key")
    # copies are worked on once; one text under two ids is shared as a whole, and is no one's own
    classes = rows.join(owners, "rec_id").groupBy("key").agg(F.min("owner").alias("low"), F.max("owner").alias("high"))
    texts = stored.select("key", "text").where(F.length("text") >= length).dropDuplicates(["key"]).join(classes, "key").withColumn("tid", F.monotonically_increasing_id())
    texts = cut(texts.select("key", "text", (F.col("low") != F.col("high")).alias("copied"), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1 - F.col("tid")).alias("owner"), "tid"))
    several = cut(map_arrow(texts.select("owner", "text"), _owned, "h long, low long, high long", "text").groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("h"))
    wanted = records.sparkSession.sparkContext.broadcast(bitmap(several, "h"))
    repeated = cut(map_arrow(texts.select("tid", "text"), lambda piece: _occurrences(piece, wanted), "h long, tid long, pos int, after long, before long", "text").join(several, "h", "left_semi"))
    ways = repeated.groupBy("h").agg(F.min("after").alias("a"), F.max("after").alias("b"), F.min("before").alias("c"), F.max("before").alias("d"))
    flags = ways.select("h", F.expr("a = b and a <> 0").alias("right"), F.expr("c = d and c <> 0").alias("left"))
    found = repeated.join(flags, "h").groupBy("tid").agg(F.collect_list(F.struct("pos", "right", "left")).alias("found"))
    parts = cut(map_arrow(texts.select("tid", "owner", "text").join(found, "tid"), lambda piece: _verify(piece, length), "tid long, owner long, start long, end long, w1 long, w2 long", "text", size=1 << 20))
    stretches = parts.where("w1 is not null")
    real = stretches.groupBy("w1", "w2").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low <> high").select("w1", "w2")
    verified = stretches.join(real, ["w1", "w2"], "left_semi").select("tid", "start", "end")
    spans = merged(parts.where("w1 is null").select("tid", "start", "end").unionByName(verified), "tid").join(texts.where("not copied").select("tid", "key"), "tid").select("key", "start", "end")
    whole = texts.where("copied").select("key", F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"))
    return rows.select("table_name", "rec_id", "key").join(spans.unionByName(whole), "key").select("table_name", "rec_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def shared_amounts(records: DataFrame, spans: DataFrame) -> DataFrame:
    """For each record its number of characters, how many of them are shared, in how many spans, and their share (0 if empty)."""
    sums = spans.groupBy("table_name", "rec_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"), F.count(F.lit(1)).alias("spans"))
    rows = records.where("rec_id is not null and text is not null").groupBy("table_name", "rec_id").agg(F.length(F.min("text")).cast("long").alias("chars")).join(sums, ["table_name", "rec_id"], "left")
    rows = rows.select("table_name", "rec_id", "chars", F.coalesce("shared", F.lit(0)).alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"))
    return rows.withColumn("share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0))
