"""Validators: rows of records against closed schemas, duplicate ids, spreads, counts over fixed orders, overlap with attacks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes as C
from ..functions import text as X
from ..functions.batches import map_arrow, pieces
from ..functions.bitmaps import gathered, within
from ..session import cut

# Closed vocabularies and bounds of the two kinds of own records.
AUTHORS, POSITIONS, PLACEMENTS, BUCKETS = ("human", "gpt"), ("start", "middle", "end", "only"), ("start", "middle", "end"), ("short", "medium", "long")
QUOTING_AUTHORS, SLICES, FORMS, CHANNELS = ("human", "nemotron-super"), ("frozen", "dev"), ("verbatim_quote", "discussion"), ("tool_description", "tool_result", "other")
SOURCE_TYPES = ("security_blog", "github_issue", "docs", "ctf_writeup", "test_fixture", "readme_warning", "postmortem", "code_comment", "tool_description_warning", "forum_post")
SHADOWING_FIELDS, SHADOWING_OPTIONAL = ("id", "author", "channel", "family", "technique", "clause_position", "host_tool", "target_tool", "text"), ("source_placement",)
QUOTING_FIELDS = ("id", "author", "slice", "source_type", "form", "channel", "reviewed", "text")
TEMPLATE, MIN_N, MIN_TECHNIQUES, MAX_TECHNIQUE_SHARE = "TEMPLATE", 35, 5, 0.30
FROZEN_N, DEV_RANGE, MAX_SOURCE_SHARE, VERBATIM_RANGE, WINDOW = 200, (40, 60), 0.20, (0.40, 0.60), 30
ANCHOR = 16  # characters by which stretches are brought together
MANY = 1 << 17  # anchors of attacks from which on those that no row has are held back
ANCHORS, SENT = 1 << 18, 1 << 19  # anchors of attacks for each task that compares stretches; bytes of text at a time


def _one_of(name: str, values: tuple[str, ...]) -> Column:
    return F.when(~F.coalesce(F.col(name).isin(*values), F.lit(False)), F.lit(f"{name} must be one of {'|'.join(values)}"))


def _filled(name: str) -> Column:
    return F.when(F.length(F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), X.SPACE, " "))) == 0, F.lit(f"{name} must not be empty"))


def problems(df: DataFrame, key: str, *rules: Column) -> DataFrame:
    """key, problem: one row for each broken rule; a rule is a message or null."""
    return df.select(key, F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def shadowing_rules() -> list[Column]:
    technique = F.trim(F.coalesce("technique", F.lit("")))
    return [
        *(_filled(n) for n in ("id", "text", "technique", "host_tool", "target_tool")),
        F.when((technique != "") & (technique != TEMPLATE) & ~X.is_snake_case(technique), F.lit("technique must be lowercase snake_case")),
        _one_of("author", AUTHORS), _one_of("channel", ("tool_description",)), _one_of("family", ("shadowing",)), _one_of("clause_position", POSITIONS),
        F.when(F.col("source_placement").isNotNull(), _one_of("source_placement", PLACEMENTS)),
    ]


def quoting_rules() -> list[Column]:
    return [*(_filled(n) for n in ("id", "text")), _one_of("author", QUOTING_AUTHORS), _one_of("slice", SLICES), _one_of("source_type", SOURCE_TYPES), _one_of("form", FORMS), _one_of("channel", CHANNELS), F.when(F.col("reviewed").isNull(), F.lit("reviewed must be true or false"))]


def key_problems(lines: DataFrame, json: str, fields: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """line_no, problem: missing and unknown keys of JSON objects, and lines that are none."""
    keys = F.json_object_keys(F.col(json))
    name = lambda prefix, values: F.transform(F.array_sort(values), lambda k: F.concat(F.lit(prefix + " field '"), k, F.lit("'")))
    want, known = F.array(*map(F.lit, fields)), F.array(*map(F.lit, fields + optional))
    found = F.when(keys.isNull(), F.array(F.lit("row is not a JSON object"))).otherwise(F.concat(name("missing", F.array_except(want, keys)), name("unknown", F.array_except(keys, known))))
    return lines.select("line_no", F.explode(found).alias("problem"))


def duplicate_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, first: the rows that repeat an id, with the place of its first row. The first is found by aggregation and joined, so
    that an id of a third of all rows isn't sorted in one task."""
    first = df.groupBy(key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return df.select(key, order).join(first, key).where(F.col(order) > F.col("first"))


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each id. A struct's least is found by partial aggregation, so a hot id isn't sorted in one task."""
    others = [c for c in df.columns if c != key]
    least = df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_row"))
    return least.select(key, *(F.col("_row")[c].alias(c) for c in others)).select(*df.columns)


def zero_filled(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """value, place, count: counts over a fixed order, 0 where a value is absent; others aren't counted."""
    order = F.posexplode(F.array(*map(F.lit, values))).alias("place", "value")
    listed = df.sparkSession.range(1).select(order)
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return listed.join(counts, "value", "left").select("value", "place", F.coalesce("count", F.lit(0)).alias("count"))


def bucket_crosstab(df: DataFrame, text: str = "text", position: str = "clause_position") -> DataFrame:
    """Rows by length bucket and clause position, 0 where there are none."""
    counts = df.select(X.length_bucket(F.col(text)).alias("bucket"), position).groupBy("bucket").pivot(position, list(POSITIONS)).count()
    listed = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, BUCKETS))).alias("bucket"))
    return listed.join(counts, "bucket", "left").na.fill(0)


def share_warnings(df: DataFrame, column: Column, most: float) -> DataFrame:
    """value, count, n: the values that more than a share of all rows have."""
    counts = df.groupBy(column.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one").where(F.col("count") / F.greatest("n", F.lit(1)) > most)  # one row is sent


def slice_warnings(df: DataFrame) -> DataFrame:
    """n, verbatim, human and whether their shares are out of range, for each slice."""
    out = df.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("form") == "verbatim_quote").alias("verbatim"), F.count_if(F.col("author") == "human").alias("human"), F.count_if(~F.coalesce("reviewed", F.lit(False))).alias("unreviewed"))
    share = F.col("verbatim") / F.col("n")
    size = F.when(F.col("slice") == "frozen", F.col("n") != FROZEN_N).otherwise(~F.col("n").between(*DEV_RANGE))
    return out.withColumns({"verbatim_warning": (share < VERBATIM_RANGE[0]) | (share > VERBATIM_RANGE[1]), "human_warning": F.col("human") * 3 < F.col("n"), "size_error": size})


def _stretches(codes: C.Codes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and two hashes of every stretch of ``size`` characters, or of the whole of a shorter text."""
    sizes = np.diff(codes.off)
    count = np.maximum(sizes - size + 1, 1)
    row = np.repeat(np.arange(len(sizes)), count)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start, length = codes.off[:-1][row] + pos, np.minimum(size, sizes[row])
    a, b = (C.mix(C.window_hashes(codes.cp, start, length, seed) + length.astype(np.uint64), seed) for seed in (91, 92))
    return row, pos, a.view(np.int64), b.view(np.int64)


def _sections(codes: C.Codes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place, length and anchor of the sections of texts: of stretches that follow one another and have one anchor.

    A stretch's anchor is the least hash of its runs of ANCHOR characters, so equal stretches have one anchor wherever they stand. A text
    shorter than a stretch is one section.
    """
    cp, off = codes
    sizes = np.diff(off)
    short = np.flatnonzero(sizes < size)
    found = [(short, np.zeros(len(short), np.int64), sizes[short], C.hashes(codes, 95)[short])]
    count = np.maximum(sizes - size + 1, 0)
    if count.any():
        run = min(ANCHOR, size)
        least, span, wide = C.window_hashes(cp, np.arange(len(cp) - run + 1), run, 93), 1, size - run + 1
        while span < wide:
            step = min(span, wide - span)
            least, span = np.minimum(least[:-step], least[step:]), span + step
        row = np.repeat(np.arange(len(sizes)), count)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        anchor = least[off[:-1][row] + pos]
        begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
        found.append((row[begin], pos[begin], np.diff(np.append(begin, len(row))) + size - 1, anchor[begin]))
    row, pos, length, anchor = (np.concatenate(x) for x in zip(*found))
    return row, pos, length, C.mix(anchor, 94)  # least hashes are small ones


def sections(keys: DataFrame, buckets: int, size: int = WINDOW, wanted=None) -> DataFrame:
    """bucket, id, place, part: the sections of collapsed texts (id, key), in buckets by their anchors; only the wanted ones."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        cp, off = codes = C.decode(piece.column("key"))
        row, pos, length, anchor = _sections(codes, size)
        if wanted is not None:
            k = within(wanted.value, anchor)
            row, pos, length, anchor = row[k], pos[k], length[k], anchor[k]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(off[row] + pos - (ends - length), length)
        part = C.encode(C.Codes(cp[at], np.concatenate([[0], ends]).astype(np.int64)))
        bucket = ((anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(bucket), piece.column("id").take(pa.array(row)), pa.array(pos.astype(np.int32)), part], ["bucket", "id", "place", "part"])

    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("id", keys.schema["id"].dataType), *T.StructType.fromDDL("place int, part string").fields])
    return map_arrow(keys.select("id", "key"), run, schema, "key", size=SENT)


def _anchor_bits(keys: DataFrame, size: int, wanted=None) -> np.ndarray:
    """Bitmap of the anchors of collapsed texts (id, key); only of the wanted ones."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        found = [np.unique(_sections(C.decode(p.column("key")), size)[3]) for p in pieces(batch, "key", size=SENT)]
        found = np.concatenate(found) if found else np.zeros(0, np.uint64)
        return found if wanted is None else found[within(wanted.value, found)]

    return gathered(keys.select("key"), hashes)


class _Known:
    """Stretches by their two hashes, each with the number of the first section that has it; sections are added in order."""

    def __init__(self):
        self.a, self.b, self.first, self.new = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, a: np.ndarray, b: np.ndarray, section: np.ndarray) -> None:
        self.new.append((a, b, section))
        if sum(len(x[0]) for x in self.new) > max(1 << 20, len(self.a)):
            self.settle()

    def settle(self) -> None:
        if self.new:
            a, b, first = (np.concatenate(x) for x in zip((self.a, self.b, self.first), *self.new))
            order = np.argsort(a, kind="stable")
            a, b, first = a[order], b[order], first[order]
            k = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
            self.a, self.b, self.first, self.new = a[k], b[k], first[k], []

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first section that has each stretch, or -1."""
        self.settle()
        out, at, asked = np.full(len(a), -1), np.searchsorted(self.a, a), np.arange(len(a))
        while len(asked):
            asked = asked[at[asked] < len(self.a)]
            asked = asked[self.a[at[asked]] == a[asked]]
            hit = self.b[at[asked]] == b[asked]
            out[asked[hit]] = self.first[at[asked[hit]]]
            asked = asked[~hit]  # another stretch with that first hash
            at[asked] += 1
        return out


def window_overlap(rows: DataFrame, attacks: DataFrame, size: int = WINDOW) -> DataFrame:
    """row_id, attack_id: each row that shares a stretch with an attack, by its first stretch that does; of attacks, the first
    in order (attacks: id, text, place).

    Stretches that follow one another and have one anchor go through the shuffle together, as the text they stand in, so a
    stretch takes some four bytes there. A bitmap of the attacks' anchors holds back those of the rows that no attack has, and one of what is left those of
    many attacks. A task compares the stretches themselves; those of the attacks are kept once each.
    """
    key = X.collapse(X.normalize(F.col("text")))
    spark = rows.sparkSession
    send = spark.sparkContext.broadcast
    attack_keys = cut(attacks.where("text is not null").select(F.struct("place", "id").alias("id"), key.alias("key")))
    texts = cut(rows.where("id is not null and text is not null").select("id", key.alias("key")))
    rough = _anchor_bits(attack_keys, size)
    wanted = send(rough)
    anchors = int(np.bitwise_count(rough).sum())
    shared = send(_anchor_bits(texts, size, wanted)) if anchors >= MANY else None
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), anchors // ANCHORS + 1)
    who, row_id = attack_keys.schema["id"].dataType, texts.schema["id"].dataType
    mine = sections(attack_keys, buckets, size, shared).select("bucket", F.lit(0).alias("side"), F.col("id").alias("who"), F.lit(None).cast(row_id).alias("id"), "place", "part")
    theirs = sections(texts, buckets, size, wanted if shared is None else shared).select("bucket", F.lit(1).alias("side"), F.lit(None).cast(who).alias("who"), "id", "place", "part")

    def run(batches):
        known, names, total = _Known(), [], 0
        for batch in batches:
            for p in pieces(batch, "part", size=SENT):
                side = np.asarray(p.column("side"))
                if many := int((side == 0).sum()):  # attacks come first, in order
                    row, _, a, b = _stretches(C.decode(p.column("part").slice(0, many)), size)
                    known.add(a, b, row + total)
                    names.append(p.column("who").slice(0, many))
                    total += many
                p = p.slice(many)
                if p.num_rows and total:
                    if len(names) > 1:
                        names = [pa.concat_arrays(names)]
                    row, pos, a, b = _stretches(C.decode(p.column("part")), size)
                    section = known.find(a, b)
                    hits = np.flatnonzero(section >= 0)
                    hits = hits[np.unique(row[hits], return_index=True)[1]]  # the first of each section
                    at = pa.array(row[hits])
                    yield pa.RecordBatch.from_arrays([p.column("id").take(at), pa.array((np.asarray(p.column("place"))[row[hits]] + pos[hits]).astype(np.int32)), names[0].take(pa.array(section[hits]))], ["id", "place", "who"])

    schema = T.StructType([T.StructField("id", row_id), T.StructField("place", T.IntegerType()), T.StructField("who", who)])
    met = mine.unionByName(theirs).repartitionById(buckets, "bucket").sortWithinPartitions("side", "who").drop("bucket").mapInArrow(run, schema)
    return met.groupBy(F.col("id").alias("row_id")).agg(F.min(F.struct("place", "who")).alias("first")).select("row_id", F.col("first.who.id").alias("attack_id"))
