"""Problem 2: visually identical text with different characters.

``with_form`` adds the consistent form of a text column (see ``codepoints``); ``same_looking`` finds the rows whose stored texts
differ but whose forms are equal.

Defined cases: a null text has a null form and belongs to no pair; empty texts have the empty form; repeated rows of one id count
once (the least text, if they differ); an empty table gives an empty result; other columns are carried or ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codepoints as C
from ..functions.batches import map_arrow, one_per_id


def with_form(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """Every row and column of ``df``, with the consistent form of ``text`` in ``out`` (replaced, if there is such a column)."""
    keep = [c for c in df.columns if c != out or c == text]
    schema = T.StructType([f for f in df.schema.fields if f.name in keep and f.name != out] + [T.StructField(out, T.StringType())])

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        column = piece.column(text)
        form = C.encode(C.consistent(C.decode(column)), np.asarray(column.is_null()))
        names = [n for n in piece.schema.names if n != out]
        return pa.RecordBatch.from_arrays([piece.column(n) for n in names] + [form], [*names, out])

    return map_arrow(df.select(*keep), run, schema, text)


def _hashes(df: DataFrame, id_col: str, text: str) -> DataFrame:
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        codes = C.decode(piece.column("text"))
        return pa.RecordBatch.from_arrays([piece.column("id"), pa.array(C.hashes(C.consistent(codes)).view(np.int64)), pa.array(C.hashes(codes).view(np.int64))], ["id", "form_hash", "text_hash"])

    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col(text).isNotNull()), run, "id string, form_hash long, text_hash long", "text")


def same_looking(df: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """Pairs (id_a, id_b), id_a before id_b, of different stored texts with one consistent form.

    Only hashes are shuffled for all rows: a form counts where its least and greatest text hash differ, which partial
    aggregation finds however many rows share it. Texts are then paired once per distinct spelling, not per row, and the rows
    of each spelling are joined to those pairs; so copies of one text, however many, meet only rows they are paired with.
    """
    rows = one_per_id(df.where(F.col(text).isNotNull()), id_col, text).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    forms = _hashes(rows, "id", "text").groupBy("form_hash").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low <> high").select("form_hash")
    hashed = map_arrow(rows, _with_hash, "id string, text string, form string, form_hash long", "text").join(forms, "form_hash", "left_semi")
    texts = hashed.groupBy("form", "text").agg(F.count(F.lit(1)).alias("rows")).select("form", "text")
    pairs = texts.alias("a").join(texts.alias("b"), "form").where("a.text < b.text").select(F.col("a.text").alias("text_a"), F.col("b.text").alias("text_b"))
    ids = hashed.select("id", "text")
    found = pairs.join(ids.select(F.col("id").alias("x"), F.col("text").alias("text_a")), "text_a").join(ids.select(F.col("id").alias("y"), F.col("text").alias("text_b")), "text_b")
    return found.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _with_hash(piece: pa.RecordBatch) -> pa.RecordBatch:
    form = C.consistent(C.decode(piece.column("text")))
    return pa.RecordBatch.from_arrays([piece.column("id"), piece.column("text"), C.encode(form), pa.array(C.hashes(form).view(np.int64))], ["id", "text", "form", "form_hash"])
