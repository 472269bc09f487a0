"""Key texts of the training-data operators: consistent form, folded; and rows of pairs of key texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import map_arrow, one_per_id
from ..operators.pieces import N, ROW_BITS, THRESHOLD, distinct, packed, rows_of, scores
from . import codepoints as C

__all__ = ["N", "ROW_BITS", "THRESHOLD", "distinct", "expand_pairs", "keyed", "packed", "rows_of", "scores"]


def keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, kid, key: the key text (consistent form, folded) of one row for each id, and its 128-bit hash; null texts left out."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        key = C.folded(C.consistent(C.decode(piece.column("text"))))
        kid = np.stack([C.hashes(key, 1), C.hashes(key, 2)], 1).tobytes()
        return pa.RecordBatch.from_arrays([piece.column("id"), pa.Array.from_buffers(pa.binary(16), piece.num_rows, [None, pa.py_buffer(kid)]).cast(pa.binary()), C.encode(key)], ["id", "kid", "key"])

    rows = one_per_id(df.where(F.col(text).isNotNull()), id_col, text).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    return map_arrow(rows, run, "id string, kid binary, key string", "text")


def expand_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, *extra: str) -> DataFrame:
    """Pairs of ids (id_a before id_b) from pairs of key texts (kid_a of left's rows, kid_b of right's)."""
    a, b = left.select(F.col("id").alias("x"), F.col("kid").alias("kid_a")), right.select(F.col("id").alias("y"), F.col("kid").alias("kid_b"))
    rows = pairs.join(a, "kid_a").join(b, "kid_b").where("x <> y")
    return rows.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), *extra).distinct()
