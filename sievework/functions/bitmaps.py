"""Bitmaps of hashes: which rows can meet others at all, told before they are shuffled.

A bitmap has a fixed number of bits, so what is collected and broadcast doesn't grow with the data. Many hashes fill it and let more
rows through; none that belong to it is ever held back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 25  # of the number of bits: 4 MB


def bitmap(rows: DataFrame, column: str, least: int = 1) -> np.ndarray:
    """Bits of the hashes (long) of a column; with ``least`` 2, of the bits that two rows or more fall upon."""
    placed = rows.select(F.shiftrightunsigned(column, 64 - BITS).alias("at"))
    if least > 1:
        placed = placed.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("at")
    words = placed.groupBy(F.expr("at >> 6").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def gathered(df: DataFrame, hashes) -> np.ndarray:
    """Bits of the hashes (uint64) that a function finds in each batch of a table; each task sends its bitmap, never the hashes."""

    def run(batches):
        words = np.zeros(1 << (BITS - 6), np.uint64)
        for batch in batches:
            place = (hashes(batch) >> np.uint64(64 - BITS)).astype(np.int64)
            np.bitwise_or.at(words, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["at", "bits"])

    words = df.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def within(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) can be one of the bitmap's."""
    place = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return ((bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
