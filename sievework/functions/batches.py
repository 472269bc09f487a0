"""Batches for ``mapInArrow``: bounded in rows and characters, so that a worker's memory doesn't follow the length of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, BYTES = 4096, 2 << 20


def pieces(batch: pa.RecordBatch, *texts: str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows and about ``size`` bytes of the text columns (one row at least)."""
    if not batch.num_rows:
        return
    total = np.zeros(batch.num_rows, np.int64)
    for t in texts:
        total += np.asarray(pc.fill_null(pc.binary_length(batch.column(t)), 0), dtype=np.int64)
    ends = np.cumsum(total)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, before + size, "right")), at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, *texts: str, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """``mapInArrow`` of a function of one piece."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, *texts, rows=rows, size=size):
                out = function(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def one_per_id(df: DataFrame, id_col: str, *others: str) -> DataFrame:
    """One row for each id, the least by the other columns; rows without an id are left out."""
    cols = [F.col(c) for c in (id_col, *others)]
    out = df.select(*cols).where(F.col(id_col).isNotNull())
    return out.groupBy(id_col).agg(F.min(F.struct(*others)).alias("_least")).select(id_col, *(F.col("_least")[c].alias(c) for c in others))
