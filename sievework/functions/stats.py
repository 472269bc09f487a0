"""Interval statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two quantiles in use, the exact one of the gate and the rounded one of the reports.
Z_GATE, Z_REPORT = 1.959963984540054, 1.959964


def _bounds(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    safe = F.greatest(n, F.lit(1)).cast("double")
    p = k / safe
    middle = p + z * z / (2 * safe)
    half = z * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe))
    return (middle - half) / (1 + z * z / safe), (middle + half) / (1 + z * z / safe)


def wilson_upper(k: Column, n: Column, z: float = Z_GATE) -> Column:
    """Upper bound of the Wilson interval; an error unless 0 <= k <= n and n > 0."""
    return F.when((k >= 0) & (k <= n) & (n > 0), F.least(_bounds(k, n, z)[1], F.lit(1.0))).otherwise(F.raise_error(F.lit("need 0 <= k <= n and n > 0")).cast("double"))


def wilson(k: Column, n: Column, z: float = Z_REPORT) -> tuple[Column, Column]:
    """Both bounds within [0, 1]; (0, 1) where nothing was counted."""
    low, high = _bounds(k, n, z)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(low, F.lit(0.0))), F.when(n == 0, F.lit(1.0)).otherwise(F.least(high, F.lit(1.0)))


def _half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("int").cast("string")


def interval_label(k: Column, n: Column) -> Column:
    """k/n (low-high%), halves to even."""
    low, high = wilson(k, n)
    return F.when(n == 0, F.lit("n/a")).otherwise(F.concat(k.cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("), _half_even(100 * low), F.lit("-"), _half_even(100 * high), F.lit("%)")))


def percent_label(k: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit("n/a")).otherwise(F.format_string("%.1f%%", 100.0 * k / F.greatest(n, F.lit(1))))
