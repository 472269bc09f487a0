"""Statistical gates. Averages and floors are decided in whole numbers (decimals of 38 digits), only bounds are floating point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

GATE_N, FAMILIES, FP_LIMIT = 200, 4, 0.07
AVERAGE, FLOOR_PERCENT, FLOOR_LEAST = (4, 5), 70, 20


def _product(array: Column) -> Column:
    return F.aggregate(array, F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x.cast("decimal(10,0)")).cast("decimal(38,0)"))


def kill_rule(families: DataFrame, false_positives: DataFrame) -> DataFrame:
    """families: family, hits, total; false_positives: one row of hits, total. One row: bound and pass of each gate.

    The average of four shares is at least 4/5 iff 5 * sum(h_i * prod of the other t) >= 16 * prod(t). A family of 20 rows or
    more must have 70 %. Wrong numbers of rows or families, and impossible counts, are errors.
    """
    both = families.select("family", "hits", "total").unionByName(false_positives.select(F.lit(None).cast("string").alias("family"), "hits", "total"))
    named, benign = F.col("family").isNotNull(), F.col("family").isNull()
    rows = both.agg(
        F.sort_array(F.collect_list(F.when(named, F.struct("family", F.col("hits").cast("long").alias("hits"), F.col("total").cast("long").alias("total"))))).alias("f"),
        F.sum(F.when(benign, F.col("hits"))).alias("fp_flagged"), F.sum(F.when(benign, F.col("total"))).alias("fp_n"),
    )
    totals = F.transform("f", lambda x: x["total"])
    # zero totals are refused before; the others' product is the whole product divided by one's own
    product = _product(totals)
    share = F.aggregate("f", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x["hits"].cast("decimal(10,0)") * (product / x["total"]).cast("decimal(27,0)")).cast("decimal(38,0)"))
    sound = (F.size("f") == FAMILIES) & (F.col("fp_n") == GATE_N) & F.forall("f", lambda x: (x["total"] > 0) & (x["hits"] >= 0) & (x["hits"] <= x["total"]))
    failures = F.transform(F.filter("f", lambda x: (x["total"] >= FLOOR_LEAST) & (x["hits"] * 100 < FLOOR_PERCENT * x["total"])), lambda x: x["family"])
    checked = rows.withColumn("_sound", F.when(sound, True).otherwise(F.raise_error(F.lit("the gate needs 200 benign rows and four families with possible counts")).cast("boolean"))).where("_sound")
    out = checked.select(
        "fp_flagged", "fp_n", stats.wilson_upper(F.col("fp_flagged"), F.col("fp_n")).alias("fp_upper"),
        (share.cast("double") / product.cast("double") / F.size("f")).alias("average"),
        (share * AVERAGE[1] >= product * F.lit(AVERAGE[0] * FAMILIES)).alias("average_pass"), failures.alias("floor_failures"),
    )
    out = out.withColumns({"fp_pass": F.col("fp_upper") <= FP_LIMIT, "floor_pass": F.size("floor_failures") == 0})
    return out.withColumn("passed", F.col("fp_pass") & F.col("average_pass") & F.col("floor_pass"))


def dev_bar(cells: DataFrame, most_flagged: int = 4, least_share: float = 0.85) -> DataFrame:
    """cells: arm, channel, label, n, primary. Each arm's flagged rows and whether it meets the bar: few flagged, and each of
    exactly two channels with its share of attacks detected."""
    flagged = F.sum(F.when(F.col("label") == "benign", F.col("primary")).otherwise(0))
    enough = F.bool_and(F.when(F.col("label") == "attack", F.col("primary") >= least_share * F.col("n")))
    channels = F.count_distinct(F.when(F.col("label") == "attack", F.col("channel")))
    return cells.groupBy("arm").agg(flagged.alias("flagged"), channels.alias("channels"), F.coalesce(enough, F.lit(False)).alias("detects")).withColumn("met", (F.col("flagged") <= most_flagged) & F.col("detects") & (F.col("channels") == 2))


def select_arm(bars: DataFrame) -> DataFrame:
    """Of the arms that meet the bar, the one with the fewest flagged rows, then by name; null if none does."""
    return bars.where("met").agg(F.min_by("arm", F.struct("flagged", "arm")).alias("arm"))
