"""Drafts and their review: caps, numbering, near-duplicates in the order of appending, review batches, composed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import similarity

# Caps of drafts by source type and in all, limits of the slices.
PER_TYPE, IN_ALL, LIMITS = 40, 250, {"frozen": 200, "dev": 60}


def over_caps(ledger: DataFrame, wanted: DataFrame, per_type: int = PER_TYPE, in_all: int = IN_ALL) -> DataFrame:
    """source_type, generated, wanted, cap: what a launch (wanted: source_type, n) would exceed; source_type is null for the cap in all.

    Calls count, whatever came of them.
    """
    made = ledger.groupBy("source_type").agg(F.count(F.lit(1)).alias("generated"))
    each = wanted.join(made, "source_type", "left").select("source_type", F.coalesce("generated", F.lit(0)).alias("generated"), F.col("n").alias("wanted"), F.lit(per_type).alias("cap"))
    rows = ledger.agg(F.count(F.lit(1)).alias("generated"), F.lit(0).cast("long").alias("wanted")).unionByName(wanted.agg(F.lit(0).cast("long").alias("generated"), F.coalesce(F.sum("n"), F.lit(0)).alias("wanted")))
    total = rows.agg(F.sum("generated").alias("generated"), F.sum("wanted").alias("wanted")).select(F.lit(None).cast("string").alias("source_type"), "generated", "wanted", F.lit(in_all).alias("cap"))
    return each.unionByName(total).where(F.col("generated") + F.col("wanted") > F.col("cap"))


def numbered(drafts: DataFrame, ledger: DataFrame, order: Column) -> DataFrame:
    """``drafts`` with k, which goes on where the ledger's calls of a source type end. A type's drafts are bounded by its cap."""
    base = ledger.groupBy("source_type").agg(F.count(F.lit(1)).alias("_base"))
    at = F.row_number().over(Window.partitionBy("source_type").orderBy(order)) - 1
    return drafts.withColumn("_at", at).join(base, "source_type", "left").withColumn("k", F.coalesce("_base", F.lit(0)) + F.col("_at")).drop("_base", "_at")


def new_drafts(drafts: DataFrame, existing: DataFrame, place: str) -> DataFrame:
    """id, kept, reason, of, score of drafts (id, text, place) taken in their order: one that is like an existing text or a draft kept
    before it is dropped."""
    old = existing.select(F.concat(F.lit("old/"), "id").alias("id"), "text", F.lit(0).cast("long").alias("place"), F.lit(True).alias("old"))
    rows = old.unionByName(drafts.select(F.concat(F.lit("new/"), "id").alias("id"), "text", F.col(place).cast("long").alias("place"), F.lit(False).alias("old")))
    settled = similarity.greedy(rows, X.collapse(F.col("text")), F.col("old"), place=F.col("place"))
    return settled.where("startswith(id, 'new/')").select(F.substring("id", 5, 1 << 30).alias("id"), "kept", "reason", "of", "score")


def batch_problems(decisions: DataFrame, pending: DataFrame, have: DataFrame, reasons: tuple[str, ...], limits: dict[str, int] = LIMITS) -> DataFrame:
    """problem, subject: why a batch of decisions (id, decision, reason) may not be written; empty if it may.

    pending: id, slice of the drafts without a decision; have: slice, n rows that each slice has.
    """
    grouped = decisions.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("listed twice").alias("problem"), F.col("id").alias("subject"))
    unknown = decisions.join(pending.select("id"), "id", "left_anti").select(F.lit("not pending").alias("problem"), F.col("id").alias("subject"))
    sound = (F.col("decision") == "accept") | (F.col("decision") == "reject") & F.col("reason").isin(*reasons)
    malformed = decisions.where(~F.coalesce(sound, F.lit(False))).select(F.lit("no decision").alias("problem"), F.col("id").alias("subject"))
    gained = decisions.where("decision = 'accept'").join(pending, "id").groupBy("slice").agg(F.count(F.lit(1)).alias("more"))
    most = F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("slice"))
    total = gained.join(have, "slice", "left").withColumn("total", F.col("more") + F.coalesce("n", F.lit(0)))
    full = total.where(F.col("total") > most).select(F.lit("over its limit").alias("problem"), F.col("slice").alias("subject"))
    return unknown.unionByName(grouped).unionByName(malformed).unionByName(full).distinct()


def slice_counts(rows: DataFrame) -> DataFrame:
    """slice, n: rows that are no templates, 0 for a slice without any."""
    counts = rows.where(~F.col("id").startswith("TEMPLATE")).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    listed = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, LIMITS))).alias("slice"))
    return listed.join(counts, "slice", "left").select("slice", F.coalesce("n", F.lit(0)).alias("n"))


def composed_problems(source: DataFrame, committed: DataFrame) -> DataFrame:
    """id, problem: records (id, host_description, fenced_block, clause) whose composed text isn't among the committed rows (id, text),
    or differs from what stands there."""
    composed = source.select("id", X.compose(F.col("host_description"), F.col("fenced_block"), F.col("clause")).alias("composed"))
    rows = composed.join(committed.select("id", F.col("text"), F.lit(True).alias("_there")), "id", "left")
    return rows.select("id", F.when(F.col("_there").isNull(), "missing").when(~F.col("composed").eqNullSafe(F.col("text")), "differs").alias("problem")).where("problem is not null")
