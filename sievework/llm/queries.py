"""Queries of the training-data operators over the project's tables. pN_ belongs to problem N; sql.py has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import canonical, forms, leakage, neardup, packing, residue, spans, splits

# The families that are held out.
HELD_OUT = ("mcptox_t3", "bipia_code", "bipia_text", "shadowing")


def _held():
    return F.col("family").isin(*HELD_OUT)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.cross_split(table(spark, folder, "item", "id", "family", "text"), _held()).select("id_a", "id_b")


def p1_per_split_and_source(spark: SparkSession, folder: str) -> DataFrame:
    item = table(spark, folder, "item", "id", "source", "family", "text")
    return splits.overlap_report(item, splits.cross_split(item, _held()), _held())


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [forms.same_looking(table(spark, folder, t, "id", "text")).select(F.lit(t).alias("table_name"), "id_a", "id_b") for t in ("item", "shadowing")]
    return parts[0].unionByName(parts[1])


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    parts = [forms.with_form(table(spark, folder, t, "id", "text")).select(F.lit(t).alias("table_name"), "id", "form").distinct() for t in ("item", "shadowing")]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "technique_label", "label", "title")
    exact = labels.select(F.col("label").alias("technique"))  # an equality join; the list may be of any size
    typed = table(spark, folder, "shadowing", "id", "technique").where("technique is not null and technique <> 'TEMPLATE'").join(exact, "technique", "left_anti")
    return canonical.canonical(typed, "technique", labels).select("id", "label").distinct()


def p3_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with its label: exact ones, matched ones and, for values that belong to none, ``unmatched``."""
    rows = table(spark, folder, "shadowing", "id", "technique").distinct()
    return canonical.canonical(rows, "technique", table(spark, folder, "technique_label", "label", "title"))


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return p3_labels(spark, folder).where("label = 'unmatched' and technique <> 'TEMPLATE'").groupBy("technique").agg(F.count(F.lit(1)).alias("records"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [neardup.near_duplicates(table(spark, folder, t, "id", "text")).select(F.lit(t).alias("table_name"), "id_a", "id_b") for t in ("quoting_dev", "shadowing")]
    return parts[0].unionByName(parts[1])


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    parts = [neardup.groups(table(spark, folder, t, "id", "text")).select(F.lit(t).alias("table_name"), "id", "class_id", "members", "links") for t in ("quoting_dev", "shadowing")]
    return parts[0].unionByName(parts[1])


def _records(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t, "id", "text").select(F.lit(t).alias("table_name"), F.col("id").alias("rec_id"), "text") for t in ("item", "quoting_dev")]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(_records(spark, folder))


def p5_shared_amounts(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    return spans.shared_amounts(records, spans.shared_spans(records))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "quoting_frozen", "id", "text"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p7_removal_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.removal_spans(_leaks(spark, folder))


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Places of all documents in containers of each capacity, in tokens of the public byte-level BPE of 50,257 entries."""
    return packing.packed(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "token_budget", "budget_id", "capacity_tokens"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p6_packing(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents", "doc_id", "text"))


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without those found."""
    docs = table(spark, folder, "documents", "doc_id", "source", "n_chars")
    return docs.join(p8_found(spark, folder), "doc_id", "left_anti")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}
