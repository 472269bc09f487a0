"""Split manifest: assignment, hashes, reconciliation of a stored manifest with a fresh one."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha256

# Held-out families.
HELD_OUT = ("mcptox_t3", "bipia_code", "bipia_text", "shadowing")
ATTRIBUTES = ("source", "family", "channel", "label", "split")
FLOORS = {"dev": 30, "frozen": 20}


def split_of(family):
    return F.when(family.isin(*HELD_OUT), "frozen").otherwise("dev")


def manifest(items: DataFrame) -> DataFrame:
    """id, attributes, split, author (null if empty) and the hash of the text."""
    return items.select("id", "source", "family", "channel", "label", split_of(F.col("family")).alias("split"), F.nullif(F.col("author"), F.lit("")).alias("author"), sha256(F.col("text")).alias("sha256"))


def drop_reasons(items: DataFrame, settled: DataFrame) -> DataFrame:
    """family, exact, near: items (id, family) that the removal (id, kept, reason) dropped, 0 where it dropped none."""
    rows = items.select("id", "family").join(settled, "id", "left")
    return rows.groupBy("family").agg(*(F.count_if(F.col("reason") == r).alias(r) for r in ("exact", "near")))


def shadowing_info(kept: DataFrame, commit: str | None = None, source: bytes | None = None) -> dict:
    """Author counts of the shadowing family, the pinned commit (a full id) and the hash of the source they were composed from."""
    info: dict = {"authors": {r.author: r.n for r in kept.where("family = 'shadowing'").groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy("author").collect()}}
    if commit is not None:
        if not re.fullmatch(r"[0-9a-f]{40}", commit.strip()):
            raise ValueError("a commit is pinned by its full id")
        info["commit"] = commit.strip()
    return info | ({} if source is None else {"source_sha256": hashlib.sha256(source).hexdigest()})


def family_table(items: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """family, split, before, after and whether too few are left."""
    before = items.groupBy("family").agg(F.count(F.lit(1)).alias("before"))
    after = (items if kept is None else kept).groupBy("family").agg(F.count(F.lit(1)).alias("after"))
    out = before.join(after, "family", "left").select("family", split_of(F.col("family")).alias("split"), "before", F.coalesce("after", F.lit(0)).alias("after"))
    return out.withColumn("few", F.col("after") < F.when(F.col("split") == "frozen", FLOORS["frozen"]).otherwise(FLOORS["dev"]))


def differences(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """id, problem: missing, extra, a changed hash, else a changed attribute."""
    a, b = stored.alias("a"), fresh.alias("b")
    changed = None
    for c in ATTRIBUTES:
        one = ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        changed = one if changed is None else changed | one
    problem = F.when(F.col("b.id").isNull(), "missing").when(F.col("a.id").isNull(), "extra").when(F.col("a.sha256") != F.col("b.sha256"), "text changed").when(changed, "attributes changed")
    return a.join(b, F.col("a.id") == F.col("b.id"), "full_outer").select(F.coalesce("a.id", "b.id").alias("id"), problem.alias("problem")).where("problem is not null")


def first_problems(found: DataFrame, most: int = 5) -> tuple[list[tuple[str, str]], int]:
    """The first few problems by kind and id, for a message, and how many there are."""
    rows = found.orderBy("problem", "id").limit(most).collect()
    return [(r.problem, r.id) for r in rows], found.count()


def in_order(rows: DataFrame) -> DataFrame:
    """Manifest rows by id, as one total order over all files that are written of it."""
    return rows.orderBy("id")


def manifest_json(header: dict, rows: list[dict]) -> str:
    """The stored form: sorted keys, one blank of indent; the same input gives the same bytes."""
    return json.dumps({**header, "items": sorted(rows, key=lambda r: r["id"])}, ensure_ascii=False, indent=1, sort_keys=True) + "\n"
