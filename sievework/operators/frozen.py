"""The frozen run: evaluation as one result, consistency of its protocol, reasons to refuse it, orders of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import gates, scoring
from .manifest import HELD_OUT


def evaluate(scored: DataFrame) -> DataFrame:
    """One row: errors, n, valid, the gates' bounds and passes, passed (null if the run is invalid), families (array of family, hits, total).

    Families other than the held-out ones, and another number of benign rows than the gate's, are errors, even of an invalid run.
    """
    families = scoring.counts_by(scored, "attack", F.col("family"), "family")
    benign = scored.where("label = 'benign'").agg(F.coalesce(F.sum(scoring.hit().cast("int")), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("total"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    listed = families.agg(F.array_sort(F.collect_list(F.struct("family", "hits", "total"))).alias("families"))
    right = F.transform("families", lambda f: f["family"]) == F.array(*map(F.lit, sorted(HELD_OUT)))
    listed = listed.withColumn("families", F.when(right, F.col("families")).otherwise(F.raise_error(F.lit("the frozen run needs exactly the held-out families")).cast(listed.schema["families"].dataType)))
    row = one(scoring.error_stats(scored)).join(one(gates.kill_rule(families, benign)), "_one").join(one(listed), "_one").drop("_one")  # one row each
    return row.withColumn("passed", F.when(F.col("valid"), F.col("passed")))


def breakdowns(scored: DataFrame) -> DataFrame:
    """section, key, hits, total: what doesn't gate: channels, authors of one family, subgroups."""
    attack, benign = F.col("label") == "attack", F.col("label") == "benign"
    part = lambda name, key: F.struct(F.lit(name).alias("section"), key.alias("key"))
    sections = F.array(
        part("detection by channel", F.when(attack, F.col("channel"))), part("false positives by channel", F.when(benign, F.col("channel"))),
        part("shadowing by author", F.when(attack & (F.col("family") == "shadowing"), F.col("author"))), part("quoting by author", F.when(benign, F.col("author"))),
        part("bipia_text subgroups", F.when(attack, scoring.subgroup(F.col("id"), F.col("family"), "bipia_text", scoring.OBFUSCATION))),
    )
    rows = scored.select(scoring.hit().cast("int").alias("_hit"), F.explode(sections).alias("s")).where("s.key is not null")
    return rows.groupBy("s.section", "s.key").agg(F.sum("_hit").alias("hits"), F.count(F.lit(1)).alias("total"))


# What a run of this code would use, whatever the settings of its caller.
RUN = {"max_tokens": 256, "temperature": 0, "verdict_rule": "attack", "error_scoring": "pessimistic", "normalizer_version": 1}


def protocol_problems(values: dict, prompt_sha256: str | None, settings: dict) -> list[tuple[str, object, object]]:
    """key, protocol's value, run's value wherever they differ; settings: endpoint, model, extra_body of the run."""
    actual = {"prompt_sha256": prompt_sha256} | settings | RUN
    return [(k, values.get(k), v) for k, v in actual.items() if values.get(k) != v]


def earlier_starts(ledger: DataFrame, new_experiment: bool = False) -> int:
    """Starts in the ledger of frozen runs (event) that forbid another one, unless it is a new experiment."""
    return 0 if new_experiment else ledger.where("event = 'start'").count()


def refusals(problems: list, clean: bool, starts: int, ordered: bool = True) -> list[str]:
    """Why a frozen run must not start; empty if it may."""
    return [*("protocol" for _ in problems[:1]), *([] if clean else ["uncommitted changes"]), *([f"{starts} earlier runs"] if starts else []), *([] if ordered else ["order of commits"])]


def strict_ancestors(commits: DataFrame, of: str) -> DataFrame:
    """id of every commit (id, parent; one row for each parent) that lies strictly before one. As many rounds as the longest way back."""
    links = cut(commits.where("id is not null and parent is not null").select("id", "parent").distinct())
    front = cut(links.where(F.col("id") == of).select(F.col("parent").alias("id")).distinct())
    seen = front
    while not front.isEmpty():
        front = cut(links.join(front, "id", "left_semi").select(F.col("parent").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.unionByName(front)
    return seen
