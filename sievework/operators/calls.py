"""Classifier calls as tables: pluggable classifiers, remembered verdicts, ledgers, budgets, circuit breakers, samples."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import replies
from ..session import cut


# Attempts at a reply that fails the strict check, and the error of a call without budget.
ATTEMPTS, BUDGET = 2, "budget exhausted"
OUTCOME = "verdict string, family string, span string, error string, attempts int, raw string"


def _outcomes(items: DataFrame, call: Callable[[str], tuple], workers: int | None, text: str) -> DataFrame:
    """``items`` with OUTCOME of each text; an exception becomes an error row. The result is written once before any use, so a repeated
    task calls again only for rows of its own that weren't written. Rows carry their own order, if they have one."""
    schema = T.StructType([*items.schema.fields, *T.StructType.fromDDL(OUTCOME).fields])

    def one(value):
        try:
            return call(value)
        except Exception as e:  # noqa: BLE001 - a failed call is a row of the result
            return "error", None, None, f"{type(e).__name__}: {e}"[:300], 1, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([one(t) for t in batch[text]], columns=[f.split()[0] for f in OUTCOME.split(", ")], index=batch.index)
            yield pd.concat([batch, found], axis=1)

    return cut((items.repartition(workers) if workers else items).mapInPandas(run, schema))


def classify(items: DataFrame, classifier: Callable[[str], tuple[str, str | None]], text: str = "text", workers: int | None = None) -> DataFrame:
    """``items`` with verdict and error of any classifier: a function of a text."""
    return _outcomes(items, lambda t: (lambda v: (v[0], None, None, v[1], 1, None))(classifier(t)), workers, text).select(*items.columns, "verdict", "error")


def ask(items: DataFrame, chat: Callable[[str], tuple[str, str]], text: str = "text", workers: int | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """``items`` with OUTCOME of a model's strict replies. chat: content and finish reason of a reply to a text; a reply that fails the
    check is asked for again, an exception isn't. attempts counts the calls, raw keeps a failed reply for the errors' file."""

    def call(value):
        for k in range(1, attempts + 1):
            content, finish = chat(value)
            verdict, family, span, error = replies.check_verdict(content, finish)
            if verdict != "error":
                return verdict, family, span, None, k, None
        return verdict, family, span, error, attempts, (content or "")[:4000]

    return _outcomes(items, call, workers, text)


def ask_spans(items: DataFrame, chat: Callable[[str], tuple[str, str]], text: str = "text", workers: int | None = None) -> DataFrame:
    """``items`` with OUTCOME of span replies, one call each; error tells unsure by declaration from a reply that is malformed."""

    def call(value):
        content, _ = chat(value)
        verdict = replies.check_spans(content)
        kind = None if verdict != "unsure" else "declared" if replies.is_wellformed(content) else "parse_failure"
        return verdict, None, None, kind, 1, None if kind != "parse_failure" else (content or "")[:4000]

    return _outcomes(items, call, workers, text)


def with_cache(items: DataFrame, cache: DataFrame, classifier: Callable[[str], tuple[str, str | None]]) -> DataFrame:
    """Rows (key, text, ...) with remembered verdicts where the cache (key, verdict) has them; only the others are classified."""
    joined = items.join(cache.select("key", F.col("verdict").alias("_known")), "key", "left")
    known = joined.where("_known is not null").select(*items.columns, F.col("_known").alias("verdict"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    fresh = classify(joined.where("_known is null").drop("_known"), classifier).withColumn("cached", F.lit(False))
    return known.unionByName(fresh)


def ask_with_cache(items: DataFrame, cache: DataFrame, chat: Callable[[str], tuple[str, str]], cap: int, order: str = "place") -> tuple[DataFrame, DataFrame]:
    """(outcomes, cache lines to append): the whole path of a remembered classifier over items (key, text, order, ...).

    A remembered verdict is taken; of the others, in their order and each key once, those within the budget are asked, the rest are errors.
    Since a key can take two attempts, the budget counts the attempts that may be needed. Only sound verdicts go to the cache.
    """
    asked = items.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by("text", order).alias("text"), F.min(order).alias(order))
    planned = within_budget(asked.withColumn("_run", F.lit(0)), "_run", [F.col(order), F.col("key")], F.lit(True), max(0, cap // ATTEMPTS))
    fresh = ask(planned.where("not blocked").select("key", "text"), chat).drop("text")
    none = F.lit(None).cast("string")
    blocked = planned.where("blocked").select("key", F.lit("error").alias("verdict"), none.alias("family"), none.alias("span"), F.lit(BUDGET).alias("error"), F.lit(0).alias("attempts"), none.alias("raw"))
    old = cache.select("key", "verdict", "family", "span", none.alias("error"), F.lit(0).alias("attempts"), none.alias("raw"), F.lit(True).alias("cached"))
    known = fresh.unionByName(blocked).withColumn("cached", F.lit(False)).unionByName(old)
    return items.join(known, "key"), fresh.where("verdict <> 'error'").select("key", "verdict", "family", "span")


def repeated_runs(items: DataFrame, runs: int, classifier: Callable[[str], tuple[str, str | None]]) -> DataFrame:
    """Outcomes of each item in each of ``runs`` runs, with no memory between them."""
    each = items.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    return classify(each, classifier)


def with_retries(call: Callable[[], object], attempts: int = 6, base: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep, wait_of: Callable[[Exception], float | None] = lambda e: None):
    """The result of a call that may fail: tried again after waits that double from ``base`` to ``most`` seconds with a random part, or
    as long as the failure asks (``wait_of``); the last failure is raised. For clients within a partition."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:  # noqa: BLE001 - the kind of failure is the caller's business
            if k + 1 == attempts:
                raise
            asked = wait_of(e)
            sleep(min(most, base * 2**k) * (0.5 + random.random() / 2) if asked is None else asked)
    raise ValueError("at least one attempt is needed")


def probe_endpoints(candidates: list[tuple[str, str]], chat: Callable[[str, bool], str], embed: Callable[[str], list[list[float]]]) -> list[dict]:
    """One row for each model (name, kind): whether it answers, whether in JSON when asked to, or how many dimensions it embeds into."""
    rows = []
    for model, kind in candidates:
        row = {"model": model, "kind": kind, "ok": False, "json_mode_ok": None, "embed_dim": None, "latency_s": None, "note": ""}
        began = time.perf_counter()
        try:
            if kind == "chat":
                chat(model, False)
                row |= {"ok": True, "latency_s": time.perf_counter() - began}
                try:
                    row["json_mode_ok"] = isinstance(json.loads(chat(model, True)), dict)
                except Exception as e:  # noqa: BLE001
                    row |= {"json_mode_ok": False, "note": type(e).__name__}
            else:
                vectors = embed(model)
                row |= {"embed_dim": len(vectors[0]) if vectors else 0, "latency_s": time.perf_counter() - began}
                row["ok"] = row["embed_dim"] > 0
        except Exception as e:  # noqa: BLE001
            row["note"] = type(e).__name__
        rows.append(row)
    return rows


def in_response_order(vectors: Column) -> Column:
    """Embeddings (array of index, embedding) in the order of their index."""
    return F.transform(F.array_sort(vectors, lambda a, b: (a["index"] - b["index"]).cast("int")), lambda v: v["embedding"])


def last_writes(lines: DataFrame, key: str, order: str) -> DataFrame:
    """The last line of each key, by partial aggregation."""
    others = [c for c in lines.columns if c != key]
    return lines.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_last")).select(key, *(F.col("_last")[c].alias(c) for c in others))


def undecided(staged: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    return staged.join(decisions.select(key), key, "left_anti")


def restricted(rows: DataFrame, allowed: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(allowed.select(key), key, "left_semi")


def ledger(events: DataFrame) -> DataFrame:
    """Counters of a call ledger: calls that were made, cache hits, calls that the budget blocked, errors, tokens, retries."""
    blocked = F.coalesce(F.col("error") == BUDGET, F.lit(False))
    made = ~F.coalesce("cached", F.lit(False)) & ~blocked
    total = lambda c: F.coalesce(F.sum(F.when(made, F.col(c))), F.lit(0)).alias(c)
    return events.agg(F.count_if(made).alias("calls"), F.count_if(F.coalesce("cached", F.lit(False))).alias("cache_hits"), F.count_if(blocked).alias("blocked"), F.count_if(F.col("error").isNotNull()).alias("errors"), total("prompt_tokens"), total("completion_tokens"), total("retries_429"))


def in_blocks(events: DataFrame, run: str, order: list[Column]) -> DataFrame:
    """``events`` with ``_block``: each run in order, cut into blocks of bounded size, however long it is."""
    return cut(events.repartitionByRange(F.col(run), *order).withColumn("_block", F.spark_partition_id()))


def running(blocks: DataFrame, run: str, order: list[Column], **values: Column) -> DataFrame:
    """``blocks`` with the sums of values up to each row of its run: sums within blocks, and those of the blocks before."""
    over = Window.partitionBy(run, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(run, "_block").agg(*(F.sum(v).alias(f"_{n}") for n, v in values.items()))  # one row for each run and block
    offsets = totals.select(run, "_block", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in values))
    within = blocks.withColumns({n: F.sum(v).over(over) for n, v in values.items()})
    return within.join(offsets, [run, "_block"]).withColumns({n: F.col(n) + F.col(f"_{n}") for n in values}).drop("_block", *(f"_{n}" for n in values))


def within_budget(events: DataFrame, run: str, order: list[Column], call: Column, cap: int) -> DataFrame:
    """Adds ``calls_before`` and ``blocked``: a call is made only while fewer than ``cap`` were made in its run."""
    one = call.cast("int")
    counted = running(in_blocks(events, run, order), run, order, calls_before=one)
    return counted.withColumn("calls_before", F.col("calls_before") - one).withColumn("blocked", call & (F.col("calls_before") >= cap))


def circuit_break(events: DataFrame, run: str, order: list[Column], failed: Column, most: int = 3) -> DataFrame:
    """Adds ``place`` and ``stopped``: after ``most`` failures in a row, everything later in the run is stopped.

    Failures in a row have one number of successes before them, so they are found by aggregation.
    """
    fine = (~F.coalesce(failed, F.lit(False))).cast("int")
    placed = running(in_blocks(events.withColumn("_fine", fine), run, order), run, order, place=F.lit(1), _before=F.col("_fine"))
    streaks = placed.where("_fine = 0").groupBy(run, "_before").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where(F.col("n") >= most)
    tripped = streaks.groupBy(run).agg((F.min("first") + most - 1).alias("_tripped"))
    return placed.join(tripped, run, "left").withColumn("stopped", F.coalesce(F.col("place") > F.col("_tripped"), F.lit(False))).drop("_fine", "_before", "_tripped")


def progress_marks(events: DataFrame, run: str, order: list[Column], every: int = 25) -> DataFrame:
    """The rows at which progress is reported: each ``every``-th of a run and its last, with rows and errors so far."""
    blocks = in_blocks(events.select(run, *(c for c in events.columns if c != run)), run, order)
    placed = running(blocks, run, order, done=F.lit(1), errors=F.when(F.col("verdict") == "error", 1).otherwise(0))
    totals = blocks.groupBy(run).agg(F.count(F.lit(1)).alias("total"))
    return placed.join(totals, run).select(run, "done", "errors", "total").where((F.col("done") % every == 0) | (F.col("done") == F.col("total")))


def quota_sample(rows: DataFrame, n: int, group: str, seed: str, key: str = "id", forbidden: Column | None = None) -> DataFrame:
    """About n rows, evenly over the groups: n // groups of each and one more of the first n % groups; small groups give all.

    Within a group rows go by a hash of seed and key; the engine keeps the least n of each group before it sorts them. A forbidden row
    is an error.
    """
    if forbidden is not None:
        rows = rows.withColumn(group, F.when(forbidden, F.raise_error(F.lit("a held-out row in a sample")).cast("string")).otherwise(F.col(group)))
    groups = rows.select(group).distinct()
    many = groups.count()
    if not many or n <= 0:
        return rows.where("false")
    more = groups.orderBy(group).limit(n % many).withColumn("_more", F.lit(1))  # fewer rows than the sample has
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(seed), F.col(key))), key))).where(F.col("_place") <= n // many + 1)
    return placed.join(more, group, "left").where(F.col("_place") <= n // many + F.coalesce("_more", F.lit(0))).drop("_place", "_more")


def draft_counts(log: DataFrame) -> DataFrame:
    """Decisions by outcome and reason."""
    return log.groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("count"))


def draft_summary(ledger: DataFrame, log: DataFrame) -> DataFrame:
    """what, count: calls, calls by outcome, accepted drafts, rejected ones by reason; one row each."""
    calls = ledger.groupBy(F.concat(F.lit("outcome "), "outcome").alias("what")).agg(F.count(F.lit(1)).alias("count"))
    total = ledger.agg(F.lit("calls").alias("what"), F.count(F.lit(1)).alias("count"))
    decided = log.groupBy(F.when(F.col("decision") == "accept", "accepted").otherwise(F.concat(F.lit("rejected "), F.coalesce("reason", F.lit("")))).alias("what")).agg(F.count(F.lit(1)).alias("count"))
    return total.unionByName(calls).unionByName(decided)
