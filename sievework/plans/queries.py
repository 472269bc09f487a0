"""Queries of the operators over the project's tables. sql.py says in SQL what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import replies, stats
from ..functions import text as X
from ..operators import calls, drafts, frozen, gates, manifest, reports, scoring, similarity, validate
from ..session import cut, table
from ..sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
EVENT = ("run_id", "id", "family", "channel", "label", "verdict", "cached", "error", "prompt_tokens", "completion_tokens", "retries_429", "latency_s", "logged_at")
ORDER = ("logged_at", "id", "verdict", "latency_s", "prompt_tokens")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Items, each id once: rows delivered twice are equal but for nothing."""
    return table(spark, folder, "item").dropDuplicates(["id"])


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Run events, those sent again once with their first arrival."""
    return table(spark, folder, "run_event").groupBy(*EVENT).agg(F.min("arrived_at").alias("arrived_at"))


def quoting(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "quoting_dev").unionByName(table(spark, folder, "quoting_frozen")).dropDuplicates(["id"])


def shadowing(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "shadowing").dropDuplicates(["id"])


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of attacks, and of quoting rows, whose stand-in verdict is attack where they weren't reviewed."""
    authors = items(spark, folder).select("id", "author")
    attacks = events(spark, folder).join(authors, "id", "left").select("id", "family", "channel", "label", F.coalesce("author", F.lit("?")).alias("author"), "verdict")
    benign = quoting(spark, folder).select(
        F.concat(F.lit("quoting/"), "id").alias("id"), F.lit("quoting").alias("family"), "channel", F.lit("benign").alias("label"), F.coalesce("author", F.lit("?")).alias("author"),
        F.when(F.col("reviewed").isNull(), "error").when(F.col("reviewed"), "benign").otherwise("attack").alias("verdict"),
    )
    return attacks.unionByName(benign)


def _frozen_gate(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The last event of each held-out item, by family, and the frozen quoting rows."""
    last = calls.last_writes(events(spark, folder).where(F.col("family").isin(*manifest.HELD_OUT)).select("id", "family", "channel", "label", "verdict", F.struct(*ORDER).alias("at")), "id", "at")
    families = scoring.counts_by(last.withColumn("author", F.lit("")), "attack", F.col("family"), "family")
    frozen = table(spark, folder, "quoting_frozen").agg(F.count_if(~F.col("reviewed")).alias("hits"), F.count(F.lit(1)).alias("total"))
    return families, frozen


def _order() -> list:
    return [F.col(c).asc_nulls_first() for c in ORDER]


# sources and sinks


def union_items_repeated_ids(spark, folder):
    own = files.own_items(shadowing(spark, folder))
    return files.repeated_ids(files.union_items(table(spark, folder, "item"), own))


def own_items(spark, folder):
    return files.own_items(shadowing(spark, folder)).select("id", "family", "channel", "label", "author", "text")


def split_by_key(spark, folder):
    rows = items(spark, folder).where("source = 'mcptox'").select("id", F.initcap(F.replace(F.split_part("family", F.lit("_"), F.lit(2)), F.lit("t"), F.lit("Template-"))).alias("paradigm"), "text")
    dev = items(spark, folder).where(~F.col("family").isin(*manifest.HELD_OUT))
    return files.split_by_key(rows, dev)[0].select("id", "paradigm")


def split_by_key_counts(spark, folder):
    rows = items(spark, folder).where("source = 'mcptox'").select("id", F.initcap(F.replace(F.split_part("family", F.lit("_"), F.lit(2)), F.lit("t"), F.lit("Template-"))).alias("paradigm"), "text")
    return files.split_by_key(rows, items(spark, folder))[1]


def event_json(spark, folder):
    return sinks.as_json(events(spark, folder).select("run_id", "id", "verdict", "cached", "error", "prompt_tokens"))


# projections and scalar functions


def split_assignment(spark, folder):
    return items(spark, folder).select("id", manifest.split_of(F.col("family")).alias("split"))


def held_out_items(spark, folder):
    return items(spark, folder).where(F.col("family").isin(*manifest.HELD_OUT)).select("id", "family")


def normalized_items(spark, folder):
    return items(spark, folder).select("id", X.normalize(F.col("text")).alias("text"))


def run_items(spark, folder):
    attacks = items(spark, folder).where(F.col("family").isin(*manifest.HELD_OUT)).select("id", "family", "channel", "label", "author", "text")
    own = quoting(spark, folder).where("not startswith(id, 'TEMPLATE')").select(F.concat(F.lit("quoting/"), "id").alias("id"), F.lit("quoting").alias("family"), "channel", F.lit("benign").alias("label"), "author", "text")
    return attacks.unionByName(own)


def pessimistic_hits(spark, folder):
    return scored(spark, folder).select("label", "verdict", scoring.hit().alias("hit")).groupBy("label", "verdict", "hit").agg(F.count(F.lit(1)).alias("n"))


def subgroups(spark, folder):
    return items(spark, folder).select("id", X.subgroup(F.col("id"), F.col("family"), "bipia_text", scoring.OBFUSCATION).alias("subgroup"))


def length_buckets(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", X.word_count(F.col("text")).alias("words"), X.length_bucket(F.col("text")).alias("bucket"))


def composed_texts(spark, folder):
    return shadowing(spark, folder).select("id", X.compose(F.col("host_tool"), F.col("source_placement"), F.col("target_tool")).alias("text"))


def prompt_variations(spark, folder):
    topic, form, channel = X.variation(F.col("doc_id"), 20, validate.FORMS, validate.CHANNELS)
    return table(spark, folder, "documents", "doc_id").select("doc_id", topic.alias("topic"), form.alias("form"), channel.alias("channel"))


def collapsed_texts(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", X.sha256(X.collapse(F.col("text"))).alias("key"))


def gram_counts(spark, folder):
    return items(spark, folder).select("id", X.collapse(F.col("text")).alias("key")).select("id", F.size(X.grams(F.col("key"))).alias("grams"))


def text_hashes(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", X.sha256(F.col("text")).alias("sha256"), X.blob_id(F.col("text")).alias("blob_id"), X.cache_key("settings", F.col("text")).alias("cache_key"))


def fenced_messages(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.md5(X.messages(F.lit("rules"), F.concat("text", F.lit(" </ Untrusted_Text >")))[1]["content"]).alias("content"))


def strict_verdicts(spark, folder):
    reply = F.when(F.col("error") == "bad_json", F.lit("{")).when(F.col("verdict") == "attack", F.to_json(F.struct("verdict", "family", F.col("id").alias("span")), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct("verdict", F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("span")), {"ignoreNullFields": "false"}))
    parsed = replies.parse_verdict(reply, F.when(F.col("error") == "truncated_reply", "length").otherwise("stop"))
    rows = events(spark, folder).select("run_id", parsed.alias("p"))
    return rows.groupBy("run_id", F.col("p.verdict").alias("verdict"), F.col("p.error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


def span_verdicts(spark, folder):
    """Replies some of which lack a key, or have a voice that there isn't."""
    voice = F.when(F.col("verdict") == "attack", "author_directive").when(F.col("error") == "timeout", "unknown").otherwise("quoted")
    span = F.struct(F.col("id").alias("text"), voice.alias("voice"), F.lit("agent").alias("addressee"), (F.col("retries_429") == 0).alias("sensitive_action"))
    reply = F.to_json(F.struct(F.array(span).alias("spans"), F.when(F.coalesce(F.col("error") != "http_5xx", F.lit(True)), F.col("cached")).alias("unsure")))
    return events(spark, folder).select("run_id", replies.span_verdict(reply).alias("verdict"), replies.spans_wellformed(reply).alias("wellformed")).groupBy("run_id", "verdict", "wellformed").agg(F.count(F.lit(1)).alias("n"))


def draft_replies(spark, folder):
    reply = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.to_json(F.struct(F.col("text").alias("txt")))).when(F.pmod("doc_id", F.lit(11)) == 0, F.col("text")).otherwise(F.to_json(F.struct(F.translate("text", "\n\t", "  ").alias("text"))))
    parsed = replies.parse_draft(reply, F.lit("stop"))
    rows = table(spark, folder, "documents", "doc_id", "text").where("text is not null and text <> ''")
    return rows.select("doc_id", parsed.alias("p")).select("doc_id", F.length("p.text").alias("chars"), F.when(F.col("p.error").like("text length%"), "text length").otherwise(F.col("p.error")).alias("error"))


def name_patterns(spark, folder):
    return shadowing(spark, folder).select("id", X.is_snake_case(F.col("technique")).alias("snake_case"), X.is_commit_id(F.sha1("id")).alias("commit_id"), X.script_safe(F.struct(F.concat(F.lit("<"), "technique").alias("t"))).alias("json"), X.scrubbed(F.col("text"), "tool").alias("scrubbed"))


# joins


def near_pairs(spark, folder):
    return similarity.self_pairs(items(spark, folder), "id", X.collapse(F.col("text")))


def closest_pairs(spark, folder):
    return similarity.closest_rows(table(spark, folder, "item", "id", "text"), "id", X.collapse(F.col("text")))


def leakage_pairs(spark, folder):
    rows = items(spark, folder)
    held = F.col("family").isin(*manifest.HELD_OUT)
    return similarity.cross_pairs(rows.where(~held), rows.where(held), "id", X.collapse(F.col("text"))).withColumnsRenamed({"left_id": "dev_id", "right_id": "frozen_id"})


def greedy_dedupe(spark, folder):
    return similarity.greedy(table(spark, folder, "item", "id", "text", "family"), X.collapse(F.col("text")), F.col("family").isin(*manifest.HELD_OUT))


def exact_dedupe(spark, folder):
    return similarity.exact_duplicates(table(spark, folder, "documents", "doc_id", "text"), "doc_id", X.collapse(F.col("text")))


def dedupe_pipeline(spark, folder):
    """The whole of it: normalized, deduplicated, split; per family what is left."""
    rows = cut(items(spark, folder).select("id", "family"))
    kept = similarity.greedy(table(spark, folder, "item", "id", "text", "family"), X.collapse(X.normalize(F.col("text"))), F.col("family").isin(*manifest.HELD_OUT)).where("kept")
    return manifest.family_table(rows, rows.join(kept.select("id"), "id", "left_semi"))


def window_overlap(spark, folder):
    attacks = table(spark, folder, "quoting_frozen", "id", "text").withColumn("place", F.col("id"))
    return validate.window_overlap(table(spark, folder, "documents", F.col("doc_id").alias("id"), "text"), attacks)


def manifest_rows(spark, folder):
    return manifest.manifest(items(spark, folder))


def manifest_differences(spark, folder):
    """Against a copy in which some rows are missing, new or changed."""
    fresh = manifest.manifest(items(spark, folder))
    n = F.length("id") % 11
    stored = fresh.where(n != 0).withColumn("id", F.when(n == 1, F.concat("id", F.lit("+"))).otherwise(F.col("id"))).withColumn("sha256", F.when(n == 2, F.lit("0")).otherwise(F.col("sha256"))).withColumn("label", F.when(n == 3, F.lit("benign")).otherwise(F.col("label")))
    return manifest.differences(stored, fresh)


def pending_drafts(spark, folder):
    return calls.undecided(quoting(spark, folder).where("slice = 'dev'").select("id", "source_type"), table(spark, folder, "review_log", "id"))


def accepted_drafts(spark, folder):
    return calls.restricted(quoting(spark, folder).select("id", "source_type"), table(spark, folder, "review_log").where("decision = 'accept'"))


def cache_lookup(spark, folder):
    cache = calls.last_writes(events(spark, folder).where("cached").select(F.col("id").alias("key"), "verdict", F.struct(*ORDER).alias("at")), "key", "at")
    rows = items(spark, folder).select(F.col("id").alias("key"), "text")
    return calls.with_cache(rows, cache, lambda t: ("attack" if len(t) % 2 else "benign", None)).select("key", "verdict", "cached")


def author_lookup(spark, folder):
    return scored(spark, folder).groupBy("author", "label").agg(F.count(F.lit(1)).alias("n"))


def label_lookup(spark, folder):
    labels = table(spark, folder, "technique_label", F.col("title").alias("technique"), "label")
    return shadowing(spark, folder).select("id", "technique").join(labels, "technique", "left").select("id", F.coalesce("label", "technique").alias("label"))


def run_agreement(spark, folder):
    return scoring.run_agreement(events(spark, folder).select("id", "run_id", F.struct(*ORDER).alias("logged_at"), "verdict", "family"))


# aggregations and gates


def counts_by_family(spark, folder):
    return scoring.with_intervals(scoring.counts_by(scored(spark, folder), "attack", F.col("family"), "family"))


def counts_by_channel(spark, folder):
    return scoring.counts_by(scored(spark, folder), "benign", F.col("channel"), "channel")


def all_breakdowns(spark, folder):
    return scoring.breakdown(scored(spark, folder))


def run_validity(spark, folder):
    return scoring.error_stats(scored(spark, folder))


def verdict_conventions(spark, folder):
    return scoring.conventions(scoring.verdict_cells(scored(spark, folder), "channel", "label"))


def grouped_cells(spark, folder):
    return scoring.grouped_cells(scored(spark, folder))


def run_summary(spark, folder):
    return scoring.run_summary(events(spark, folder))


def call_ledger(spark, folder):
    return calls.ledger(events(spark, folder))


def draft_counts(spark, folder):
    return calls.draft_counts(table(spark, folder, "review_log").groupBy("id", "slice", "decision", "reason", "decided_at").agg(F.min("arrived_at").alias("arrived_at")))


def family_table(spark, folder):
    rows = items(spark, folder)
    return manifest.family_table(rows, rows.where("channel is not null and length(text) > 200"))


def source_type_counts(spark, folder):
    return validate.zero_filled(quoting(spark, folder).where("slice = 'dev'"), "source_type", validate.SOURCE_TYPES)


def bucket_crosstab(spark, folder):
    return validate.bucket_crosstab(shadowing(spark, folder).where("technique is distinct from 'TEMPLATE'"))


def author_counts(spark, folder):
    return items(spark, folder).where("family = 'shadowing'").groupBy("author").agg(F.count(F.lit(1)).alias("n"))


def distinct_families(spark, folder):
    return items(spark, folder).agg(F.count_distinct("family").alias("families"), F.count_distinct(F.when(F.col("family").isin(*manifest.HELD_OUT), F.col("family"))).alias("held_out"), (F.array_sort(F.collect_set(F.when(F.col("family").isin(*manifest.HELD_OUT), F.col("family")))) == F.array(*map(F.lit, sorted(manifest.HELD_OUT)))).alias("complete"))


def wilson_bounds(spark, folder):
    counts = scoring.counts_by(scored(spark, folder), "attack", F.col("family"), "family")
    return counts.select("family", stats.wilson_upper(F.col("total") - F.col("hits"), F.col("total")).alias("upper"), stats.percent_label(F.col("hits"), F.col("total")).alias("share"))


def kill_rule(spark, folder):
    return gates.kill_rule(*_frozen_gate(spark, folder)).select("fp_flagged", "fp_n", "fp_upper", "average", "average_pass", F.concat_ws(",", "floor_failures").alias("floor_failures"), "fp_pass", "floor_pass", "passed")


def _arms(spark, folder):
    runs = events(spark, folder).select(F.col("run_id").alias("arm"), "channel", "label", "verdict")
    benign = quoting(spark, folder).select(F.lit("run-00001").alias("arm"), "channel", F.lit("benign").alias("label"), F.when(F.col("reviewed"), "benign").otherwise("attack").alias("verdict"))
    return scoring.conventions(scoring.verdict_cells(runs.unionByName(benign), "arm", "channel", "label"))


def dev_bar(spark, folder):
    return gates.dev_bar(_arms(spark, folder))


def arm_selection(spark, folder):
    return gates.select_arm(gates.dev_bar(_arms(spark, folder)))


# order-dependent operators


def duplicate_rows(spark, folder):
    rows = table(spark, folder, "run_event", "run_id", "id", "logged_at").select("id", F.unix_micros("logged_at").alias("at")).distinct()
    return validate.duplicate_ids(rows, "id", "at")


def first_events(spark, folder):
    rows = events(spark, folder).select("id", "verdict", F.struct(*ORDER).alias("at"))
    return validate.first_rows(rows, "id", "at").select("id", "verdict")


def last_verdicts(spark, folder):
    return calls.last_writes(events(spark, folder).select("id", "verdict", F.struct(*ORDER).alias("at")), "id", "at").select("id", "verdict")


def quota_sample(spark, folder):
    return calls.quota_sample(items(spark, folder).where(~F.col("family").isin(*manifest.HELD_OUT)).select("id", "family"), 50, "family", "seed")


def circuit_breaker(spark, folder):
    out = calls.circuit_break(events(spark, folder), "run_id", _order(), F.col("error").isNotNull())
    return out.groupBy("run_id").agg(F.count_if("stopped").alias("stopped"), F.count(F.lit(1)).alias("n"))


def budget_block(spark, folder):
    out = calls.within_budget(events(spark, folder), "run_id", _order(), ~F.col("cached"), 1_100)
    return out.groupBy("run_id").agg(F.count_if("blocked").alias("blocked"), F.max("calls_before").alias("calls_before"))


def progress_marks(spark, folder):
    return calls.progress_marks(events(spark, folder), "run_id", _order())


# validators


def shadowing_problems(spark, folder):
    return validate.problems(shadowing(spark, folder), "id", *validate.shadowing_rules())


def quoting_problems(spark, folder):
    return validate.problems(quoting(spark, folder), "id", *validate.quoting_rules())


def technique_warnings(spark, folder):
    return validate.share_warnings(shadowing(spark, folder).where("technique is distinct from 'TEMPLATE'"), F.lower(F.trim(F.coalesce("technique", F.lit("")))), validate.MAX_TECHNIQUE_SHARE)


def slice_warnings(spark, folder):
    return validate.slice_warnings(quoting(spark, folder))


def json_key_problems(spark, folder):
    lines = table(spark, folder, "events", F.col("event_id").alias("line_no"), F.col("props").alias("line"))
    return validate.key_problems(lines, "line", ("missing",), ("other",))


def record_key_problems(spark, folder):
    """Objects that lack the keys of which a row has null."""
    rows = shadowing(spark, folder)
    lines = rows.select(F.col("id").alias("line_no"), F.to_json(F.struct("id", "technique", "source_placement", F.col("author").alias("writer"))).alias("line"))
    return validate.key_problems(lines, "line", ("id", "technique", "author"), ("source_placement",))


def embedding_dims(spark, folder):
    return table(spark, folder, "embeddings").groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"))


def embedding_order(spark, folder):
    """Vectors of each label put into the order of their index."""
    vectors = table(spark, folder, "embeddings").groupBy("label").agg(F.collect_list(F.struct(F.col("vec_id").alias("index"), F.col("embedding"))).alias("v"))
    return vectors.select("label", F.posexplode(calls.in_response_order(F.col("v"))).alias("place", "embedding")).select("label", "place", F.col("embedding")[0].cast("double").alias("first"))


def _lines(df: DataFrame) -> DataFrame:
    """Rows as JSON objects, numbered by a hash of their id; nulls are keys that lack."""
    number = F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("long")
    return df.select(number.alias("line_no"), F.to_json(F.struct(*df.columns)).alias("line"))


def _file_lines(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All rows of a table as JSON objects, numbered from 1 by their place in its files, in the order of the files' paths; nulls are keys that lack."""
    df = table(spark, folder, name)
    rows = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.to_json(F.struct(*df.columns)).alias("line"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files_before = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", before.alias("before"))
    return rows.join(F.broadcast(files_before), "path").select((F.col("before") + F.col("at") + 1).alias("line_no"), "line")  # one row for each file is sent


def check_shadowing(spark, folder):
    return reports.check_shadowing(_lines(shadowing(spark, folder)))


def check_slice(spark, folder):
    """Rows delivered twice are lines as any others, so that they are found as repeated ids."""
    held = items(spark, folder).where(F.col("family").isin(*manifest.HELD_OUT)).select("id", "text", F.col("id").alias("place"))
    return reports.check_slice("dev", _file_lines(spark, folder, "quoting_dev"), _file_lines(spark, folder, "quoting_frozen"), held)


def _frozen_scored(spark, folder):
    """The last event of each held-out item and the frozen quoting rows."""
    authors = items(spark, folder).select("id", "author")
    last = calls.last_writes(events(spark, folder).where(F.col("family").isin(*manifest.HELD_OUT)).select("id", "family", "channel", "label", "verdict", F.struct(*ORDER).alias("at")), "id", "at")
    attacks = last.join(authors, "id", "left").select("id", "family", "channel", "label", F.coalesce("author", F.lit("")).alias("author"), "verdict")
    benign = table(spark, folder, "quoting_frozen").select(F.concat(F.lit("quoting/"), "id").alias("id"), F.lit("quoting").alias("family"), "channel", F.lit("benign").alias("label"), "author", F.when(F.col("reviewed"), "benign").otherwise("attack").alias("verdict"))
    return attacks.unionByName(benign)


def evaluate_frozen(spark, folder):
    out = frozen.evaluate(_frozen_scored(spark, folder))
    return out.select("errors", "n", "valid", "fp_flagged", "fp_n", "fp_upper", "average", "fp_pass", "average_pass", "floor_pass", "passed", F.concat_ws(",", F.transform("families", lambda f: F.concat_ws(":", f["family"], f["hits"], f["total"]))).alias("families"))


def frozen_breakdowns(spark, folder):
    return frozen.breakdowns(_frozen_scored(spark, folder))


def drop_reasons(spark, folder):
    return manifest.drop_reasons(items(spark, folder), greedy_dedupe(spark, folder))


def manifest_in_order(spark, folder):
    return manifest.in_order(manifest.manifest(items(spark, folder)))


def parse_failures(spark, folder):
    """Errors taken for unsure verdicts, those that were cut short as declared ones."""
    unsure = F.col("verdict") == "error"
    rows = events(spark, folder).select("channel", "label", F.when(unsure, "unsure").otherwise(F.col("verdict")).alias("verdict"), F.when(unsure & (F.col("error") == "truncated_reply"), "declared").alias("unsure_kind"))
    return scoring.parse_failures(rows, "channel", "label")


def caps_exceeded(spark, folder):
    rows = quoting(spark, folder)
    return drafts.over_caps(rows.where("slice = 'dev'").select("source_type"), rows.where("slice = 'frozen'").groupBy("source_type").agg(F.count(F.lit(1)).alias("n")))


def draft_numbers(spark, folder):
    rows = quoting(spark, folder)
    return drafts.numbered(rows.where("slice = 'frozen'").select("id", "source_type"), rows.where("slice = 'dev'").select("source_type"), F.col("id")).select("id", "source_type", "k")


def new_drafts(spark, folder):
    rows = quoting(spark, folder)
    place = F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("long")
    return drafts.new_drafts(rows.where("slice = 'dev'").select("id", "text", place.alias("place")), rows.where("slice = 'frozen'").select("id", "text"), "place")


def _decisions(spark, folder):
    return table(spark, folder, "review_log", "id", "decision", "reason").distinct()


def review_batch(spark, folder):
    rows = quoting(spark, folder)
    pending = rows.where("slice = 'dev' and source_type <> 'docs'").select("id", "slice")
    return drafts.batch_problems(_decisions(spark, folder), pending, drafts.slice_counts(rows), ("too_short", "off_topic"))


def draft_summary(spark, folder):
    calls_made = quoting(spark, folder).select(F.when(F.col("reviewed"), "kept").otherwise("failed").alias("outcome"))
    return calls.draft_summary(calls_made, _decisions(spark, folder))


def slice_counts(spark, folder):
    return drafts.slice_counts(quoting(spark, folder))


def composed_problems(spark, folder):
    """Against committed texts of which some are missing or other."""
    rows = shadowing(spark, folder).select("id", F.col("host_tool").alias("host_description"), F.col("source_placement").alias("fenced_block"), F.col("target_tool").alias("clause"))
    n = F.length("clause") % 5
    committed = rows.where(n != 0).select("id", F.when(n == 1, F.col("clause")).otherwise(X.compose(F.col("host_description"), F.col("fenced_block"), F.col("clause"))).alias("text"))
    return drafts.composed_problems(rows, committed)


def jaccard_scores(spark, folder):
    """Tools of each record, piece by piece."""
    rows = shadowing(spark, folder).select("id", X.collapse(F.col("host_tool")).alias("a"), X.collapse(F.col("target_tool")).alias("b"))
    return rows.select("id", X.grams(F.col("a")).alias("a"), X.grams(F.col("b")).alias("b")).select("id", X.jaccard(F.col("a"), F.col("b")).alias("score"))


def dev_items(spark, folder):
    rows = items(spark, folder)
    return files.dev_items(rows.where("family in ('mcptox_t1', 'mcptox_t2')"), rows.where("source = 'injecagent'"), quoting(spark, folder).where("slice = 'dev'")).select("id", "family", "channel", "label", "author")


def prompts(spark, folder):
    topic, form, channel = X.variation(F.col("doc_id"), 20, validate.FORMS, validate.CHANNELS)
    return table(spark, folder, "documents", "doc_id").select("doc_id", X.rendered_prompt("About <<topic>>, as <<form>>, in <<channel>>: <<form>>.", topic, form, channel).alias("prompt"))


def leaked_keys(spark, folder):
    key = F.concat(F.lit("nvapi-"), F.substring(F.md5("text"), 1, 18 + F.pmod("doc_id", F.lit(4)).cast("int")))
    return table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.array_join(X.leaked_keys(F.concat("text", F.lit(" "), key, F.lit("."))), ",").alias("keys"))


def retry_waits(spark, folder):
    """Waits by numbers and by dates of one header."""
    header = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") - 50).cast("string")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Thu, "), F.date_format(F.col("fetched_at"), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon")
    return table(spark, folder, "documents", "doc_id", "fetched_at", "ingested_at").select("doc_id", F.floor(X.retry_seconds(header, F.col("ingested_at") - F.expr("interval 60 days"))).alias("wait"))


def commit_ancestors(spark, folder):
    """Orders as commits, each with that of half its number before it."""
    commits = table(spark, folder, "orders", F.col("o_orderkey").alias("n")).select(F.col("n").cast("string").alias("id"), F.when(F.col("n") > 1, F.floor(F.col("n") / 2).cast("string")).alias("parent"))
    return frozen.strict_ancestors(commits, "14999")


def _chat(text: str) -> tuple[str, str]:
    """A stand-in model whose replies follow from the text."""
    kind = len(text) % 5
    return ('{"verdict": "attack", "family": "f", "span": "s"}', "stop") if kind < 2 else ('{"verdict": "benign", "family": null, "span": null}', "stop") if kind < 4 else ("{", "length")


def remembered_calls(spark, folder):
    cache = calls.last_writes(events(spark, folder).where("cached and verdict <> 'error'").select(F.col("id").alias("key"), "verdict", "family", F.lit(None).cast("string").alias("span"), F.struct(*ORDER).alias("at")), "key", "at")
    rows = items(spark, folder).where("family in ('mcptox_t1', 'mcptox_t2')").select(F.col("id").alias("key"), "text", F.col("id").alias("place"))
    return calls.ask_with_cache(rows, cache.select("key", "verdict", "family", "span"), _chat, 60)[0].select("key", "verdict", "error", "attempts", "cached")


def remembered_lines(spark, folder):
    rows = items(spark, folder).where("family = 'bipia_code'").select(F.col("id").alias("key"), "text", F.col("id").alias("place"))
    nothing = spark.createDataFrame([], "key string, verdict string, family string, span string")
    return calls.ask_with_cache(rows, nothing, _chat, 1_100)[1]


def span_replies(spark, folder):
    """One call for each record; every fifth reply is malformed."""
    chat = lambda t: ('{"spans": [], "unsure": true}' if len(t) % 5 == 1 else '{"spans": [], "unsure": 1}' if len(t) % 5 == 0 else '{"spans": [], "unsure": false}', "stop")
    rows = shadowing(spark, folder).where("text is not null").select("id", "text")
    return calls.ask_spans(rows, chat).select("id", "verdict", F.col("error").alias("unsure_kind"))


def repeated_runs(spark, folder):
    rows = shadowing(spark, folder).where("text is not null").select("id", "text")
    out = calls.repeated_runs(rows, 3, lambda t: ("attack" if len(t) % 2 else "benign", None))
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("verdict").alias("verdicts"))


_NOT_QUERIES = {"items", "events", "quoting", "shadowing", "scored", "table", "queries"}


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in _NOT_QUERIES}
