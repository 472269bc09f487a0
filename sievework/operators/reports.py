"""Whole validations of the two kinds of own records, as one table of findings.

REPORT: severity (error, warning, note, summary), rule, line_no, subject, other, value. Lines are (line_no, line) of a file of JSON
objects. Types are those of the JSON itself (a variant), so nothing is coerced; a line with a key twice counts as invalid.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut
from . import similarity, validate
from .validate import duplicate_ids

REPORT = ("severity", "rule", "line_no", "subject", "other", "value")


class Kind(NamedTuple):
    fields: tuple[str, ...]
    optional: tuple[str, ...]
    booleans: tuple[str, ...]
    types_after_keys: bool  # types are looked at only if the keys are right


SHADOWING = Kind(validate.SHADOWING_FIELDS, validate.SHADOWING_OPTIONAL, (), False)
QUOTING = Kind(validate.QUOTING_FIELDS, (), ("reviewed",), True)


def _columns(lines: DataFrame, kind: Kind) -> DataFrame:
    """line_no, v (variant), keys and the fields' values where they have their type."""
    v = lines.select("line_no", F.try_parse_json("line").alias("v"), F.json_object_keys("line").alias("keys"))
    names = kind.fields + kind.optional
    return v.select("*", *(F.try_variant_get("v", f"$.{n}", "boolean" if n in kind.booleans else "string").alias(n) for n in names), *(F.schema_of_variant(F.try_variant_get("v", f"$.{n}", "variant")).alias(f"_{n}") for n in names))


def _schema_problems(kind: Kind) -> Column:
    """rule and subject of each breach of the schema."""
    finding = lambda rule, subject: F.struct(F.lit(rule).alias("rule"), subject.alias("subject"))
    known = F.array(*map(F.lit, kind.fields + kind.optional))
    missing = F.transform(F.array_except(F.array(*map(F.lit, kind.fields)), F.col("keys")), lambda k: finding("missing_field", k))
    unknown = F.transform(F.array_except(F.col("keys"), known), lambda k: finding("unknown_field", k))
    wrong = lambda n: F.array_contains("keys", n) & ~F.coalesce(F.col(f"_{n}") == ("BOOLEAN" if n in kind.booleans else "STRING"), F.lit(False))
    types = F.array_compact(F.array(*(F.when(wrong(n), finding("wrong_type", F.lit(n))) for n in kind.fields + kind.optional)))
    keys = F.concat(missing, unknown)
    inside = F.when(F.size(keys) > 0, keys).otherwise(types) if kind.types_after_keys else F.concat(keys, types)
    whole = lambda rule: F.array(finding(rule, F.lit("")))
    return F.when(F.col("v").isNull(), whole("invalid_json")).when(F.col("keys").isNull(), whole("no_object")).otherwise(inside)


def checked(lines: DataFrame, kind: Kind, rules: list[Column]) -> DataFrame:
    """The fields' columns and found: breaches of the schema, else of the rules (a rule's subject is its message)."""
    rows = _columns(lines, kind).withColumn("_schema", _schema_problems(kind))
    ruled = F.transform(F.array_compact(F.array(*rules)), lambda m: F.struct(F.lit("rule").alias("rule"), m.alias("subject")))
    return rows.withColumn("found", F.when(F.size("_schema") > 0, F.col("_schema")).otherwise(ruled)).select("line_no", *kind.fields, *kind.optional, "found")


def records(lines: DataFrame, kind: Kind) -> DataFrame:
    """Rows of sound lines."""
    rules = validate.shadowing_rules() if kind is SHADOWING else validate.quoting_rules()
    return checked(lines, kind, rules).where(F.size("found") == 0).drop("found")


def _report(df: DataFrame, severity: str, rule: Column | str, line_no=None, subject=None, other=None, value=None) -> DataFrame:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return df.select(F.lit(severity).alias("severity"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), (F.lit(None) if line_no is None else line_no).cast("long").alias("line_no"), text(subject).alias("subject"), text(other).alias("other"), (F.lit(None) if value is None else value).cast("double").alias("value"))


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _line_errors(rows: DataFrame) -> DataFrame:
    return _report(rows.select("line_no", F.explode("found").alias("f")), "error", F.col("f.rule"), F.col("line_no"), F.col("f.subject"))


def _repeats(rows: DataFrame) -> DataFrame:
    return _report(duplicate_ids(rows, "id", "line_no"), "error", "duplicate_id", F.col("line_no"), F.col("id"), F.col("first"))


def _near(rows: DataFrame, key: str = "id") -> DataFrame:
    """Pairs that reach the threshold; those whose sets of pieces are equal are exact."""
    pairs = similarity.self_pairs(rows, key, X.collapse(F.col("text")))
    return _report(pairs, "error", F.when(F.col("score") == 1.0, "exact_duplicate").otherwise("near_duplicate"), None, F.col("id_a"), F.col("id_b"), F.col("score"))


def _counted(rows: DataFrame, rule: str, column: Column, values: tuple[str, ...] | None) -> DataFrame:
    """Counts of a summary, 0 for fixed values that are absent."""
    if values is not None:
        return _report(validate.zero_filled(rows.withColumn("_v", column), "_v", values), "summary", rule, None, F.col("value"), None, F.col("count"))
    return _report(rows.groupBy(column.alias("v")).agg(F.count(F.lit(1)).alias("n")), "summary", rule, None, F.col("v"), None, F.col("n"))


def _too_few(counts: DataFrame, bad: Column) -> DataFrame:
    return _report(counts.where(bad), "error", "size", None, None, None, F.col("n"))


def check_shadowing(lines: DataFrame) -> DataFrame:
    """REPORT of the shadowing set. Templates are checked, noted and left out; of repeated ids the first counts.

    Nulls, empty and torn lines are findings; an empty file has too few rows, and no summary. Closest pairs are looked for among those
    that reach the threshold.
    """
    rows = checked(lines, SHADOWING, validate.shadowing_rules())
    sound = rows.where(F.size("found") == 0)
    template = F.trim("technique") == validate.TEMPLATE
    mine = sound.where(~template)
    unique = validate.first_rows(mine.drop("found"), "id", "line_no")
    n = unique.agg(F.count(F.lit(1)).alias("n"))
    technique = X.collapse(F.col("technique"))
    return _all(
        _line_errors(rows), _repeats(mine), _near(unique), _too_few(n, F.col("n") < validate.MIN_N),
        _report(sound.where(template).agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "note", "templates_ignored", None, None, None, F.col("n")),
        technique_warnings(unique, technique),
        _counted(unique, "author", F.col("author"), validate.AUTHORS), _counted(unique, "technique", technique, None), _counted(unique, "length_bucket", X.length_bucket(F.col("text")), validate.BUCKETS),
        _counted(unique, "clause_position", F.col("clause_position"), validate.POSITIONS), _crosstab(unique),
    )


def technique_warnings(rows: DataFrame, technique: Column) -> DataFrame:
    """REPORT: too few different techniques, and those with too great a share."""
    few = rows.agg(F.count_distinct(technique).alias("n"), F.count(F.lit(1)).alias("all")).where((F.col("all") > 0) & (F.col("n") < validate.MIN_TECHNIQUES))
    return _all(_report(few, "warning", "few_techniques", None, None, None, F.col("n")), _report(validate.share_warnings(rows, technique, validate.MAX_TECHNIQUE_SHARE), "warning", "technique_share", None, F.col("value"), None, F.col("count")))


def _crosstab(rows: DataFrame) -> DataFrame:
    table = validate.bucket_crosstab(rows)
    long = table.select("bucket", F.explode(F.map_from_arrays(F.array(*map(F.lit, validate.POSITIONS)), F.array(*(F.col(p) for p in validate.POSITIONS)))).alias("position", "n"))
    return _report(long, "summary", "bucket_x_position", None, F.col("bucket"), F.col("position"), F.col("n"))


def check_slice(slice_name: str, lines: DataFrame, other_lines: DataFrame, attacks: DataFrame) -> DataFrame:
    """REPORT of one quoting slice (lines) against the other (other_lines) and the held-out attacks (id, text, place).

    Pairs within the slice and across both count; problems of the other slice's lines don't. Overlaps name ids, never texts.
    What several findings read is written first and what follows from counts is made in one pass, so that the plan of the report, which the driver
    holds, stays small. Pairs within and across are looked for together.
    """
    rows = cut(checked(lines, QUOTING, validate.quoting_rules()))
    sound = rows.where(F.size("found") == 0)
    template = F.col("id").startswith("TEMPLATE")
    mine = sound.where((F.col("slice") == slice_name) & ~template)
    unique = cut(validate.first_rows(mine.drop("found"), "id", "line_no"))
    rest = records(other_lines, QUOTING).where((F.col("slice") != slice_name) & ~template)
    overlaps = cut(validate.window_overlap(unique, attacks))
    frozen = slice_name == "frozen"
    errors = F.concat(F.transform("found", lambda f: F.struct(f["rule"].alias("rule"), f["subject"].alias("subject"), F.lit(None).cast("string").alias("other"))), F.when((F.size("found") == 0) & (F.col("slice") != slice_name), F.array(F.struct(F.lit("other_slice").alias("rule"), F.col("id").alias("subject"), F.col("slice").alias("other")))).otherwise(F.array()))
    return _all(
        _report(rows.select("line_no", F.explode(errors).alias("f")), "error", F.col("f.rule"), F.col("line_no"), F.col("f.subject"), F.col("f.other")), cut(_repeats(mine)), cut(_near_slices(unique, rest)),
        _report(overlaps, "error", "overlap", None, F.col("row_id"), F.col("attack_id")),
        *([_report(unique.where(~F.col("reviewed")), "error", "not_reviewed", F.col("line_no"), F.col("id"))] if frozen else []),
        cut(_report(sound.where((F.col("slice") == slice_name) & template).agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "note", "templates_ignored", None, None, None, F.col("n"))),
        cut(_slice_figures(unique, frozen)),
    )


def _near_slices(mine: DataFrame, rest: DataFrame) -> DataFrame:
    """REPORT of the pairs within a slice and across to the other, whose own pairs don't count. Ids of either are told apart by a letter before them."""
    both = mine.select(F.concat(F.lit("m"), "id").alias("id"), "text").unionByName(rest.select(F.concat(F.lit("r"), "id").alias("id"), "text"))
    pairs = similarity.self_pairs(both, "id", X.collapse(F.col("text"))).where(F.startswith("id_a", F.lit("m")))
    kind = F.concat(F.when(F.col("score") == 1.0, "exact_duplicate").otherwise("near_duplicate"), F.when(F.startswith("id_b", F.lit("m")), "").otherwise("_across"))
    return _report(pairs, "error", kind, None, F.substr("id_a", F.lit(2)), F.substr("id_b", F.lit(2)), F.col("score"))


def _slice_figures(rows: DataFrame, frozen: bool) -> DataFrame:
    """REPORT of what follows from counts of sound rows: size, shares that are out of range, and the summary, 0 for values that are absent."""
    values = {"author": validate.QUOTING_AUTHORS, "source_type": validate.SOURCE_TYPES, "form": validate.FORMS, "channel": validate.CHANNELS, "reviewed": ("true", "false")}
    name = {(c, v): f"{c}_{k}" for c, known in values.items() for k, v in enumerate(known)}
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).cast("string") == v).alias(x) for (c, v), x in name.items()))
    n, many = F.col("n"), lambda c, v: F.col(name[c, v])
    finding = lambda severity, rule, subject, value: F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(None).cast("long").alias("line_no"), F.lit(subject).cast("string").alias("subject"), F.lit(None).cast("string").alias("other"), value.cast("double").alias("value"))
    verbatim, human = many("form", "verbatim_quote"), many("author", "human")
    found = [
        F.when(n != validate.FROZEN_N if frozen else ~n.between(*validate.DEV_RANGE), finding("error", "size", None, n)),
        *(F.when(many("source_type", v) / F.greatest(n, F.lit(1)) > validate.MAX_SOURCE_SHARE, finding("warning", "source_share", v, many("source_type", v))) for v in validate.SOURCE_TYPES),
        F.when((n > 0) & ~(verbatim / F.greatest(n, F.lit(1))).between(*validate.VERBATIM_RANGE), finding("warning", "verbatim_share", None, verbatim)),
        F.when((n > 0) & (human * 3 < n), finding("warning", "human_share", None, human)),
        *(finding("summary", c, v, F.col(x)) for (c, v), x in name.items()),
    ]
    return counts.select(F.inline(F.array_compact(F.array(*found))))
