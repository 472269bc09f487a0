"""Scans of the collection's files: nested JSON collections, strict and tolerant JSON lines, protocols, verified raw files.

Collections that are one JSON document keep positions, so they are read as one value per file; JSON lines are read by line.
"""

from __future__ import annotations

import hashlib
import os
import tomllib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, blob_id, normalize
from ..session import exists

ITEM = "id string, source string, family string, channel string, label string, text string, author string"
# Families of the template collection's three variants, and the four variants of the record collection.
PARADIGMS = {"Template-1": "mcptox_t1", "Template-2": "mcptox_t2", "Template-3": "mcptox_t3"}
VARIANTS = ("dh_base", "dh_enhanced", "ds_base", "ds_enhanced")
# Sections and keys of a protocol, with their kinds.
PROTOCOL = {
    "classifier": {"prompt_path": str, "prompt_sha256": str, "model": str, "endpoint": str, "max_tokens": int, "temperature": float, "extra_body": dict},
    "measurement": {"verdict_rule": str, "error_scoring": str, "normalizer_version": int},
}


class LoadError(ValueError):
    """A file is missing, or isn't what it should be."""


def whole(spark: SparkSession, *paths: str) -> DataFrame:
    """path, value: each file as one text."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise LoadError(f"{missing[0]} not found")
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _parsed(files: DataFrame, schema: str) -> DataFrame:
    """path, v: files parsed; one that isn't JSON, or not of the form, is a LoadError that names it."""
    sound = F.try_parse_json("value").isNotNull()
    bad = files.where(~sound).select("path").first()
    if bad:
        raise LoadError(f"{bad.path} is not valid JSON")
    return files.select("path", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("v"))


def _items(df: DataFrame, **columns) -> DataFrame:
    given = {"author": F.lit("")} | columns
    return df.select(*(given[c.split()[0]].alias(c.split()[0]) for c in ITEM.split(", ")))


def template_collection(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects whose keys are row ids: {"id": {"paradigm", "tool_content"}}; an unknown paradigm is an error."""
    rows = _parsed(whole(spark, path), "array<map<string,struct<paradigm:string,tool_content:string>>>")
    rows = rows.select(F.explode("v").alias("block")).select(F.explode("block").alias("key", "rec"))
    family = F.element_at(F.create_map(*(F.lit(x) for kv in PARADIGMS.items() for x in kv)), F.col("rec.paradigm"))
    family = F.coalesce(family, F.raise_error(F.concat(F.lit("unknown paradigm of entry "), "key")).cast("string"))
    return _items(rows, id=F.concat(F.lit("mcptox/"), "key"), source=F.lit("mcptox"), family=family, channel=F.lit("tool_description"), label=F.lit("attack"), text=F.col("rec.tool_content"))


def category_collection(spark: SparkSession, folder: str) -> DataFrame:
    """Four files {kind}_attack_{split}.json, each {category: [text, ...]}; the position in the list is part of the id."""
    rows = _parsed(whole(spark, *(f"{folder}/{k}_attack_{s}.json" for k in ("code", "text") for s in ("train", "test"))), "map<string,array<string>>")
    name = F.regexp_extract("path", r"([a-z]+)_attack_([a-z]+)\.json", 0)
    rows = rows.select(F.split_part(name, F.lit("_"), F.lit(1)).alias("kind"), F.regexp_extract(name, r"_([a-z]+)\.json", 1).alias("split"), F.explode("v").alias("category", "texts"))
    rows = rows.select("kind", "split", "category", F.posexplode("texts").alias("n", "text"))
    return _items(rows, id=F.concat_ws("/", F.lit("bipia"), "kind", "split", "category", F.col("n").cast("string")), source=F.lit("bipia"), family=F.concat(F.lit("bipia_"), "kind"), channel=F.lit("tool_result"), label=F.lit("attack"), text=F.col("text"))


def record_collection(spark: SparkSession, folder: str) -> DataFrame:
    """Four variants, each an array of records with a tool response; ids by position."""
    rows = _parsed(whole(spark, *(f"{folder}/test_cases_{v}.json" for v in VARIANTS)), "array<struct<`Tool Response`:string>>")
    rows = rows.select(F.regexp_extract("path", r"test_cases_([a-z_]+)\.json", 1).alias("variant"), F.posexplode("v").alias("n", "rec"))
    return _items(rows, id=F.concat_ws("/", F.lit("injecagent"), "variant", F.col("n").cast("string")), source=F.lit("injecagent"), family=F.concat(F.lit("injecagent_"), "variant"), channel=F.lit("tool_result"), label=F.lit("attack"), text=F.col("rec.`Tool Response`"))


def own_items(shadowing: DataFrame) -> DataFrame:
    """Items of validated own records; templates are no items."""
    rows = shadowing.where(F.trim(F.coalesce("technique", F.lit(""))) != "TEMPLATE")
    return _items(rows, id=F.concat(F.lit("own/shadowing/"), "id"), source=F.lit("own"), family=F.lit("shadowing"), channel=F.lit("tool_description"), label=F.lit("attack"), text=F.col("text"), author=F.col("author"))


def union_items(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeated_ids(items: DataFrame) -> DataFrame:
    """id, count of the ids that more than one row has; a strict load is refused if there are any."""
    return items.groupBy("id").agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1), line: lines are split at line feeds only, carriage returns at their ends and blank lines are dropped.

    Files of any size are read in splits: a line's number is its place in its split and the number of lines of the splits before.
    """
    if not exists(spark, path):
        raise LoadError(f"{path} not found")
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("path", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(splits.select("path", "split", "first", before.alias("before")), ["path", "split"])
    line = F.regexp_replace("value", r"\r+$", "")
    return placed.select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), line.alias("line")).where(F.length(F.regexp_replace("line", SPACE, "")) > 0)


def tolerant_lines(spark: SparkSession, path: str, schema: str, required: str) -> DataFrame:
    """Parsed lines; torn and foreign ones are skipped; a missing file has none."""
    empty = spark.createDataFrame([], schema)
    if not exists(spark, path):
        return empty
    return spark.read.option("lineSep", "\n").text(path).select(F.from_json("value", schema).alias("v")).select("v.*").where(F.col(required).isNotNull()).select(*empty.columns)


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines; a bad line is an error; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def text_or_empty(spark: SparkSession, path: str) -> str:
    """A small text file by path or URI; a missing one is empty."""
    return "\n".join(r.value for r in whole(spark, path).collect()) if exists(spark, path) else ""


def event_dirs(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    """Events of several run folders, by path or URI; missing folders have none."""
    there = [f for f in folders if exists(spark, f)]
    return spark.read.schema(schema).json(there) if there else spark.createDataFrame([], schema)


def own_collection(spark: SparkSession, path: str) -> DataFrame:
    """Items of a file of own records: the whole set is validated first, and refused if anything is wrong."""
    from ..operators import reports

    lines = json_lines(spark, path)
    wrong = reports.check_shadowing(lines).where("severity = 'error'")
    if first := wrong.orderBy("line_no", "rule", "subject").first():
        raise LoadError(f"{path}: {wrong.count()} errors, the first: line {first.line_no}, {first.rule}, {first.subject}")
    return own_items(reports.records(lines, reports.SHADOWING))


def dev_items(template_rows: DataFrame, records: DataFrame, quoting: DataFrame, per_variant: int = 12, seed: str = "dev") -> DataFrame:
    """id, family, channel, label, author, text of the items of a dev run: all rows of the template split, as many records of each
    variant, and the quoting rows that are no templates; texts are normalized."""
    from ..operators.calls import quota_sample

    variants = max(1, records.select("family").distinct().count())
    sample = quota_sample(records.select("id", "family", "text"), per_variant * variants, "family", seed)
    item = lambda df, channel, label, author: df.select("id", "family", channel.alias("channel"), F.lit(label).alias("label"), author.alias("author"), normalize(F.col("text")).alias("text"))
    quoted = quoting.where(~F.col("id").startswith("TEMPLATE")).select(F.concat(F.lit("quoting/"), "id").alias("id"), F.lit("quoting").alias("family"), "channel", "author", "text")
    return union_items(item(sample, F.lit("tool_result"), "attack", F.lit("")), item(quoted, F.col("channel"), "benign", F.col("author")), item(template_rows, F.col("channel"), "attack", F.lit("")))


def fetch_verified(pins: list[tuple[str, str, str]], folder: str, fetch: Callable[[str], bytes]) -> list[str]:
    """Errors of fetching pinned files (name, place, blob id) into a folder: one that is there and right is skipped, one that can't be
    fetched or has another id isn't written, and the rest still go on."""
    errors = []
    for name, place, blob in pins:
        path = os.path.join(folder, name)
        blob_of = lambda data: hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()
        if os.path.exists(path):
            with open(path, "rb") as f:
                if blob_of(f.read()) == blob:
                    continue
        try:
            data = fetch(place)
        except Exception as e:  # noqa: BLE001 - reported for each file
            errors.append(f"{name}: {type(e).__name__}")
            continue
        if blob_of(data) != blob:
            errors.append(f"{name}: another blob id")
            continue
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    return errors


def verified_files(spark: SparkSession, paths: list[str], pins: DataFrame) -> DataFrame:
    """name, blob_id, verified: raw files against the pinned ids of their contents (pins: name, blob_sha)."""
    files = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), blob_id(F.col("content")).alias("blob_id"))
    return files.join(pins, "name", "left").select("name", "blob_id", F.coalesce(F.col("blob_id") == F.col("blob_sha"), F.lit(False)).alias("verified"))


def split_by_key(rows: DataFrame, dev_ids: DataFrame, keep: tuple[str, ...] = ("Template-1", "Template-2")) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts by paradigm): rows (id, paradigm, text) of some paradigms whose ids are in the dev split. The key decides
    before the text is read, which column pruning makes true of Parquet; a row without a key is an error."""
    checked = rows.withColumn("paradigm", F.coalesce("paradigm", F.raise_error(F.lit("a row has no paradigm")).cast("string")))
    kept = checked.where(F.col("paradigm").isin(*keep)).join(dev_ids.select("id"), "id", "left_semi")
    return kept, checked.select("paradigm").groupBy("paradigm").agg(F.count(F.lit(1)).alias("seen"))


def protocol(path: str, strict: bool = True) -> tuple[dict, list[str]]:
    """A protocol's values by key and all its problems; a bool is no number. Lenient: only the prompt's path is asked for. The path of
    the prompt is taken from the protocol's own folder."""
    try:
        with open(path, "rb") as f:
            found = tomllib.load(f)
    except FileNotFoundError:
        return {}, [f"{path} not found"]
    except tomllib.TOMLDecodeError as e:
        return {}, [f"not TOML: {e}"]
    values, wrong = {}, []
    for section, keys in PROTOCOL.items():
        part = found.get(section) if isinstance(found.get(section), dict) else {}
        for key, kind in keys.items():
            if not strict and key != "prompt_path":
                continue
            value = part.get(key)
            sound = isinstance(value, (int, float) if kind is float else kind) and not isinstance(value, bool)
            if not sound or not strict and not value.strip():
                wrong.append(f"{section}.{key}")
            else:
                values[key] = value
    if "prompt_path" in values:
        values["prompt_path"] = os.path.join(os.path.dirname(path), values["prompt_path"])
    return values, wrong


def prompt(path: str) -> tuple[str, str]:
    """A prompt's text and the hash of its bytes, with line feeds only, so that a checkout can't change it."""
    with open(path, "rb") as f:
        data = f.read().replace(b"\r\n", b"\n")
    return data.decode("utf-8"), hashlib.sha256(data).hexdigest()


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
