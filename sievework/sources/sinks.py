"""Sinks: append-only event tables, results in order, deterministic JSON, reports that are never overwritten."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_events(df: DataFrame, folder: str) -> None:
    """Append rows as JSON with keys in order; each write is a set of whole files, so there is no torn last line to repair."""
    df.select(*sorted(df.columns)).write.mode("append").json(folder)


def write_run(outcomes: DataFrame, folder: str, raw: str = "raw") -> None:
    """Events without raw replies, and in a folder of their own the errors with them."""
    append_events(outcomes.drop(raw), f"{folder}/events")
    append_events(outcomes.where("verdict = 'error'").select("id", "error", raw), f"{folder}/errors")


def write_results(outcomes: DataFrame, path: str, place: str = "place") -> None:
    """id and verdict in the order of the input, as one ordered set of files."""
    outcomes.select(place, "id", "verdict").repartitionByRange(place).sortWithinPartitions(place).drop(place).write.mode("error").json(path)


def free_name(path: str) -> str:
    """The path, or with -2, -3, ... where it is taken."""
    stem, ext = os.path.splitext(path)
    n, name = 1, path
    while os.path.exists(name):
        n += 1
        name = f"{stem}-{n}{ext}"
    return name


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    """A report's table; reports are of bounded size by their nature, and a larger one is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def write_report(title: str, tables: dict[str, DataFrame], path: str) -> str:
    """Write a report beside earlier ones; the name it got."""
    name = free_name(path)
    with open(name, "x", encoding="utf-8", newline="\n") as f:
        f.write(f"# {title}\n" + "".join(f"\n## {k}\n\n{markdown_table(v)}" for k, v in tables.items()))
    return name


def event_line(event: dict) -> str:
    return json.dumps(event, ensure_ascii=False, sort_keys=True)


def as_json(df: DataFrame) -> DataFrame:
    """line: each row as JSON with keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))
