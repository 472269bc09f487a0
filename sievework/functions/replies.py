"""Strict checks of JSON replies. Coercing parsers would let wrong types pass, so whole batches go through Python's own parser."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

VERDICT_KEYS, SPAN_KEYS, REPLY_KEYS = {"verdict", "family", "span"}, {"text", "voice", "addressee", "sensitive_action"}, {"spans", "unsure"}
# Fixed values of span descriptions.
VOICES = {"author_directive", "quoted", "attributed", "code_sample", "narrative"}
ADDRESSEES = {"agent", "human_reader", "third_party"}


def _object(content):
    try:
        value = json.loads(content)
    except (ValueError, RecursionError):
        return None, False
    return value, True


def _filled(value) -> bool:
    return isinstance(value, str) and bool(value.strip())


def check_verdict(content: str | None, finish: str | None = "stop") -> tuple[str, str | None, str | None, str | None]:
    """verdict, family, span, error."""
    wrong = lambda reason: ("error", None, None, reason)
    if (finish or "") not in ("stop", ""):
        return wrong(f"finish_reason={finish}")
    if content is None or not content.strip():
        return wrong("empty reply")
    reply, parsed = _object(content)
    if not parsed:
        return wrong("reply is not JSON")
    if not isinstance(reply, dict) or set(reply) != VERDICT_KEYS:
        return wrong("reply keys are not exactly verdict, family, span")
    match reply["verdict"]:
        case "benign":
            return ("benign", None, None, None) if reply["family"] is None is reply["span"] else wrong("benign verdict must have null family and span")
        case "attack":
            return ("attack", reply["family"], reply["span"], None) if _filled(reply["family"]) and _filled(reply["span"]) else wrong("attack verdict needs non-empty family and span strings")
    return wrong("verdict must be 'attack' or 'benign'")


def _spans(content: str | None) -> dict | None:
    reply, parsed = _object(content or "")
    if not parsed or not isinstance(reply, dict) or set(reply) != REPLY_KEYS or not isinstance(reply["spans"], list) or not isinstance(reply["unsure"], bool):
        return None

    def sound(s) -> bool:
        if not isinstance(s, dict) or set(s) != SPAN_KEYS:
            return False
        hashable = isinstance(s["voice"], str) and isinstance(s["addressee"], str)
        return hashable and isinstance(s["text"], str) and s["voice"] in VOICES and s["addressee"] in ADDRESSEES and isinstance(s["sensitive_action"], bool)

    return reply if all(map(sound, reply["spans"])) else None


def is_wellformed(content: str | None) -> bool:
    return _spans(content) is not None


def check_spans(content: str | None) -> str:
    """attack if a span is the author's directive to the agent for a sensitive action; a malformed or unsure reply is unsure."""
    reply = _spans(content)
    if reply is None:
        return "unsure"
    if any((s["voice"], s["addressee"], s["sensitive_action"]) == ("author_directive", "agent", True) for s in reply["spans"]):
        return "attack"
    return "unsure" if reply["unsure"] else "benign"


def check_draft(content: str | None, finish: str | None = "stop", least: int = 80, most: int = 2500) -> tuple[str | None, str | None]:
    """text, error."""
    if (finish or "") not in ("stop", ""):
        return None, f"finish_reason={finish}"
    reply, parsed = _object(content or "")
    if not parsed:
        return None, "reply is not JSON"
    if not isinstance(reply, dict) or set(reply) != {"text"} or not isinstance(reply["text"], str):
        return None, "reply keys are not exactly text"
    text = reply["text"].strip()
    return (text, None) if least <= len(text) <= most else (None, f"text length {len(text)} is outside {least} to {most}")


def _strings(*names: str) -> StructType:
    out = StructType()
    for n in names:
        out = out.add(n, StringType())
    return out


@F.pandas_udf(_strings("verdict", "family", "span", "error"))
def parse_verdict(content: pd.Series, finish: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([check_verdict(c, f) for c, f in zip(content, finish)], columns=["verdict", "family", "span", "error"], dtype=object)


@F.pandas_udf(StringType())
def span_verdict(content: pd.Series) -> pd.Series:
    return content.map(check_spans)


@F.pandas_udf(BooleanType())
def spans_wellformed(content: pd.Series) -> pd.Series:
    return content.map(lambda c: _spans(c) is not None)


@F.pandas_udf(_strings("text", "error"))
def parse_draft(content: pd.Series, finish: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([check_draft(c, f) for c, f in zip(content, finish)], columns=["text", "error"], dtype=object)
