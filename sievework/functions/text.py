"""Scalar text functions: columns in, columns out. Python runs only where the engine has no exact equivalent (NFKC, case folding)."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import codes as C
from .batches import pieces

# The white space that str.split() splits at, as a class of the engine's regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
GRAM, SHORT_WORDS, MEDIUM_WORDS = 5, 25, 45
COLLAPSED = 1 << 17  # bytes of text folded at a time
REDACTED, TAG_REMOVED = "<redacted>", "[fence tag removed]"
KEY = r"nvapi-[A-Za-z0-9_-]{20,}"  # how a key that leaked looks
OPEN_TAG, CLOSE_TAG = "<untrusted_text>", "</untrusted_text>"
_TAGS = re.compile("[\U000e0000-\U000e007f]")
_RUNS = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")  # ASCII changes only where a mark follows
SELECTORS = "︀-️\U000e0100-\U000e01ef"


@functools.lru_cache(maxsize=1)
def _unseen() -> re.Pattern:
    """Variation selectors and all format characters."""
    return re.compile(f"[{SELECTORS}{''.join(re.escape(c) for c in map(chr, range(C.LIMIT)) if unicodedata.category(c) == 'Cf')}]+")


def normalized(text: str) -> str:
    """Version 1 of the normalizer: tag characters made visible, NFKC, variation selectors and format characters dropped."""
    return _RUNS.sub(lambda m: _normalized_run(m[0]) if len(m[0]) <= 16 else _normalized(m[0]), text)


def _normalized(text: str) -> str:
    shown = _TAGS.sub(lambda m: f"<U+{ord(m[0]):04X}>", text)
    return _unseen().sub("", unicodedata.normalize("NFKC", shown))


_normalized_run = functools.lru_cache(maxsize=1 << 16)(_normalized)


def collapsed(text: str) -> str:
    return " ".join(text.split()).casefold()


@F.arrow_udf(StringType())
def _normalize(texts: pa.Array) -> pa.Array:
    """Plain ASCII is its own normal form; only the other rows of a batch are looked at one by one."""
    other = pc.invert(pc.fill_null(pc.string_is_ascii(texts), True))
    if not pc.any(other).as_py():
        return texts
    return pc.replace_with_mask(texts, other, pa.array([normalized(t) for t in pc.filter(texts, other).to_pylist()], texts.type))


@F.arrow_udf(StringType())
def _collapse(texts: pa.Array) -> pa.Array:
    """ASCII as bytes, other texts as code points, in slices of a size that stays in the processor's cache."""
    found = []
    for p in pieces(pa.RecordBatch.from_arrays([texts], ["t"]), "t", size=COLLAPSED):
        t = p.column("t")
        plain = pc.fill_null(pc.string_is_ascii(t), False)
        if pc.all(plain).as_py():
            found.append(C.collapsed_ascii(t))
            continue
        other = t.filter(pc.invert(plain))
        done = C.encode(C.collapsed(C.decode(other)), np.asarray(other.is_null()))
        if len(other) == len(t):
            found.append(done)
            continue
        ascii_too = np.asarray(plain)
        place = np.where(ascii_too, np.cumsum(ascii_too) - 1, ascii_too.sum() + np.cumsum(~ascii_too) - 1)
        found.append(pa.concat_arrays([C.collapsed_ascii(t.filter(plain)), done]).take(pa.array(place)))
    return pa.concat_arrays(found) if found else pa.array([], pa.string())


def normalize(text: Column) -> Column:
    return _normalize(text)


def collapse(text: Column) -> Column:
    """White space collapsed, case folded."""
    return _collapse(text)


def grams(key: Column, n: int = GRAM) -> Column:
    """The set of n-character pieces of a collapsed text; a shorter text is one piece, an empty one none."""
    by_regex = F.regexp_extract_all(key, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))
    # a look-ahead starts within surrogate pairs, so texts beyond the basic plane are cut by position
    by_place = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(n)))
    pieces = F.when(key.rlike(r"[\x{10000}-\x{10FFFF}]"), by_place).otherwise(by_regex)
    return F.when(F.length(key) == 0, F.array().cast("array<string>")).when(F.length(key) < n, F.array(key)).otherwise(F.array_distinct(pieces))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets are equal."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / F.greatest(total, F.lit(1)))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def blob_id(content: Column) -> Column:
    """The id that git gives a file: sha1 over a header with the length in bytes, and the content."""
    header = F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(header, F.lit(bytearray(b"\x00")), content.cast("binary")))


def cache_key(settings: str, text: Column) -> Column:
    """Key of a remembered verdict: hash of the call's settings and of the text's hash."""
    return sha256(F.concat(F.lit(settings + "\n"), sha256(text)))


def word_count(text: Column) -> Column:
    words = F.trim(F.regexp_replace(text, SPACE, " "))
    return F.when(F.length(words) == 0, F.lit(0)).otherwise(F.size(F.split(words, " ")))


def length_bucket(text: Column) -> Column:
    n = word_count(text)
    return F.when(n <= SHORT_WORDS, "short").when(n <= MEDIUM_WORDS, "medium").otherwise("long")


def compose(host: Column, fence: Column, clause: Column) -> Column:
    """Host text and clause, with a fenced block between blank lines where there is one."""
    return F.when(F.coalesce(F.length(fence), F.lit(0)) == 0, F.concat(host, F.lit(" "), clause)).otherwise(F.concat_ws("\n\n", host, fence, clause))


def fenced(text: Column) -> Column:
    """Text within one pair of fence tags it can neither close nor reopen."""
    safe = F.regexp_replace(text, r"(?iU)<\s*/?\s*untrusted_text\s*>", TAG_REMOVED)
    return F.concat(F.lit(OPEN_TAG + "\n"), safe, F.lit("\n" + CLOSE_TAG))


def messages(prompt: Column, text: Column) -> Column:
    pair = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(pair("system", prompt), pair("user", fenced(text)))


def is_snake_case(value: Column) -> Column:
    return value.rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)*\z")


def is_commit_id(value: Column) -> Column:
    return value.rlike(r"^[0-9a-f]{40}\z")


def leaked_keys(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({KEY})"), F.lit(1))


def retry_seconds(header: Column, now: Column) -> Column:
    """Seconds to wait that a header asks for, as a number or as a date, never below 0; null if it is neither."""
    seconds = F.when(F.trim(header).rlike(r"^-?[0-9]+(\.[0-9]+)?\z"), F.trim(header).try_cast("double"))
    date = F.try_to_timestamp(F.regexp_replace(F.trim(header), r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds, (F.unix_micros(date) - F.unix_micros(now)) / 1e6)
    return F.when(wait < 0, 0.0).otherwise(wait)


def rendered_prompt(template: str, topic: Column, form: Column, channel: Column) -> Column:
    """A prompt template with its placeholders filled."""
    out = F.lit(template)
    for name, value in (("topic", topic), ("form", form), ("channel", channel)):
        out = F.replace(out, F.lit(f"<<{name}>>"), value.cast("string"))
    return out


def script_safe(value: Column) -> Column:
    """JSON of a value that can stand inside a script element."""
    return F.replace(F.to_json(value), F.lit("<"), F.lit("\\u003c"))


def scrubbed(message: Column, secret: str, most: int = 300) -> Column:
    """Without a secret, cut to a length."""
    return F.substring(F.replace(message, F.lit(secret), F.lit(REDACTED)) if secret else message, 1, most)


def subgroup(item_id: Column, family: Column, wanted: str, categories: tuple[str, ...]) -> Column:
    """Of ids of five parts in one family: ``obfuscation`` by their fourth part, ``other``; null for the rest."""
    parts = F.split(item_id, "/")
    return F.when((family == wanted) & (F.size(parts) == 5), F.when(F.get(parts, F.lit(3)).isin(*categories), "obfuscation").otherwise("other"))


def variation(k: Column, topics: int, forms: tuple[str, ...], channels: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Topic number, form and channel of the k-th draft."""
    pick = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), (i + 1).cast("int"))
    return F.pmod(F.floor(k / 2), F.lit(topics)).cast("int"), pick(forms, F.pmod(k, F.lit(len(forms)))), pick(channels, F.pmod(k, F.lit(len(channels))))
