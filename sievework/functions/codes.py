"""Texts of a batch as one array of code points: decoding and encoding Arrow strings, expansions by tables, hashes of windows.

No function here is called once per row.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Blocks without decompositions, marks and case (ideographs, Hangul syllables, private use, unassigned planes).
PLAIN_BLOCKS = ((0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xD800, 0xF8FF), (0x20000, 0x2F7FF), (0x2FA20, 0xDFFFF), (0xE1000, 0x10FFFF))
LIMIT = 0x110000


class Codes(NamedTuple):
    """Texts of a batch: code points one after another, and where each text begins (one more entry than texts)."""

    cp: np.ndarray
    off: np.ndarray


def interesting():
    at = 0
    for low, high in PLAIN_BLOCKS:
        yield from range(at, low)
        at = high + 1
    yield from range(at, LIMIT)


@functools.lru_cache(maxsize=1)
def folding() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full case folding as expansion length, place and pool."""
    length, at, pool = np.ones(LIMIT, np.uint8), np.arange(LIMIT, dtype=np.int32), []
    for c in interesting():
        if (f := chr(c).casefold()) != chr(c):
            length[c], at[c] = len(f), LIMIT + len(pool)
            pool.extend(map(ord, f))
    return length, at, np.concatenate([np.arange(LIMIT, dtype=np.uint32), np.array(pool, np.uint32)])


@functools.lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """True for letters and digits."""
    table = np.zeros(LIMIT, bool)
    for low, high in ((0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x2F7FF), (0x2FA20, 0x323AF)):
        table[low : high + 1] = True
    for c in interesting():
        if chr(c).isalnum():
            table[c] = True
    return table


def decode(arr: pa.Array) -> Codes:
    """Copy Arrow strings into code points; a null is an empty text (the caller keeps the mask)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(arr) else np.zeros(0, np.uint8)
    off = off - off[0]
    try:
        cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    except UnicodeDecodeError:  # bytes that aren't UTF-8 become replacement characters
        texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return Codes(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum(sizes)]))
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return Codes(cp, lead[off])


def encode(codes: Codes, null: np.ndarray | None = None) -> pa.Array:
    """Arrow strings of code points; ``null`` marks the rows that are null."""
    cp, off = codes
    size = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[off]
    data = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    mask = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    large = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data), mask)
    return large.cast(pa.string())


def expand(codes: Codes, length: np.ndarray, at: np.ndarray, pool: np.ndarray) -> Codes:
    """Replace every code point by its expansion: one gather over the lengths, one over the pool."""
    cp, off = codes
    n = length[cp].astype(np.int64)
    ends = np.cumsum(n)
    new_off = np.concatenate([[0], ends])[off]
    if not len(cp):
        return Codes(cp, new_off)
    if n.min() == 1 and n.max() == 1:
        return Codes(pool[at[cp]], new_off)
    within = np.arange(ends[-1]) - np.repeat(ends - n, n)
    return Codes(pool[np.repeat(at[cp], n) + within], new_off)


def keep(codes: Codes, keep: np.ndarray) -> Codes:
    return Codes(codes.cp[keep], np.concatenate([[0], np.cumsum(keep)])[codes.off])


@functools.lru_cache(maxsize=1)
def blank_table() -> np.ndarray:
    """True for the white space that str.split() splits at."""
    table = np.zeros(LIMIT, bool)
    table[[c for c in interesting() if chr(c).isspace()]] = True
    return table


def collapsed(codes: Codes) -> Codes:
    """Case-folded, with every run of white space as one blank and none at the ends."""
    cp, off = expand(codes, *folding())
    if not len(cp):
        return Codes(cp, off)
    blank = blank_table()[cp]
    first = off[:-1][off[:-1] < off[1:]]
    before = np.concatenate([[True], blank[:-1]])
    before[first] = True
    cp, off = keep(Codes(np.where(blank, 32, cp).astype(np.uint32), off), ~(blank & before))
    ends = off[1:][off[1:] > off[:-1]] - 1
    stay = np.ones(len(cp), bool)
    stay[ends[cp[ends] == 32]] = False
    return keep(Codes(cp, off), stay)


FOLD_ASCII = bytes(ord(" ") if chr(c).isspace() else ord(chr(c).lower()) for c in range(128)) + bytes(range(128, 256))


def collapsed_ascii(arr: pa.Array) -> pa.Array:
    """As ``collapsed``, of ASCII texts without nulls, over their bytes."""
    large = arr.cast(pa.large_string())
    _, offsets, data = large.buffers()
    off = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1]
    raw = np.frombuffer((data.to_pybytes() if data is not None else b"")[off[0] : off[-1]].translate(FOLD_ASCII), np.uint8)
    off = off - off[0]
    blank = raw == 32
    drop = blank.copy()
    drop[1:] &= blank[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    drop[first] = blank[first]
    raw, off = _without(raw, off, drop)
    ends = off[1:][off[1:] > off[:-1]] - 1
    drop = np.zeros(len(raw), bool)
    drop[ends] = raw[ends] == 32
    raw, off = _without(raw, off, drop)
    return pa.LargeStringArray.from_buffers(len(arr), pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(raw)).cast(pa.string())


def _without(raw: np.ndarray, off: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(drop)
    return (raw[~drop], off - np.searchsorted(at, off)) if len(at) else (raw, off)


def hashes(codes: Codes, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every text: a polynomial over mixed code points, finished with the length."""
    if not len(codes.cp):
        return mix(np.zeros(len(codes.off) - 1, np.uint64), seed)
    sums, power = prefix_sums(codes.cp, seed)
    a, b = codes.off[:-1], codes.off[1:]
    return mix((sums[b] - sums[a]) * inverse_power(a, seed) + (b - a).astype(np.uint64), seed)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix finalizer) over an array."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _base(seed: int) -> int:
    return int(mix(np.array([seed], np.uint64), 77)[0]) | 1


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@functools.lru_cache(maxsize=8)
def _power_blocks(seed: int, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    base = _base(seed)
    if inverse:
        base = pow(base, -1, 2**64)
    small = powers(1 << 12, base)
    return small, powers(1 << 16, pow(base, 1 << 12, 2**64))


def power_at(at: np.ndarray, seed: int, inverse: bool = False) -> np.ndarray:
    """base ** at modulo 2 ** 64, by two table lookups; at below 2 ** 28."""
    small, big = _power_blocks(seed, inverse)
    return small[at & 0xFFF] * big[at >> 12]


def inverse_power(at: np.ndarray, seed: int) -> np.ndarray:
    return power_at(at, seed, True)


def prefix_sums(values: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Sums of mixed values times powers of the base; a window's hash is the difference of two, times an inverse power."""
    x = mix(values.astype(np.uint64), seed) * power_at(np.arange(len(values)), seed)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]), _base(seed)


def window_hashes(values: np.ndarray, start: np.ndarray, size, seed: int) -> np.ndarray:
    """Hash of values[start : start + size] for each start (equal windows have equal hashes wherever they stand)."""
    sums, _ = prefix_sums(values, seed)
    return mix((sums[start + size] - sums[start]) * inverse_power(start, seed), seed)
