"""Sets of character pieces of key texts, and the exact score of pairs (Jaccard over sets of five-character pieces)."""

from __future__ import annotations

import numpy as np

from ..functions import codes as C

N, THRESHOLD = 5, 0.85
BYTES = 1 << 18  # of text at a time: its arrays stay in the processor's cache
ROW_BITS = 12  # of a packed piece: the row within its batch; the rest is the piece's hash


def positions(codes: C.Codes, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and row of every piece: all runs of n code points, or the whole of a shorter text that isn't empty."""
    sizes = np.diff(codes.off)
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(sizes)), count)
    start = codes.off[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return start, np.minimum(n, sizes[row]), row


def packed(codes: C.Codes, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every piece in one word (rows below 4096), and the piece's start.

    The hash is a sum of code points times fixed odd numbers, by their places in the piece, mixed.
    """
    cp, off = codes
    sizes = np.diff(off)
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    starts = np.ones(len(cp), bool)
    for k in range(1, n):
        late = off[1:] - k
        starts[late[late >= off[:-1] + count]] = False
    factors = C.mix(np.arange(n + 1), 11) | np.uint64(1)
    x = np.zeros(len(cp) + n - 1, np.uint64)
    x[: len(cp)] = cp
    h = x[: len(cp)] * factors[0]
    for k in range(1, n):
        h += x[k : k + len(cp)] * factors[k]
    if (short := np.flatnonzero((sizes > 0) & (sizes < n))).size:  # a text that is one piece: only what it has, and its size
        at, many = off[:-1][short], sizes[short]
        h[at] = many.astype(np.uint64) * factors[n]
        for k in range(n - 1):
            h[at[many > k]] += x[at[many > k] + k] * factors[k]
    h = C.mix(h[starts], 11)
    h >>= np.uint64(ROW_BITS)
    h |= np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(64 - ROW_BITS), count)
    return h, np.flatnonzero(starts)


def distinct(pack: np.ndarray) -> np.ndarray:
    pack = np.sort(pack)
    return pack[np.concatenate([[True], pack[1:] != pack[:-1]])] if len(pack) else pack


def rows_of(pack: np.ndarray) -> np.ndarray:
    return (pack >> np.uint64(64 - ROW_BITS)).astype(np.int64)


def scores(a: C.Codes, b: C.Codes) -> np.ndarray:
    """Jaccard of row i of a and row i of b; two empty texts score 1."""
    rows = len(a.off) - 1
    x, y = distinct(packed(a)[0]), distinct(packed(b)[0])
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = np.bincount(rows_of(both[1:][both[1:] == both[:-1]]), minlength=rows)
    total = np.bincount(rows_of(both), minlength=rows) - shared
    return np.where(total > 0, shared / np.maximum(total, 1), 1.0)
