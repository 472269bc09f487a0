"""Consistent form of text on code-point arrays.

A batch of Arrow strings is copied into one ``uint32`` array of code points. Lookup tables say, for each code point, whether it
is dropped, replaced or expanded; expansion is a gather over offsets, and marks are reordered and composed over whole arrays.
No function here is called once per row.

The form: compatibility decomposition and canonical composition, look-alike letters of other alphabets as their Latin twins,
every blank as U+0020, every line break as U+000A, invisible characters dropped. Letter case, accents, punctuation, and the
number of blanks and line breaks stay.
"""

from __future__ import annotations

import functools
import unicodedata
from typing import NamedTuple

import numpy as np

from ..functions.codes import LIMIT, Codes, decode, encode, expand, folding, hashes, interesting, keep, mix, window_hashes, word_table

__all__ = ["Codes", "consistent", "decode", "encode", "expand", "folded", "folding", "hashes", "mix", "window_hashes", "word_table"]

# Letters whose picture is that of a Latin letter, by alphabet.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V", "Һ": "h",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "һ": "h",
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ρ": "p",
    # Armenian
    "Օ": "O", "Ս": "U", "Ղ": "S", "Լ": "L", "Տ": "S", "ո": "n", "օ": "o", "հ": "h", "ս": "u", "ց": "g", "ք": "p", "զ": "q",
    "յ": "j", "Ո": "N",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꭱ": "R", "Ꮥ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ᏻ": "G", "Ꭵ": "i",
    # phonetic and small-capital forms of Latin letters
    "ɑ": "a", "Ɑ": "A", "ɡ": "g", "Ɡ": "G", "ʏ": "y", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴏ": "o", "ᴄ": "c", "ꜱ": "s", "ǀ": "l",
    # Coptic, Lisu
    "Ⲟ": "O", "ⲟ": "o", "Ⲥ": "C", "ⲥ": "c", "Ⲣ": "P", "ⲣ": "p", "ꓐ": "B", "ꓑ": "P", "ꓒ": "d", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G",
    "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H",
    "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # hyphens of the same picture
    "‐": "-", "‑": "-",
}
# Characters that show nothing though they aren't format characters, and format characters that do show.
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
SHOWN_FORMATS = (*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD)
LINE_BREAKS = (0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029)
NO_STARTER = 0x1FFFFF


class Tables(NamedTuple):
    length: np.ndarray  # of each code point's expansion
    at: np.ndarray  # where its expansion begins in pool
    pool: np.ndarray
    ccc: np.ndarray  # canonical combining class
    joins: np.ndarray  # may compose with what precedes it
    pairs: np.ndarray  # starter << 21 | follower, sorted
    made: np.ndarray  # what the pair composes to


@functools.lru_cache(maxsize=1)
def tables() -> Tables:
    length, at = np.ones(LIMIT, np.uint8), np.zeros(LIMIT, np.int32)
    ccc, joins = np.zeros(LIMIT, np.uint8), np.zeros(LIMIT, bool)
    pool: list[int] = []
    pairs: dict[int, int] = {}
    hidden, shown, breaks = set(INVISIBLE), set(SHOWN_FORMATS), set(LINE_BREAKS)
    identity = []
    for c in interesting():
        ch = chr(c)
        if k := unicodedata.combining(ch):
            ccc[c], joins[c] = k, True
        kind, parts = unicodedata.category(ch), unicodedata.decomposition(ch)
        if parts and parts[0] != "<" and len(ab := [int(x, 16) for x in parts.split()]) == 2 and unicodedata.normalize("NFC", ch) == ch:
            pairs[ab[0] << 21 | ab[1]] = c
            joins[ab[1]] = True
        if c in breaks:
            out = "\n"
        elif kind == "Zs" or c == 9 or c == 0x2800:
            out = " "
        elif c in hidden or kind == "Cc" or kind == "Cf" and c not in shown:
            out = ""
        else:
            out = "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKD", LOOKALIKES.get(ch, ch)) if ord(x) not in hidden)
            if out == ch:
                identity.append(c)
                continue
        length[c], at[c] = len(out), len(pool)
        pool.extend(map(ord, out))
    joins[0x1161:0x1176] = joins[0x11A8:0x11C3] = True  # Hangul vowels and final consonants
    # code points that stay are read from a shared identity run appended to the pool
    base = len(pool)
    at_identity = np.arange(LIMIT, dtype=np.int32) + base
    touched = np.zeros(LIMIT, bool)
    touched[[c for c in interesting()]] = True
    touched[identity] = False
    at = np.where(touched, at, at_identity)
    keys = np.array(sorted(pairs), np.int64)
    return Tables(length, at, np.concatenate([np.array(pool, np.uint32), np.arange(LIMIT, dtype=np.uint32)]), ccc, joins, keys, np.array([pairs[int(k)] for k in keys], np.uint32))


def _compose(codes: Codes, t: Tables) -> Codes:
    cp, off = codes
    joins = t.joins[cp]
    first = off[:-1][off[:-1] < off[1:]]
    if not joins.any():
        return codes
    cp = cp.copy()
    head = ~joins
    head[first] = True
    heads = np.flatnonzero(head)
    run = np.cumsum(head) - 1
    ccc = t.ccc[cp].astype(np.int16)
    # canonical order: marks of a run sorted by class, between starters, stably
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:])).any():
        marks = np.flatnonzero(ccc > 0)
        starters = np.zeros(len(cp), bool)
        starters[first] = True
        segment = np.cumsum((ccc == 0) | starters)[marks]
        order = np.lexsort((ccc[marks], segment))
        cp[marks] = cp[marks][order]
        ccc[marks] = ccc[marks][order]
    sizes = np.diff(np.append(heads, len(cp)))
    live = np.flatnonzero(sizes > 1)
    place, base = heads[live], heads[live]
    starter = np.where(ccc[base] == 0, cp[base], NO_STARTER).astype(np.int64)
    last = np.full(len(live), -1, np.int16)  # class of the last mark that stayed; -1 where none did
    stay = np.ones(len(cp), bool)
    left = sizes[live]
    j = 1
    while len(live):
        at = base + j
        mark, cls = cp[at].astype(np.int64), ccc[at]
        key = starter << 21 | mark
        k = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
        made = np.where(t.pairs[k] == key, t.made[k], 0).astype(np.int64)
        lv = (starter >= 0x1100) & (starter < 0x1113) & (mark >= 0x1161) & (mark < 0x1176)
        made = np.where(lv, 0xAC00 + ((starter - 0x1100) * 21 + (mark - 0x1161)) * 28, made)
        lvt = (starter >= 0xAC00) & (starter < 0xD7A4) & ((starter - 0xAC00) % 28 == 0) & (mark >= 0x11A8) & (mark < 0x11C3)
        made = np.where(lvt, starter + (mark - 0x11A7), made)
        done = (made > 0) & ((last < cls) & ((cls > 0) | (last == -1)))
        cp[place[done]] = made[done]
        stay[at[done]] = False
        starter = np.where(done, made, starter)
        fresh = ~done & (cls == 0)  # a follower that didn't compose begins anew
        place = np.where(fresh, at, place)
        starter = np.where(fresh, mark, starter)
        last = np.where(done, last, np.where(fresh, -1, cls)).astype(np.int16)
        j += 1
        more = left > j
        live, place, base, starter, last, left = live[more], place[more], base[more], starter[more], last[more], left[more]
    return keep(Codes(cp, off), stay)


def consistent(codes: Codes) -> Codes:
    """The consistent form of every text."""
    t = tables()
    cr = codes.cp == 13
    if cr.any():  # a carriage return before a line feed is no line break of its own
        cr[:-1] &= codes.cp[1:] == 10
        cr[-1] = False
        cr[(codes.off[1:] - 1)[codes.off[1:] > codes.off[:-1]]] = False
        codes = keep(codes, ~cr)
    return _compose(expand(codes, t.length, t.at, t.pool), t)


def folded(codes: Codes) -> Codes:
    """Case-folded, with every run of blanks and line breaks as one blank and none at the ends; for consistent forms."""
    cp, off = expand(codes, *folding())
    blank = (cp == 32) | (cp == 10)
    if not len(cp):
        return Codes(cp, off)
    before = np.concatenate([[True], blank[:-1]])
    before[off[:-1][off[:-1] < off[1:]]] = True
    out = keep(Codes(np.where(blank, 32, cp).astype(np.uint32), off), ~(blank & before))
    cp, off = out
    ends = off[1:][off[1:] > off[:-1]] - 1
    stay = np.ones(len(cp), bool)
    stay[ends[cp[ends] == 32]] = False
    return keep(out, stay)


