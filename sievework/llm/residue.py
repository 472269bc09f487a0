"""Problem 8: template residue and error-page text, by aligning records of one template.

Texts are taken in consistent form; what they quote (code, inline code, quoted words) is set aside, for a text that treats of
placeholders or error messages quotes them. The rest is a sequence of words in units (lines and sentences).

*Slots.* Records of one template are aligned at a place by the two words before it and by the two words after it. The words that
distinct texts hold at that place are its column, counted over the whole collection. A column that varies is an induced slot. A
record whose slot holds the name of a variable, a default value or a blank where the others hold words was never filled in. The
syntax of a variable is a prior: one in delimiters that running text doesn't use (``{{x}}``) is unfilled even where nothing aligns;
one in delimiters that it does use (``{x}``, ``__x__``, blanks) is, unless surely nearly all wordings of its template hold it, so that
it is the template's own; what only looks like a variable, a default or a gap (``%s``, ``[First Name]``, ``null`` after a colon) needs a
slot that other records fill.

*Pages.* Short units that several distinct texts repeat, numbers and codes aside, are parts of whole-page templates. One with a word
of errors, refused access, scripts or placeholders (``SIGNS``) is a message; so is one that nearly always stands on pages with a message.
A page that messages make up by half or more counts with each of its copies, other texts once.

*Repetition.* A unit that repeats one to four words or one letter over and over, or three units in a row that are equal but for their
numbers, are filler; so is a unit of two fifths words of the usual dummy passage.

Everything but the marking of quotes and variables works on arrays. Counts are over distinct texts. Columns are counted for the
contexts of variables only, which a bitmap of fixed size lets through; no text is shuffled, and a hot context is summed before it.

Defined cases: documents without id are left out, null, empty and merely short texts aren't residue; repeated rows count once in the
result; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import map_arrow
from ..functions.bitmaps import bitmap, within
from ..functions.stats import wilson
from ..session import cut
from . import codepoints as C

NOTICE, PAGE = 14, 12  # words of a message, units of a page
REPEATS = 3  # texts in which a message must recur
STEM = 5  # letters of a word of the dummy passage that count, since it comes in many distortions
COMPANY = 0.8  # of a unit's pages that have a message, for the unit to be one
FILLED, OTHERS = 2, 5  # texts that fill a slot with words: for a variable, for what only looks like one
OWN_SHARE, Z = 0.9, 1.645  # a template has a variable as its own if the share of such wordings is surely (95 %, Wilson) so great

NAME = r"[A-Za-z][\w.\- ]{0,40}?"
# Delimiters of template fields, by what else they are used for: nothing, something, much.
STRONG = re.compile(
    rf"\{{\{{\s*{NAME}\s*\}}\}}|\{{%\s*{NAME}\s*%\}}|<%[=-]?\s*{NAME}\s*-?%>|\$\{{\s*{NAME}\s*\}}|#\{{\s*{NAME}\s*\}}|@@\s*{NAME}\s*@@|%%\s*{NAME}\s*%%|\[\[\s*{NAME}\s*\]\]|<<\s*{NAME}\s*>>|\*\|{NAME}\|\*"
    rf"|<your {NAME}>|\[(?:insert|enter|add|your|the) {NAME}\]|\[{NAME} (?:goes )?here\]|\((?:fill in|insert|enter|add|your) {NAME}\)|\({NAME} goes here\)|&lt;\s*{NAME}\s*&gt;",
    re.I,
)
WEAK = re.compile(rf"(?<![\w/$#{{]){{{NAME}}}(?![\w/}}])|(?<![\w/]){{{NAME}}}(?=\s)|(?<!\w)__{NAME}__(?!\w)|(?<![\w%])%[A-Z][A-Z_]+%(?![\w%])|<[A-Z][A-Z_ ]+>|\[[A-Z][A-Z_ ]{{2,}}\]|(?<![\w_])_{{3,}}(?![\w_])|(?<![\w.])\.{{6,}}(?![\w.])(?!\s*\d)")
SHAPE = re.compile(r"(?<![\w%])%[sd](?!\w)|\[[A-Z][a-z]+(?: [A-Z][a-z]+){0,2}\]|(?<=: )(?:undefined|null|NaN|N/A|None|TBD|TODO|TBC|FIXME)(?=\s*(?:\n|$))|(?<=\w) (?=,)")
# Words of errors, refused access, scripts and placeholders, in the languages of the collection.
SIGNS = frozenset(
    "javascript js scripts scripting cookie cookies browser error fatal denied forbidden unavailable unauthorized gateway timeout http captcha human permission expired maintenance loading reload refresh retry"
    " skripte fehler verweigert serverfehler wartungsarbeiten berechtigung abgelaufen seite adresse"
    " navigateur scripts erreur refusé introuvable indisponible permission maintenance réessayez adresse"
    " navegador denegado error encontrada permiso mantenimiento inténtelo intentarlo dirección"
    " page address server network exist exists moved sorry disabled"
    " todo tbd tbc fixme placeholder pending dummy description".split()
)
SIGN_PAIRS = frozenset((("not", "found"), ("nicht", "gefunden"), ("no", "encontrada"), ("timed", "out"), ("went", "wrong"), ("too", "many"), ("bad", "request"), ("your", "request"), ("add", "your"), ("coming", "soon"), ("goes", "here")))
NUMBERS = frozenset("one two three four five six seven eight nine ten".split())
# The usual dummy passage.
DUMMY = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat"
    " duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum".split()
)
FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
QUOTED = re.compile(r"`[^`\n]{1,300}`|“[^”\n]{1,400}”|«[^»\n]{1,400}»|„[^“”\n]{1,400}[“”]|\"[^\"\n]{1,400}\"|(?<![\w'])'(?=\S)(?:[^'\n]|(?<=\w)'(?=\w)){1,300}'(?!\w)")
TAG = re.compile(rf"</?[a-z][a-z0-9]*(?:\s+[\w\-]+=(?:\"[^\"]*\"|\ue009))*\s*/?>", re.I)
PATH = re.compile(r"(?<!\S)\S*/\S+")
# A text without any of these characters has nothing to mark.
TO_MARK = "[\"“”«»„`'{}\\[\\]<>@%&*/:]|~~~|__|\\.{6}|\\w ,|\\((?i:fill|insert|enter|add|your)|(?i:goes here)"
CITED, MARKS = "\ue009", ("\ue000", "\ue001", "\ue002")  # what is set aside, and each kind of variable: strong, weak, shape


def marked(text: str) -> str:
    """The text with one private character in place of each quotation and each variable."""
    text = QUOTED.sub(CITED, FENCE.sub(CITED, text))
    text = WEAK.sub(MARKS[1], STRONG.sub(MARKS[0], text))
    text = TAG.sub("\n", text)  # a variable's own delimiters may look like a tag
    return PATH.sub(" 0 ", SHAPE.sub(MARKS[2], text))


def _marked(forms: pa.Array) -> pa.Array:
    some = pc.match_substring_regex(forms, TO_MARK)
    if not pc.any(some).as_py():
        return forms
    fresh = [marked(t) for t in pc.filter(forms, some).to_pylist()]
    return pc.replace_with_mask(forms, some, pa.array(fresh, pa.string()))


class Words:
    """Words of marked texts in order: row, hash (numbers and codes alike), unit, and what they are."""

    def __init__(self, codes: C.Codes):
        cp, off = codes
        special = (cp >= 0xE000) & (cp <= 0xE009)
        inside = C.word_table()[cp] | special
        edge = np.zeros(len(cp) + 1, bool)
        edge[off] = True
        before, after = np.concatenate([[False], inside[:-1] & ~special[:-1]]), np.concatenate([inside[1:] & ~special[1:], [False]])
        s = np.flatnonzero(inside & (special | edge[:-1] | ~before))
        e = np.flatnonzero(inside & (special | edge[1:] | ~after)) + 1
        self.row = np.searchsorted(off, s, "right") - 1
        n = len(s)
        fold, at, pool = C.folding()
        low = np.where(fold[cp] == 1, pool[at[cp]], cp)
        self.raw = C.window_hashes(low, s, e - s, 85) if n else np.zeros(0, np.uint64)
        digits = np.concatenate([[0], np.cumsum((cp >= 48) & (cp <= 57))])
        self.number = (digits[e] > digits[s]) | np.isin(self.raw, _hashed(NUMBERS))
        self.stem = C.window_hashes(low, s, np.minimum(e - s, STEM), 85) if n else self.raw
        self.hash = np.where(self.number, np.uint64(1), self.raw)
        self.size = e - s
        self.mono = np.zeros(n, bool)  # one letter over and over
        turns = np.concatenate([[0], np.cumsum(np.concatenate([[0], (low[1:] != low[:-1]).astype(np.int64)]))])
        self.mono = (self.size >= 8) & (turns[e] - turns[np.minimum(s + 1, e)] == 0) & ~self.number
        first = cp[s] if n else cp[:0]
        self.kind = np.full(n, -1, np.int8)
        for k, c in enumerate(MARKS):
            self.kind[first == ord(c)] = k
        self.cited = first == ord(CITED)
        # units: lines, sentences, cells and points
        blank = cp == 32
        nxt = np.concatenate([blank[1:], [False]])
        stop = (cp == 10) | (((cp == 46) | (cp == 33) | (cp == 63)) & nxt)
        point = (cp == 124) | (cp == 45) | (cp == 42) | (cp == 0x2022) | (cp == 0xB7)
        stop |= point & nxt & np.concatenate([[False], blank[:-1]])
        ends = np.concatenate([[0], np.cumsum(stop)])
        new = np.ones(n, bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (ends[s[1:]] > ends[e[:-1]])
        self.new = new
        self.unit = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, n))
        self.unit_row = self.row[self.first]

    def before(self, k: int) -> np.ndarray:
        """Hash of the k-th word before each within its unit, 0 where there is none."""
        out = np.zeros(len(self.hash), np.uint64)
        if k < len(out):
            out[k:] = np.where(self.unit[k:] == self.unit[:-k], self.hash[:-k], np.uint64(0))
        return out

    def after(self, k: int) -> np.ndarray:
        out = np.zeros(len(self.hash), np.uint64)
        if k < len(out):
            out[:-k] = np.where(self.unit[k:] == self.unit[:-k], self.hash[k:], np.uint64(0))
        return out

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Context of each word by the two words before it and by the two after it; 0 where there is no word."""
        out = []
        for seed, near, far in ((86, self.before(1), self.before(2)), (87, self.after(1), self.after(2))):
            h = C.mix(C.mix(near, seed) + far, seed)
            out.append(np.where(near == 0, np.uint64(0), h))
        return out[0], out[1]

    def unit_hashes(self) -> np.ndarray:
        return C.window_hashes(self.hash, self.first, self.count, 88) if len(self.first) else np.zeros(0, np.uint64)

    def signs(self) -> np.ndarray:
        pairs = sorted(SIGN_PAIRS)
        a, b = (C.window_hashes(c.cp, c.off[:-1], np.diff(c.off), 85) for c in (C.decode(pa.array(x)) for x in zip(*pairs)))
        out = np.isin(self.raw, _hashed(SIGNS))
        if len(self.raw) > 1:
            out[:-1] |= np.isin(C.mix(self.raw[:-1], 89) + self.raw[1:], C.mix(a, 89) + b) & (self.unit[:-1] == self.unit[1:])
        return out

    def halves(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of both parts of the units, cut at each of their words, and the unit."""
        cuts = np.maximum(self.count[units] - 1, 0)
        unit = np.repeat(units, cuts)
        k = 1 + np.arange(len(unit)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first = self.first[unit]
        if not len(unit):
            return (np.zeros(0, np.int64),) * 3
        return C.window_hashes(self.hash, first, k, 88).view(np.int64), C.window_hashes(self.hash, first + k, self.count[unit] - k, 88).view(np.int64), unit

    def any_of(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.unit, flag, len(self.first)) > 0

    def filler(self, hashes: np.ndarray) -> np.ndarray:
        """Rows with repetition or dummy text."""
        found = [self.row[self.mono]]
        n = len(self.hash)
        for period in range(1, 5):
            if n <= period:
                break
            same = (self.unit[period:] == self.unit[:-period]) & (self.raw[period:] == self.raw[:-period]) & ~(self.cited | (self.kind >= 0))[period:]
            hits = np.bincount(self.unit[period:], same, len(self.first))
            found.append(self.unit_row[(self.count >= 4 * period) & (hits >= self.count - period) & (self.count >= 4)])
        k = np.arange(max(len(hashes) - 2, 0))
        plain = self.any_of(~self.number & ~self.cited & (self.kind < 0))
        if len(k):
            row, u = self.unit_row, hashes
            same = (u[k] == u[k + 1]) & (u[k] == u[k + 2]) & (row[k] == row[k + 2]) & plain[k] & (self.count[k] <= 3)
            found.append(row[k[same]])
        dummy = np.isin(self.stem, _hashed(frozenset(w[:STEM] for w in DUMMY if len(w) >= 4)))
        pairs = np.unique(np.stack([self.unit[dummy].astype(np.uint64), self.stem[dummy]], 1), axis=0)
        different = np.bincount(pairs[:, 0].astype(np.int64), minlength=len(self.first)) if len(pairs) else np.zeros(len(self.first), np.int64)
        found.append(self.unit_row[(different >= 3) & (5 * np.bincount(self.unit, dummy, len(self.first)) >= 2 * self.count)])
        return np.unique(np.concatenate(found))


_known: dict[frozenset, np.ndarray] = {}


def _hashed(words: frozenset) -> np.ndarray:
    if words not in _known:
        codes = C.decode(pa.array(sorted(words)))
        _known[words] = C.window_hashes(codes.cp, codes.off[:-1], np.diff(codes.off), 85)
    return _known[words]


def words_of(texts: pa.Array) -> Words:
    """Words of stored texts, in consistent form and marked."""
    cp, off = C.consistent(C.decode(texts))
    cp = np.where((cp >= 0xE000) & (cp <= 0xE009), 0xFFFD, cp).astype(np.uint32)
    return Words(C.decode(_marked(C.encode(C.Codes(cp, off)))))


SEEN = "kid binary, what string, kind byte, left long, right long, unit long, page boolean"


def _look(piece: pa.RecordBatch) -> pa.RecordBatch:
    """Variables with their contexts, filler, and the units that may be parts of page templates."""
    w = words_of(piece.column("text"))
    hashes = w.unit_hashes().view(np.int64)
    left, right = (x.view(np.int64) for x in w.contexts())
    held = np.flatnonzero(w.kind >= 0)
    filler = w.filler(hashes)
    cited, sign = w.any_of(w.cited), w.any_of(w.signs())
    short = (w.count <= NOTICE) & ~cited & ~w.any_of(w.kind >= 0)
    rows = piece.num_rows
    signed_words = np.bincount(w.unit_row, w.count * (short & sign), rows)
    page = 2 * signed_words >= np.maximum(np.bincount(w.unit_row, w.count, rows), 1)
    small = np.bincount(w.unit_row, minlength=rows) <= PAGE
    units = np.flatnonzero(short & (sign | small[w.unit_row]))
    heads, tails, halved = w.halves(np.flatnonzero(sign & ~cited & (w.count <= 2 * NOTICE)))
    at = np.concatenate([w.row[held], filler, w.unit_row[units], w.unit_row[halved]])
    n = (len(held), len(filler), len(units), len(halved))
    part = lambda *x: np.concatenate([np.broadcast_to(np.asarray(v), k) for v, k in zip(x, n)])
    what = pa.array(np.array(["slot", "filler", "unit", "halves"])[np.repeat(np.arange(4), n)])
    return pa.RecordBatch.from_arrays(
        [
            piece.column("kid").take(pa.array(at)), what, pa.array(part(w.kind[held], np.int8(0), sign[units].astype(np.int8), np.int8(0)).astype(np.int8)),
            pa.array(part(left[held], 0, 0, heads)), pa.array(part(right[held], 0, 0, tails)), pa.array(part(hashes[w.unit[held]], 0, hashes[units], 0)), pa.array(part(False, False, page[w.unit_row[units]], False)),
        ],
        ["kid", "what", "kind", "left", "right", "unit", "page"],
    )


def columns(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """ctx, filled, varied: in how many distinct texts words stand in a context, and whether they differ; for wanted contexts, and
    a few that share their bits."""
    shipped = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, "ctx"))

    def count(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        w = words_of(piece.column("text"))
        bits, plain = shipped.value, (w.kind < 0) & ~w.cited
        found = []
        for ctx in w.contexts():
            k = np.flatnonzero(plain & (ctx != 0) & within(bits, ctx))
            found.append(np.stack([ctx[k].view(np.int64), w.row[k], w.hash[k].view(np.int64)], 1))
        rows = np.concatenate(found)
        if not len(rows):
            return None
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        head = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
        text = head | np.concatenate([[True], rows[1:, 1] != rows[:-1, 1]])
        at = np.flatnonzero(head)
        low, high = np.minimum.reduceat(rows[:, 2], at), np.maximum.reduceat(rows[:, 2], at)
        return pa.RecordBatch.from_arrays([pa.array(rows[at, 0]), pa.array(np.add.reduceat(text.astype(np.int64), at)), pa.array(low), pa.array(high)], ["ctx", "n", "low", "high"])

    counted = map_arrow(texts.select("text"), count, "ctx long, n long, low long, high long", "text")
    return counted.groupBy("ctx").agg(F.sum("n").alias("filled"), (F.min("low") < F.max("high")).alias("varied"))


def unfilled(texts: DataFrame, slots: DataFrame) -> DataFrame:
    """kid, why: texts with a variable, default or blank that was never filled in; why is ``slot`` if other records fill its slot,
    ``syntax`` if only its delimiters tell."""
    each = slots.select("kid", "kind", "unit", F.explode(F.array_distinct(F.array("left", "right"))).alias("ctx"))
    wanted = each.where("ctx <> 0")
    seen = columns(texts, wanted.select("ctx"))
    wordings = wanted.groupBy("ctx").agg(F.count_distinct("unit").alias("open"))
    known = wordings.join(seen, "ctx", "left").select("ctx", "open", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("varied", F.lit(False)).alias("varied"))
    own = wilson(F.col("open"), F.col("open") + F.col("filled"), Z)[0] >= OWN_SHARE
    rare = F.col("varied") & (F.col("filled") >= OTHERS) & (F.col("open") <= (1 - OWN_SHARE) * F.col("filled"))
    facts = known.select("ctx", (F.col("varied") & (F.col("filled") >= FILLED) & ~own).alias("slot"), own.alias("own"), rare.alias("rare"))
    joined = each.join(facts, "ctx", "left").groupBy("kid", "kind", "unit").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("slot", "own", "rare")))
    said = F.when(F.col("kind") == 2, F.when(F.col("rare"), "slot")).when(F.col("slot"), "slot").when((F.col("kind") == 0) | ~F.col("own"), "syntax")
    return joined.select("kid", said.alias("why")).where("why is not null")


def messages(ids: DataFrame, units: DataFrame, halves: DataFrame, repeats: int) -> DataFrame:
    """kid, why: texts with a part of a repeated page template that has a sign, or keeps company with such parts. A unit that is two
    such parts run together is one too."""
    units = units.select("kid", "unit", (F.col("kind") == 1).alias("sign"), "page").distinct()
    copies = ids.join(units.where("page").select("kid").distinct(), "kid", "left_semi").groupBy("kid").agg(F.count(F.lit(1)).alias("copies"))
    counted = cut(units.join(copies, "kid", "left").withColumn("n", F.coalesce("copies", F.lit(1))))
    signed = counted.where("sign").groupBy("unit").agg(F.sum("n").alias("n")).where(F.col("n") >= repeats).select("unit")
    parts = cut(counted.groupBy("unit").agg(F.sum("n").alias("n"), F.bool_or("sign").alias("sign")).where(F.col("n") >= repeats).select("unit", "sign"))
    both = halves.select("kid", "left", "right").join(parts.toDF("left", "a"), "left").join(parts.toDF("right", "b"), "right").where("a or b").select("kid")
    direct = cut(counted.where("sign").join(signed, "unit", "left_semi").select("kid").unionByName(both).distinct())
    company = counted.where("not sign").join(direct.withColumn("with", F.lit(1)), "kid", "left").groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count("with").alias("m"))
    kept = company.where((F.col("m") >= repeats) & (wilson(F.col("m"), F.col("n"), Z)[0] >= COMPANY)).select("unit")
    indirect = counted.where("not sign").join(kept, "unit", "left_semi").select("kid").distinct().join(direct, "kid", "left_anti")
    return direct.select("kid", F.lit("page").alias("why")).unionByName(indirect.select("kid", F.lit("company").alias("why")))


def evidence(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeats: int = REPEATS) -> DataFrame:
    """doc_id, why: each document with residue and what tells (slot, syntax, page, company, filler); one row for each."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text <> ''").withColumn("kid", F.unhex(F.md5("text")))
    ids = cut(rows.select("doc_id", "kid").distinct())
    texts = cut(rows.groupBy("kid").agg(F.first("text").alias("text")))
    seen = cut(map_arrow(texts, _look, SEEN, "text"))
    filler = seen.where("what = 'filler'").select("kid", F.lit("filler").alias("why"))
    found = filler.unionByName(unfilled(texts, seen.where("what = 'slot'"))).unionByName(messages(ids, seen.where("what = 'unit'"), seen.where("what = 'halves'"), repeats))
    return ids.join(found.distinct(), "kid").select("doc_id", "why").distinct()


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeats: int = REPEATS) -> DataFrame:
    """doc_id: the documents with unfilled fields, filler, messages of errors or refused access, or notices about scripts."""
    return evidence(docs, doc_id, text, repeats).select("doc_id").distinct()
