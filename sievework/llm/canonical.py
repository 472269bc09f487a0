"""Problem 3: mapping freely typed values to a canonical list.

Distinct values are brought to words of the folded consistent form. An automaton over the canonical names, their titles and aliases,
in any order of their words and with or without blanks, finds mentions standing in a value; the longest that don't overlap win. Words
that stand beside the mentions of several labels, and belong to no name, are decoration: they are learned from the values themselves.
What has no mention is looked at again without decoration, and goes to token-set similarity: each word of a name is held against the
value's words (edits, or a word cut short), every word that a name leaves over counts against it, and the value without blanks is held
against the name's words in each order, so that slips that move a blank are seen. All names of a block are scored at once on arrays. The
list goes to the workers in blocks of bounded size, each pass improving on the last.

Defined cases: a null value has a null label; a value without any word, or below the threshold, is ``unmatched``; ties go to the
label that comes first in byte order; rows are kept as they are, repeated ones too; an empty list leaves every value unmatched.
"""

from __future__ import annotations

import functools
import itertools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import map_arrow
from ..session import cut
from . import codepoints as C

UNMATCHED, THRESHOLD, BLOCK = "unmatched", 0.68, 20_000
BESIDE = 3  # labels beside whose mentions a word stands, for it to be decoration
CUT, LEFT = 0.85, 0.15  # likeness of a word cut short; what a word that belongs to no word of the name costs
MENTION = 2.0  # and the mention's length: a mention outdoes any similarity, a longer one a shorter one
WORD, NUMBER = re.compile(r"[^\W_]+"), re.compile(r"v?\d+")


def words_of(folded: str) -> list[str]:
    return WORD.findall(folded)


def orders(words: tuple[str, ...]):
    """Orders of a name's words: all of up to three, else as they stand and reversed."""
    return list(dict.fromkeys(itertools.permutations(words))) if len(words) <= 3 else [words, words[::-1]]


class Strings:
    """Strings as rows of code points, to be held against one string at a time. Strings of one ``group`` have the same characters."""

    def __init__(self, texts: list[str], group: list[int] | None = None):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.cp = np.zeros((len(texts), int(self.size.max(initial=0))), np.uint32)
        for k, t in enumerate(texts):
            self.cp[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        self.group = np.arange(len(texts)) if group is None else np.array(group, np.int64)
        one = np.unique(self.group, return_index=True)[1]
        inside = np.arange(self.cp.shape[1]) < self.size[one, None]
        self.bag = np.zeros((len(one), 32), np.int8)  # how often characters (by their last five bits) stand in each group
        np.add.at(self.bag, (np.nonzero(inside)[0], (self.cp[one][inside] & 31).astype(np.int64)), 1)
        self.group_size = self.size[one]

    def likeness(self, text: str, least: float) -> np.ndarray:
        """1 - edits / longer size of each, 0 below ``least``; edits insert, delete, replace or swap neighbours."""
        out = np.zeros(len(self.size))
        if not len(text) or not len(out):
            return out
        a = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        longer = np.maximum(self.size, len(a))
        most = ((1 - least) * longer + 1e-9).astype(np.int64)
        near = np.flatnonzero(np.abs(self.group_size - len(a)) <= (1 - least) * np.maximum(self.group_size, len(a)) + 1e-9)
        bag = np.minimum(np.bincount((a & 31).astype(np.int64), minlength=32), 127).astype(np.int8)
        common = np.minimum(self.bag[near], bag).sum(1, dtype=np.int64)  # an edit takes one character from what is common, a swap none
        size = np.maximum(self.group_size[near], len(a))
        alike = np.zeros(len(self.group_size), bool)
        alike[near[size - common <= (1 - least) * size + 1e-9]] = True
        rows = np.flatnonzero(alike[self.group])
        if not len(rows):
            return out
        width = int(self.size[rows].max())
        b, steps = self.cp[rows, :width], np.arange(width + 1, dtype=np.int16)
        before = last = np.broadcast_to(steps, (len(rows), width + 1))
        for i, x in enumerate(a, 1):
            same = b == x
            now = np.empty((len(rows), width + 1), np.int16)
            now[:, 0] = i
            now[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + ~same)
            if i > 1 and width > 1:
                swapped = same[:, :-1] & (b[:, 1:] == a[i - 2])
                now[:, 2:] = np.where(swapped, np.minimum(now[:, 2:], before[:, :-2] + 1), now[:, 2:])
            now = np.minimum.accumulate(now - steps, 1) + steps
            before, last = last, now
            alive = now.min(1) <= most[rows]
            if not alive.all():
                rows, b, before, last = rows[alive], b[alive], before[alive], last[alive]
                if not len(rows):
                    return out
        d = last[np.arange(len(rows)), self.size[rows]]
        out[rows] = np.where(d <= most[rows], 1 - d / longer[rows], 0.0)
        return out


class Canon:
    """The prepared list: pairs of a label and one of its names."""

    def __init__(self, names: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        kept = sorted({(tuple(w), label) for label, name in names if (w := words_of(name))}, key=lambda x: (x[1].encode(), x[0]))
        self.labels = [label for _, label in kept]
        self.automaton = ahocorasick.Automaton()
        seen: dict[str, str] = {}
        forms, self.form_of = [], []
        for k, (ws, label) in enumerate(kept):
            for o in orders(ws):
                for pattern in (f" {' '.join(o)} ", f" {''.join(o)} "):
                    seen.setdefault(pattern, label)
                forms.append("".join(o))
                self.form_of.append(k)
        for pattern, label in seen.items():
            self.automaton.add_word(pattern, (len(pattern), label))
        self.automaton.make_automaton() if seen else None
        self.forms, self.form_of = Strings(forms, self.form_of), np.array(self.form_of, np.int64)
        self.vocabulary = sorted({w for ws, _ in kept for w in ws})
        self.tokens = Strings(self.vocabulary)
        at = {w: k for k, w in enumerate(self.vocabulary)}
        self.count = np.array([len(ws) for ws, _ in kept], np.int64)
        self.token = np.full((len(kept), int(self.count.max(initial=0))), -1, np.int64)
        for k, (ws, _) in enumerate(kept):
            self.token[k, : len(ws)] = [at[w] for w in ws]
        self.word_likeness = functools.lru_cache(maxsize=4096)(self._word_likeness)

    def mention(self, words: list[str]) -> tuple[str | None, float]:
        """The label of the longest mention, and its score."""
        if not self.automaton or not words:
            return None, 0.0
        stream = f" {' '.join(words)} "
        hits = [(end - size + 1, end, label) for end, (size, label) in self.automaton.iter(stream)]
        taken: list[tuple[int, int, str]] = []
        for start, end, label in sorted(hits, key=lambda h: (h[0] - h[1], h[0], h[2].encode())):
            if all(end <= a or start >= b for a, b, _ in taken):  # a blank may be shared
                taken.append((start, end, label))
        return (taken[0][2], MENTION + taken[0][1] - taken[0][0]) if taken else (None, 0.0)

    def _word_likeness(self, word: str) -> np.ndarray:
        """Of a value's word and each word of the names: by edits, or CUT for a beginning of two fifths of it, at least three letters."""
        out = self.tokens.likeness(word, 0.5)
        begins = (self.tokens.cp[:, : len(word)] == np.frombuffer(word.encode("utf-32-le"), np.uint32)).all(1) if self.tokens.cp.shape[1] >= len(word) else np.zeros(len(out), bool)
        cut_short = begins & (self.tokens.size > len(word)) & (len(word) >= 3) & (len(word) >= 0.4 * self.tokens.size)
        return np.where(cut_short, CUT, out)

    def similar(self, words: list[str]) -> tuple[str | None, float]:
        """The label of the most similar name, if that reaches the threshold."""
        if not words or not self.labels:
            return None, 0.0
        whole = np.zeros(len(self.labels))
        np.maximum.at(whole, self.form_of, self.forms.likeness("".join(words), self.threshold))
        different = list(dict.fromkeys(words))
        each = np.stack([self.word_likeness(w)[self.token] for w in different])  # value's words x names x their words
        real = self.token >= 0
        best, by = each.max(0), each.argmax(0)
        used = np.zeros((len(different), len(self.labels)), bool)
        for j in range(self.token.shape[1]):
            used[by[:, j], np.arange(len(self.labels))] |= real[:, j]
        used = used.sum(0)
        mean = np.where(real, best, 0.0).sum(1) / self.count
        # every word of the name must be there, and words that belong to none of its words count against it
        all_there = (self.count == 1) | (np.where(real, best, 1.0).min(1) >= 0.5) & (used == self.count)
        score = np.maximum(whole, np.where(all_there, mean - LEFT * np.maximum(len(words) - used, 0), 0.0))
        k = int(np.flatnonzero(score >= score.max() - 1e-12)[0])
        return (self.labels[k], float(score[k])) if score[k] >= self.threshold else (None, 0.0)


VALUES = "value string, words array<string>, best string, score double"


def _prepared(values: DataFrame) -> DataFrame:
    """VALUES of a column of distinct values, without a label yet."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        folded = C.encode(C.folded(C.consistent(C.decode(piece.column("value"))))).to_pylist()
        n = piece.num_rows
        return pa.RecordBatch.from_arrays([piece.column("value"), pa.array([words_of(f) for f in folded], pa.list_(pa.string())), pa.nulls(n, pa.string()), pa.array(np.zeros(n))], ["value", "words", "best", "score"])

    return map_arrow(values, run, VALUES, "value")


def _matched(rows: DataFrame, lists: list, threshold: float, similar: bool) -> DataFrame:
    """VALUES with what each block of the list adds: a better mention or, if asked for, a better similarity."""
    for shipped in lists:

        def run(piece: pa.RecordBatch, shipped=shipped, prepared=[]) -> pa.RecordBatch:  # noqa: B006 - one list for each worker's stage
            if not prepared:
                prepared.append(Canon(shipped.value, threshold))
            best, scores = [], []
            for words, label, score in zip(piece.column("words").to_pylist(), piece.column("best").to_pylist(), piece.column("score").to_pylist()):
                new, fresh = prepared[0].mention(words)
                if new is None and similar:
                    new, fresh = prepared[0].similar(words)
                better = new is not None and (label is None or (-fresh, new.encode()) < (-score, label.encode()))
                best.append(new if better else label)
                scores.append(fresh if better else score)
            return pa.RecordBatch.from_arrays([piece.column("value"), piece.column("words"), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["value", "words", "best", "score"])

        rows = map_arrow(rows, run, VALUES, "value")
    return rows


def _plain(rows: DataFrame, mentioned: DataFrame, names: DataFrame) -> DataFrame:
    """VALUES without decoration: numbers, versions, and words that stand beside the mentions of several labels, unless a name has them."""
    known = names.select(F.explode("words").alias("word")).distinct()
    beside = mentioned.select("best", F.explode("words").alias("word")).join(known, "word", "left_anti").distinct()
    spare = beside.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BESIDE).select("word")
    each = rows.select("value", F.posexplode("words").alias("at", "word"))
    numbers = each.select("word").distinct().where(F.col("word").rlike(rf"^{NUMBER.pattern}\z")).join(known, "word", "left_anti")
    left = each.join(spare.unionByName(numbers).distinct(), "word", "left_anti")
    words = left.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))
    return words.select("value", "words", F.lit(None).cast("string").alias("best"), F.lit(0.0).alias("score"))


def canonical(df: DataFrame, value: str, names: DataFrame, label: str = "label", out: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``df`` with the label that each value stands for in ``out``, or ``unmatched``.

    names: rows of a label and, in its other string columns, printed names and aliases (null: none); the label is a name too.
    """
    texts = [f.name for f in names.schema.fields if isinstance(f.dataType, T.StringType)]
    listed = cut(names.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(F.array_compact(F.array(*texts))).alias("value")).distinct())
    blocks = max(1, -(-listed.count() // block))
    named = cut(_prepared(listed.select("value").distinct()).join(listed, "value").withColumn("block", F.pmod(F.xxhash64("label", "value"), F.lit(blocks))))
    lists = []
    for b in range(blocks):  # each block of the stated list against all values
        part = named.where(F.col("block") == b).select("label", "words").collect()
        lists.append(df.sparkSession.sparkContext.broadcast(sorted((r.label, " ".join(r.words)) for r in part)))
    kept = [f for f in df.columns if f != out or f == value]
    copied = "_typed" if value == out else value
    rows = df.select(*(F.col(c).alias(copied if c == value else c) for c in kept))
    values = rows.where(F.col(copied).isNotNull()).select(F.col(copied).alias("value")).distinct()
    first = cut(_matched(_prepared(values), lists, threshold, False))
    mentioned = first.where("best is not null")
    rest = cut(_plain(first.where("best is null"), mentioned, named))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few values still mean much work
    found = mentioned.unionByName(_matched(rest.repartition(tasks, "value"), lists, threshold, True)).where("best is not null").select(F.col("value").alias(copied), F.col("best").alias("_best"))
    label_of = F.when(F.col(copied).isNotNull(), F.coalesce("_best", F.lit(UNMATCHED)))
    return rows.join(found, copied, "left").select(*(F.col(c) for c in rows.columns if c != "_typed"), label_of.alias(out))
