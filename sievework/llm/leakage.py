"""Problem 7: evaluation texts leaking into training text, by an FM-index per shard of the corpus.

A shard is a bounded piece of a partition. Its documents are sequences of words (runs of letters and digits of the folded consistent
form), each closed by a mark of its own; over them stand a suffix array, from prefix doubling that sorts only what is still tied,
the Burrows-Wheeler transform in a wavelet matrix with block counts, and sampled suffix positions. Every run of ``words`` words of
the test items is searched backwards, all runs at once; what remains is located by walking back to a sample, and the places are
merged to removal spans. The corpus isn't shuffled. Different test texts go to the shards as sequences of words, in blocks of bounded
size; a shard is indexed once for each block of millions of words, and its phrases are taken from the sequences as they are searched.
Items are joined to the texts that were found, so a text that many items have is searched once.

Defined cases: documents and items without id or text are left out, items of fewer than ``words`` words can't leak; items delivered
twice count once; documents are taken row by row; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import one_per_id, pieces
from ..session import cut
from . import codepoints as C
from .spans import merged

WORDS, SHARD, SAMPLE = 12, 4 << 20, 8
BLOCK, PIECE, AT_ONCE = 8_000_000, 1_000_000, 100_000  # words in a block and of a text in one piece, phrases searched together


def word_sequences(codes: C.Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of every word of consistent forms, whatever its case."""
    if not len(codes.cp):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    inside = C.word_table()[codes.cp]
    edge = np.zeros(len(inside) + 1, bool)
    edge[codes.off] = True
    begins = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
    ends = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(codes.off, s, "right") - 1
    low = C.expand(codes, *C.folding())
    if len(low.cp) == len(codes.cp):
        return s, e, row, C.window_hashes(low.cp, s, e - s, 71)
    # folding lengthened some words: hash the folded stretch of each
    lengths = C.folding()[0][codes.cp].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    return s, e, row, C.window_hashes(low.cp, at[s], at[e] - at[s], 71)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; the last symbol of each document must be unique."""
    n = len(symbols)
    nxt = np.zeros(n, np.int64)
    nxt[:-1] = symbols[1:] + 1
    key = symbols.astype(np.int64) * (int(symbols.max(initial=0)) + 3) + nxt
    order = np.argsort(key, kind="stable")
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 2
    slots = np.arange(n)
    tied = ~(head & np.append(head[1:], True))
    slots = slots[tied]
    while len(slots):
        at = order[slots]
        further = at + h
        second = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        key = rank[at] * (n + 2) + second
        by = np.argsort(key, kind="stable")
        order[slots] = at[by]
        key = key[by]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        tied = ~(head & np.append(head[1:], True))
        slots = slots[tied]
        h *= 2
    return order


class WaveletMatrix:
    """Symbols by their bits, highest first, with rank by block counts and population counts."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits, self.zeros, self.words, self.counts = len(values), bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(self.n - int(self.counts[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block, within = i >> 6, (i & 63).astype(np.uint64)
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & ((np.uint64(1) << within) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i[k] values are symbol[k]."""
        low = np.zeros(len(symbol), np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self._ones(level, low), self._ones(level, i)
            low, i = np.where(one, self.zeros[level] + a, low - a), np.where(one, self.zeros[level] + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            one = ((self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._ones(level, i)
            out = out << 1 | one
            i = np.where(one, self.zeros[level] + ones, i - ones)
        return out


class FMIndex:
    def __init__(self, words: np.ndarray, row: np.ndarray, rows: int, sample: int = SAMPLE):
        """words: hashes of all words; row: their documents, ascending."""
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        sizes = np.bincount(row, minlength=rows)
        n = len(words) + rows
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(n, np.int64)
        real = np.ones(n, bool)
        real[ends] = False
        text[real] = ids + 1
        ordered = np.where(real, text + rows - 1, 0)
        ordered[ends] = np.arange(rows)
        suffixes = suffix_array(ordered)
        self.first = np.concatenate([[0, rows], rows + np.cumsum(np.bincount(ids, minlength=len(self.vocabulary)))])  # of symbol c: first[c]
        self.tree = WaveletMatrix(text[suffixes - 1], max(1, int(len(self.vocabulary)).bit_length()))
        starts = ends - sizes
        sampled = np.zeros(n, bool)
        sampled[::sample] = True
        sampled[starts] = True
        self.sampled = sampled[suffixes]
        self.samples = suffixes[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.n = n
        self.starts = starts

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (rows of word hashes)."""
        return self.search_symbols(self.symbols(patterns))

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Places of words in the vocabulary, -1 for those that the shard lacks."""
        if not len(self.vocabulary):
            return np.full(words.shape, -1, np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == words, k, -1)

    def search_symbols(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        patterns = k
        low, high = np.zeros(len(patterns), np.int64), np.where((k >= 0).all(1), self.n, 0)
        for step in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = k[live, step] + 1
            low[live], high[live] = self.first[c] + self.tree.rank(c, low[live]), self.first[c] + self.tree.rank(c, high[live])
        return low, np.maximum(high, low)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places in the text of rows of suffixes: back to the next sample, counting steps."""
        out, steps, live = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        at = at.copy()
        while len(live):
            here = self.sampled[at[live]]
            done = live[here]
            out[done] = self.samples[self.sample_rank[at[done]]] + steps[done]
            live = live[~here]
            c = self.tree.access(at[live])
            at[live] = self.first[c] + self.tree.rank(c, at[live])
            steps[live] += 1
        return out


def _sequences(texts: DataFrame, words: int, piece: int) -> DataFrame:
    """kid, n, words: the word hashes of different test texts, in pieces that overlap by all but one word of a phrase."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                _, _, row, h = word_sequences(C.consistent(C.decode(part.column("text"))))
                ends = np.searchsorted(row, np.arange(part.num_rows), "right")
                begins = np.searchsorted(row, np.arange(part.num_rows), "left")
                found = [(k, h[at : min(at + piece, b)]) for k, (a, b) in enumerate(zip(begins, ends)) for at in range(int(a), max(int(b) - words + 1, int(a)), piece - words + 1)]
                found = [(k, x) for k, x in found if len(x) >= words]
                yield pa.RecordBatch.from_arrays([part.column("kid").take(pa.array([k for k, _ in found], pa.int64())), pa.array([len(x) for _, x in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["kid", "n", "words"])

    return texts.mapInArrow(run, "kid binary, n long, words binary")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "id", text: str = "text", words: int = WORDS, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """doc_id, item_id, spans: each document and test item that have ``words`` consecutive words in common.

    spans: the merged stretches of the document, as start and end in characters of its consistent form.
    """
    named = one_per_id(items.where(F.col(text).isNotNull()), item_id, text).select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).withColumn("kid", F.unhex(F.md5("text")))
    named = cut(named)
    sequences = cut(_sequences(named.groupBy("kid").agg(F.min("text").alias("text")), words, max(piece, 2 * words)))
    total = sequences.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block))
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("kid", T.BinaryType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    result = None
    for b in range(blocks):  # each block of the stated test texts against all documents
        part = sequences.where(F.pmod(F.xxhash64("kid", "words"), F.lit(blocks)) == b).select("kid", "words").toArrow()
        kids = part.column("kid").combine_chunks().dictionary_encode()
        sizes = np.array([len(w) // 8 for w in part.column("words").to_pylist()], np.int64)
        flat = np.frombuffer(b"".join(part.column("words").to_pylist()), np.uint64)
        shipped = docs.sparkSession.sparkContext.broadcast((flat, sizes, np.asarray(kids.indices).astype(np.int64), kids.dictionary.to_pylist()))
        found = rows.mapInArrow(_searcher(shipped, words), schema)
        result = found if result is None else result.unionByName(found)
    if blocks > 1:
        spans = result.select("doc_id", "kid", F.explode("spans").alias("s")).select("doc_id", "kid", "s.start", "s.end")
        result = merged(spans, "doc_id", "kid").groupBy("doc_id", "kid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return result.join(named.select("item_id", "kid"), "kid").select("doc_id", "item_id", "spans")


def _searcher(shipped, words: int):
    def run(batches):
        flat, sizes, of, kids = shipped.value
        many = np.maximum(sizes - words + 1, 0)
        base = np.cumsum(sizes) - sizes
        start = np.repeat(base, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)  # of each phrase
        text = np.repeat(of, many)
        for batch in batches:
            for piece in pieces(batch, "text", rows=1 << 20, size=SHARD):
                form = C.consistent(C.decode(piece.column("text")))
                s, e, row, h = word_sequences(form)
                if not len(h) or not len(start):
                    continue
                index = FMIndex(h, row, piece.num_rows)
                symbols = index.symbols(flat)
                lacking = np.concatenate([[0], np.cumsum(symbols < 0)])
                live = np.flatnonzero(lacking[start + words] == lacking[start])  # phrases all of whose words the shard has
                found = []
                for at in range(0, len(live), AT_ONCE):
                    some = live[at : at + AT_ONCE]
                    low, high = index.search_symbols(symbols[start[some][:, None] + np.arange(words)])
                    hits = high - low
                    k = np.repeat(np.arange(len(some)), hits)
                    place = index.locate(low[k] + np.arange(len(k)) - np.repeat(np.cumsum(hits) - hits, hits))
                    found.append(np.stack([place, text[some[k]]], 1))
                hit = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
                if len(hit):
                    yield _spans_of(piece, index, form, hit, s, e, words, kids)

    return run


def _spans_of(piece: pa.RecordBatch, index: FMIndex, form: C.Codes, hit: np.ndarray, s: np.ndarray, e: np.ndarray, words: int, kids: list) -> pa.RecordBatch:
    """Merged stretches of each document and test text from the places of phrases."""
    doc = np.searchsorted(index.starts, hit[:, 0], "right") - 1
    word, who = hit[:, 0] - doc, hit[:, 1]  # each earlier document has one mark
    start, end = s[word], e[word + words - 1]
    order = np.lexsort((start, who, doc))
    doc, who, start, end = doc[order], who[order], start[order], end[order]
    pair = np.concatenate([[True], (doc[1:] != doc[:-1]) | (who[1:] != who[:-1])])
    # ends rise with starts within a pair, so a span ends where the next start lies beyond the last end
    gap = pair.copy()
    gap[1:] |= start[1:] > end[:-1]
    first = np.flatnonzero(gap)
    last = np.append(first[1:], len(gap)) - 1
    pairs = np.flatnonzero(pair)
    base = form.off[doc[first]]
    spans = pa.StructArray.from_arrays([pa.array(start[first] - base), pa.array(end[last] - base)], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(first, pairs), len(first)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(doc[pairs])), pa.array([kids[x] for x in who[pairs]], pa.binary()), lists], ["doc_id", "kid", "spans"])


def removal_spans(found: DataFrame) -> DataFrame:
    """doc_id, start, end: what to remove of each document, over all items that leaked into it."""
    return merged(found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end"), "doc_id")
