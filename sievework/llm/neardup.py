"""Problem 4: near-duplicate records with small edits, by Bayesian pruning of candidates.

Candidates come from the rarest pieces (``segments``), which lose no pair that reaches the threshold. Each text has a signature of MinHash
values over its five-character pieces. For a candidate pair the values are compared block by block; after each block the
posterior probability that the similarity reaches the threshold, given the matches so far and a uniform prior, decides: below the
tolerance the pair is dropped. What is left after the last block is verified by its exact score.

Defined cases: rows without id or text are left out; texts with one key score 1 with one another (empty texts too); rows delivered
twice count once; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import map_arrow
from ..operators import segments as S
from ..session import cut
from . import codepoints as C
from . import grams as G
from .components import components

HASHES, BLOCK, TOLERANCE = 128, 16, 1e-6
ALIKE = 0.7  # candidates whose parities rule out this similarity aren't made; between it and the threshold the posterior decides


def signatures(codes: C.Codes, hashes: int = HASHES) -> np.ndarray:
    """MinHash values of every text (rows x hashes, 32 bits); all ones for an empty text."""
    pack = G.distinct(G.packed(codes)[0])
    row, x = G.rows_of(pack), C.mix(pack & np.uint64((1 << (64 - G.ROW_BITS)) - 1), 51)
    out = np.full((len(codes.off) - 1, hashes), 0xFFFFFFFF, np.uint32)
    if not len(pack):
        return out
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    factors = C.mix(np.arange(hashes, dtype=np.uint64), 52) | np.uint64(1)
    shifts = C.mix(np.arange(hashes, dtype=np.uint64), 53)
    for k in range(hashes):
        out[row[starts], k] = np.minimum.reduceat(((x * factors[k] + shifts[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def least_matches(t: float, tolerance: float, hashes: int = HASHES, block: int = BLOCK) -> np.ndarray:
    """After each block, the fewest matches with which P(similarity >= t | matches) is at least the tolerance.

    Under a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose mass above t is the probability
    of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(block, hashes + 1, block):
        mass, m = 0.0, -1
        while mass < tolerance and m < n:
            m += 1
            mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def pruned(a: np.ndarray, b: np.ndarray, t: float, tolerance: float, block: int = BLOCK) -> np.ndarray:
    """Indices of the pairs of signatures that outlive every block."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(t, tolerance, a.shape[1], block)):
        part = slice(k * block, (k + 1) * block)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive


def similar_keys(texts: DataFrame, t: float = G.THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """kid_a, kid_b, score: pairs of different key texts (S.TEXTS) that score t or more."""
    pairs = S.candidates(texts, texts, t, same=True, alike=min(t, ALIKE)).select("kid_a", "kid_b")

    def sign(piece: pa.RecordBatch) -> pa.RecordBatch:
        values = signatures(C.decode(piece.column("key"))).tobytes()
        return pa.RecordBatch.from_arrays([piece.column("kid"), piece.column("key"), pa.Array.from_buffers(pa.binary(4 * HASHES), piece.num_rows, [None, pa.py_buffer(values)]).cast(pa.binary())], ["kid", "key", "sig"])

    signed = cut(map_arrow(texts.select("kid", "key"), sign, "kid binary, key string, sig binary", "key", size=1 << 19))
    rows = pairs.join(signed.toDF("kid_a", "key_a", "sig_a"), "kid_a").join(signed.toDF("kid_b", "key_b", "sig_b"), "kid_b")

    def verify(piece: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(piece.column(c).to_pylist()), np.uint32).reshape(piece.num_rows, HASHES) for c in ("sig_a", "sig_b"))
        rest = piece.take(pa.array(pruned(a, b, t, tolerance)))
        score = G.scores(C.decode(rest.column("key_a")), C.decode(rest.column("key_b"))) if rest.num_rows else np.zeros(0)
        keep = pa.array(np.flatnonzero(score >= t - 1e-12))
        return pa.RecordBatch.from_arrays([rest.column("kid_a").take(keep), rest.column("kid_b").take(keep), pa.array(score).take(keep)], ["kid_a", "kid_b", "score"])

    return map_arrow(rows.select("kid_a", "kid_b", "key_a", "key_b", "sig_a", "sig_b"), verify, "kid_a binary, kid_b binary, score double", "key_a", "key_b", size=1 << 20)


def _prepared(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    rows = cut(G.keyed(df, id_col, text))
    return rows.select("id", "kid"), cut(S.with_counts(rows))


def near_duplicates(df: DataFrame, id_col: str = "id", text: str = "text", t: float = G.THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """id_a, id_b (in byte order), score: every pair of rows that scores t or more."""
    ids, texts = _prepared(df, id_col, text)
    near = similar_keys(texts, t, tolerance)
    # copies of one text: the pairs are asked for, so their number is the result's own
    many = ids.groupBy("kid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("kid").alias("kid_a"), F.col("kid").alias("kid_b"), F.lit(1.0).alias("score"))
    return G.expand_pairs(near.unionByName(many), ids, ids, "score")


def groups(df: DataFrame, id_col: str = "id", text: str = "text", t: float = G.THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """id, class_id, members, links, copies: one row for each record, also those that are alone.

    class_id is the least id of the records linked to one another, directly or over others; links counts the other texts that
    score t with this one's, copies the records of equal key. Copies aren't expanded into pairs.
    """
    ids, texts = _prepared(df, id_col, text)
    near = cut(similar_keys(texts, t, tolerance))
    links = near.select(F.col("kid_a").alias("kid")).unionByName(near.select(F.col("kid_b").alias("kid"))).groupBy("kid").agg(F.count(F.lit(1)).alias("links"))
    least = ids.groupBy("kid").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).join(links, "kid", "left")
    named = near.join(least.select(F.col("kid").alias("kid_a"), F.col("first").alias("a")), "kid_a").join(least.select(F.col("kid").alias("kid_b"), F.col("first").alias("b")), "kid_b").select("a", "b")
    classes = components(named)
    keyed = least.join(classes, F.col("first") == F.col("node"), "left").select("kid", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "first").alias("class_id"))
    sizes = keyed.groupBy("class_id").agg(F.sum("copies").alias("members"))
    return ids.join(keyed, "kid").join(sizes, "class_id").select("id", "class_id", "members", "links", "copies")
