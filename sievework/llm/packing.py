"""Problem 6: filling fixed-capacity containers with items, by a grouping genetic algorithm on islands.

Sizes are tokens of a public tokenizer (byte-level BPE, 50,257 entries). A document longer than a container fills whole containers
by itself and leaves a rest. Documents and rests are dealt to blocks of bounded size; each block is one packing problem, worked on by
several islands. An island keeps a population of packings; crossover takes whole well-filled containers of one parent into a copy of
the other, takes out the containers that hold any of their items, and puts the displaced items back by best fit; mutation empties
the worst containers. After each round of generations every island sends its best packing to the next one of its block. In
the end the block's best packing stays, its badly filled containers are opened again, and their items are packed in new blocks drawn
over all of them.

Defined cases: documents without id or text are left out; empty texts take a place of 0 tokens; a repeated id keeps its least
text; a capacity without a positive number has no containers; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import map_arrow, one_per_id
from ..session import cut

TOKENIZER = "byte_bpe_50k.tiktoken"
BLOCK, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 512, 3, 2, 12, 6
WELL_FILLED, BUDGETS = 0.98, 1000
VOCABULARY = 64 << 20  # bytes of a vocabulary file at most


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_tokenizer(path: str) -> tuple[str, str, bytes]:
    """Name, pattern and vocabulary of a tokenizer, read by the driver; a file of bounded size that goes to the workers as it is."""
    import public_tokenizers

    if os.path.getsize(path) > VOCABULARY:
        raise ValueError(f"{path} is no vocabulary")
    with open(path, "rb") as f:
        return os.path.basename(path), public_tokenizers.PATTERN, f.read()


def load_tokenizer(name: str, pattern: str, data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """doc_id, tokens: of whole texts, one row for each id."""
    kind = docs.schema[doc_id].dataType
    held: list = []
    shipped = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(load_tokenizer(*shipped.value))
        counts = [len(held[0].encode_ordinary(t)) for t in piece.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "tokens"])

    rows = one_per_id(docs.where(F.col(text).isNotNull()), doc_id, text).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, run, T.StructType([T.StructField("doc_id", kind), T.StructField("tokens", T.LongType())]), "text")


class Packing:
    """Containers as a number for each item; loads by container."""

    def __init__(self, sizes: np.ndarray, capacity: int, of: np.ndarray, loads: list[int]):
        self.sizes, self.capacity, self.of, self.loads = sizes, capacity, of, loads

    def cost(self) -> float:
        """Containers used, less a little for uneven filling: of equal numbers, the one with fuller containers is better."""
        full = np.asarray(self.loads, float) / self.capacity
        return len(full) - float((full**2).mean()) if len(full) else 0.0

    def copy(self) -> Packing:
        return Packing(self.sizes, self.capacity, self.of.copy(), list(self.loads))

    def members(self) -> list[np.ndarray]:
        order = np.argsort(self.of, kind="stable")
        return np.split(order, np.searchsorted(self.of[order], np.arange(1, len(self.loads))))


def best_fit(sizes: np.ndarray, capacity: int, items: np.ndarray, of: np.ndarray, loads: list[int]) -> None:
    """Put items, largest first as given, where the least room stays; rooms are kept in order."""
    rooms = sorted((capacity - x, k) for k, x in enumerate(loads))
    for i in items.tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            room, k = capacity, len(loads)
            loads.append(0)
        loads[k] += size
        of[i] = k
        bisect.insort(rooms, (room - size, k))


def pack(sizes: np.ndarray, capacity: int, rng: np.random.Generator | None = None) -> Packing:
    """Best fit, largest first; with rng, in an order shaken by a tenth."""
    keys = sizes * (1 + 0.1 * rng.standard_normal(len(sizes))) if rng is not None else sizes
    of, loads = np.zeros(len(sizes), np.int64), []
    best_fit(sizes, capacity, np.argsort(-keys, kind="stable"), of, loads)
    return Packing(sizes, capacity, of, loads)


def _without(p: Packing, gone: np.ndarray) -> tuple[Packing, np.ndarray]:
    """A packing without some containers, and the items that were in them, largest first."""
    drop = np.zeros(len(p.loads), bool)
    drop[gone] = True
    out = np.flatnonzero(drop[p.of])
    number = np.cumsum(~drop) - 1
    rest = Packing(p.sizes, p.capacity, np.where(drop[p.of], -1, number[p.of]), [x for x, d in zip(p.loads, drop.tolist()) if not d])
    return rest, out[np.argsort(-p.sizes[out], kind="stable")]


def cross(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """A copy of b with well-filled containers of a in it."""
    loads = np.asarray(a.loads)
    good = np.flatnonzero(loads >= np.quantile(loads, 0.6))
    taken = rng.permutation(good)[: max(1, int(len(loads) * rng.uniform(0.1, 0.4)))]
    inject = np.isin(a.of, taken)
    child, out = _without(b, np.unique(b.of[inject]))
    names = np.cumsum(np.isin(np.arange(len(a.loads)), taken)) - 1
    child.of[inject] = len(child.loads) + names[a.of[inject]]
    child.loads += loads[np.sort(taken)].tolist()
    best_fit(child.sizes, child.capacity, out[~inject[out]], child.of, child.loads)
    return child


def mutate(p: Packing, rng: np.random.Generator) -> Packing:
    """Open the emptiest containers and a few others, and put their items back in a shaken order."""
    loads = np.asarray(p.loads)
    few = max(1, len(loads) // 12)
    gone = np.union1d(np.argsort(loads, kind="stable")[:few], rng.integers(0, len(loads), few))
    child, out = _without(p, gone)
    best_fit(p.sizes, p.capacity, out[np.argsort(-p.sizes[out] * (1 + 0.3 * rng.random(len(out))), kind="stable")], child.of, child.loads)
    return child


def evolve(sizes: np.ndarray, capacity: int, seeds: list[np.ndarray], rng: np.random.Generator, generations: int = GENERATIONS, population: int = POPULATION) -> Packing:
    """The best packing of an island after some generations; seeds: packings of immigrants and of the island's own past."""
    if not len(sizes):
        return Packing(sizes, capacity, np.zeros(0, np.int64), [])
    least = -(-int(sizes.sum()) // capacity)
    pool = [Packing(sizes, capacity, s, np.bincount(s, weights=sizes).astype(np.int64).tolist()) for s in seeds]
    pool.append(pack(sizes, capacity))
    while len(pool) < population:
        pool.append(pack(sizes, capacity, rng))
    for _ in range(generations):
        pool.sort(key=Packing.cost)
        if len(pool[0].loads) <= max(1, least):
            break
        a, b = (pool[min(rng.integers(0, len(pool), 2))] for _ in range(2))
        child = cross(a, b, rng)
        if rng.random() < 0.5:
            child = mutate(child, rng)
        pool[-1] = child if child.cost() < pool[-1].cost() else mutate(pool[0], rng)
    return min(pool, key=Packing.cost)


STATE = "budget_id string, capacity long, block long, island int, items array<long>, sizes array<long>, packings array<array<int>>"


def _round(number: int, generations: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                rng = np.random.default_rng([number, r["island"], abs(r["block"]) % 2**31, r["capacity"]])
                best = evolve(sizes, r["capacity"], [np.array(p, np.int64) for p in r["packings"]], rng, generations)
                r["packings"] = [best.of.tolist()]
                yield pa.RecordBatch.from_pylist([r], schema=batch.schema)

    return run


def _evolved(items: DataFrame, block: int, islands: int, rounds: int, generations: int, salt: int) -> DataFrame:
    """budget_id, capacity, item, size, bin: each block's best packing. items: budget_id, capacity, item (long, unique), size."""
    counts = items.groupBy("budget_id").agg(F.count(F.lit(1)).alias("n"))
    dealt = items.join(counts, "budget_id").withColumn("block", F.pmod(F.xxhash64("item", F.lit(salt)), F.ceil(F.col("n") / block)))
    blocks = dealt.groupBy("budget_id", "capacity", "block").agg(F.sort_array(F.collect_list(F.struct("item", "size"))).alias("all"))
    state = blocks.select("budget_id", "capacity", "block", F.explode(F.array(*(F.lit(k) for k in range(islands)))).alias("island"), F.col("all.item").alias("items"), F.col("all.size").alias("sizes"), F.array().cast("array<array<int>>").alias("packings"))
    for number in range(rounds):
        state = cut(state.repartition("budget_id", "block", "island").mapInArrow(_round(salt * 100 + number, generations), STATE))
        if number + 1 < rounds:  # each island's best goes to the next one
            sent = state.select("budget_id", "block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("packings")[0].alias("guest"))
            state = state.join(sent, ["budget_id", "block", "island"]).select("budget_id", "capacity", "block", "island", "items", "sizes", F.concat("packings", F.array("guest")).alias("packings"))
    used = F.array_max(F.col("packings")[0]) + 1
    best = state.groupBy("budget_id", "capacity", "block").agg(F.min_by(F.struct("items", "sizes", F.col("packings")[0].alias("of")), F.struct(used, "island")).alias("best"))
    return best.select("budget_id", "capacity", "block", F.explode(F.arrays_zip("best.items", "best.sizes", "best.of")).alias("x")).select("budget_id", "capacity", "block", F.col("x.items").alias("item"), F.col("x.sizes").alias("size"), F.col("x.of").alias("bin"))


def packed(docs: DataFrame, budgets: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, block: int = BLOCK, islands: int = ISLANDS, rounds: int = ROUNDS, generations: int = GENERATIONS) -> DataFrame:
    """budget_id, capacity_tokens, container, place, doc_id, part, tokens.

    One row for each document and capacity; a document longer than the capacity has a row for each of its parts (part 0, 1, ...;
    all but the last fill a container). container is unique within a budget; place counts from 0.
    """
    sized = cut(token_counts(docs, doc_id, text, path or tokenizer_path()).withColumn("item", F.monotonically_increasing_id()))
    caps = budgets.select(F.col("budget_id").cast("string").alias("budget_id"), F.col("capacity_tokens").cast("long").alias("capacity")).where("budget_id is not null and capacity > 0").groupBy("budget_id").agg(F.min("capacity").alias("capacity")).limit(BUDGETS + 1).collect()
    if len(caps) > BUDGETS:
        raise ValueError(f"more than {BUDGETS} budgets in one call")
    listed = F.array(*(F.struct(F.lit(r.budget_id).alias("budget_id"), F.lit(r.capacity).cast("long").alias("capacity")) for r in caps)) if caps else F.array().cast("array<struct<budget_id:string,capacity:bigint>>")
    each = sized.select("item", "tokens", F.explode(listed).alias("b")).select("item", "tokens", "b.budget_id", "b.capacity")
    pieces = each.select("budget_id", "capacity", "item", F.expr("tokens % capacity").alias("rest"), F.expr("tokens div capacity").alias("whole"), "tokens")
    full = pieces.where("whole > 0").select("budget_id", "capacity", "item", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("part")).select("budget_id", "capacity", F.concat_ws("-", F.lit("f"), "item", "part").alias("container"), "item", "part", F.col("capacity").alias("size"))
    rests = cut(pieces.where("rest > 0 or whole = 0").select("budget_id", "capacity", "item", F.col("rest").alias("size"), F.col("whole").alias("part")))
    first = cut(_evolved(rests.select("budget_id", "capacity", "item", "size"), block, islands, rounds, generations, 1))
    loads = first.groupBy("budget_id", "block", "bin").agg(F.sum("size").alias("load"))
    marked = first.join(loads, ["budget_id", "block", "bin"])
    good = marked.where(F.col("load") >= WELL_FILLED * F.col("capacity")).select("budget_id", "capacity", F.concat_ws("-", F.lit("a"), "block", "bin").alias("container"), "item", "size")
    again = cut(marked.where(F.col("load") < WELL_FILLED * F.col("capacity")).select("budget_id", "capacity", "item", "size"))
    second = _evolved(again, 4 * block, islands, 1, generations, 2).select("budget_id", "capacity", F.concat_ws("-", F.lit("b"), "block", "bin").alias("container"), "item", "size")
    small = good.unionByName(second).join(rests.select("budget_id", "item", "part"), ["budget_id", "item"]).select("budget_id", "capacity", "container", "item", "part", "size")
    every = full.unionByName(small).join(sized.select("item", F.col("doc_id")), "item")
    place = F.row_number().over(Window.partitionBy("budget_id", "container").orderBy(F.desc("size"), "item")) - 1
    return every.select("budget_id", F.col("capacity").alias("capacity_tokens"), "container", place.alias("place"), "doc_id", "part", F.col("size").alias("tokens"))


def fill(rows: DataFrame) -> DataFrame:
    """For each budget: containers, the least number any packing needs, and the share of the capacity that is used."""
    sums = rows.groupBy("budget_id", "capacity_tokens").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return sums.select("budget_id", "capacity_tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("used"))
