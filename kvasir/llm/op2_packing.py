"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Documents become token pieces of at most ``CAPACITY``; full pieces are sequences of their own.  The
others are dealt by hash to shards of about ``SHARD`` pieces.  Each shard evolves on ``ISLANDS``
islands, tasks of their own: crossover injects whole well-filled bins of one parent into the other,
drops the bins that would repeat a piece, and best-fits the displaced pieces, longest first.  After each
epoch an island's elite migrates to the next island of its shard through a shuffle.  The first population
is best fit decreasing and best fits in orders that stray from it; an island rests once it reaches the
shard's lower bound, no search can pass it.  Bins that stay loose are opened again and their pieces dealt
to new shards, ``LEVELS`` times, so that loose ends of many shards meet.  A shard's size, not the
input's, bounds what a task holds.

Defined results: a null text is empty (its piece is the end id alone); rows that repeat a doc_id, or
whose doc_id is null, are packed as documents of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.llm import tokens
from kvasir.llm.common import sliced, stage, table

CAPACITY = 2048
SHARD = 2048
ISLANDS = 4
EPOCHS = 3
GENERATIONS = 100
POPULATION = 16
LEVELS = 2
LOOSE = 0.97

_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, kind: str = "word", end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts: ``uid, doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids`` (little-endian u32).  Stage it: ``uid`` numbers a task's rows."""
    spec = tokens.source(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(spec.value, kind)
        end = np.array([end_id], enc.dtype).tobytes()
        uid = TaskContext.get().partitionId() << 32
        for part in sliced(batches, 1):
            out: list[tuple] = []
            for doc_id, raw in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                ids = np.frombuffer(raw + end, enc.dtype)
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity].astype("<u4").tobytes()
                    out.append((uid, doc_id, piece, at, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
                    uid += 1
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 + keep_ids]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds[: len(names)])], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES + ", ids binary" * keep_ids)


class Packing:
    """Bins of item numbers, with their fills.  Once made, others share its bins: ``insert`` takes copies of those it adds to."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None, fill: list[int] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []
        self.fill = [sum(map(sizes.__getitem__, b)) for b in self.bins] if fill is None else fill
        self._worth: tuple[int, int] | None = None

    def insert(self, items: list[int]) -> Packing:
        """Best fit: each item, in the order given, to the fullest bin that can take it."""
        room = sorted([(self.capacity - f, k) for k, f in enumerate(self.fill) if f < self.capacity])
        self._worth = None
        owned: set[int] = set()
        for i in items:
            size = self.sizes[i]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                free, k = room.pop(at)
                if k not in owned:
                    self.bins[k] = list(self.bins[k])
                    owned.add(k)
                self.bins[k].append(i)
            else:
                free, k = self.capacity, len(self.bins)
                self.bins.append([i])
                owned.add(k)
                self.fill.append(0)
            self.fill[k] += size
            if free > size:
                insort(room, (free - size, k))
        return self

    def worth(self) -> tuple[int, int]:
        """Fewer bins first, then more uneven fills: full bins beside nearly empty ones."""
        if self._worth is None:
            self._worth = (len(self.bins), -sum([f * f for f in self.fill]))
        return self._worth

    def assignment(self) -> list[int]:
        out = [0] * len(self.sizes)
        for k, b in enumerate(self.bins):
            for i in b:
                out[i] = k
        return out


def _from_assignment(sizes: list[int], capacity: int, of: list[int]) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(of) + 1)]
    for i, k in enumerate(of):
        bins[k].append(i)
    return Packing(sizes, capacity, bins)


def crossover(into: Packing, giver: Packing, rng: np.random.Generator) -> Packing:
    """``into`` with some of the giver's fullest bins: bins that share a piece with them go, and the rest of their pieces is best-fitted."""
    ranked = sorted(range(len(giver.bins)), key=giver.fill.__getitem__, reverse=True)
    best = ranked[: max(1, len(ranked) // 2)]
    a, b = sorted(rng.integers(0, len(best) + 1, 2).tolist())
    chosen = best[a:b] or best[:1]
    bins, fill = [giver.bins[k] for k in chosen], [giver.fill[k] for k in chosen]
    held = {i for x in bins for i in x}
    displaced = []
    for x, f in zip(into.bins, into.fill):
        if held.isdisjoint(x):
            bins.append(x)
            fill.append(f)
        else:
            displaced.extend([i for i in x if i not in held])
    displaced.sort(key=into.sizes.__getitem__, reverse=True)
    return Packing(into.sizes, into.capacity, bins, fill).insert(displaced)


def mutate(p: Packing, rng: np.random.Generator) -> Packing:
    """Opens the loosest bins and a few others, and best-fits their pieces."""
    n = len(p.bins)
    loose = set(sorted(range(n), key=p.fill.__getitem__)[: max(2, n // 10)]) | set(rng.integers(0, n, max(1, n // 20)).tolist())
    out = [i for k in loose for i in p.bins[k]]
    out.sort(key=p.sizes.__getitem__, reverse=True)
    return Packing(p.sizes, p.capacity, [b for k, b in enumerate(p.bins) if k not in loose], [f for k, f in enumerate(p.fill) if k not in loose]).insert(out)


def evolve(sizes: list[int], population: list[Packing], generations: int, rng: np.random.Generator, capacity: int) -> list[Packing]:
    """Steady state: each generation a child of two parents, mutated, replaces the worst if it is better; the best comes first."""
    bound = math.ceil(sum(sizes) / capacity)
    population.sort(key=Packing.worth)
    for _ in range(generations):
        if len(population[0].bins) <= bound:
            break
        a, b = rng.permutation(len(population))[:2].tolist()
        child = mutate(crossover(population[a], population[b], rng), rng)
        if child.worth() < population[-1].worth():
            population[-1] = child
            population.sort(key=Packing.worth)
    return population


def first_population(sizes: list[int], rng: np.random.Generator, capacity: int) -> list[Packing]:
    """Best fit decreasing, and best fits in orders that stray from it."""
    base = np.array(sizes, float)
    out = []
    for k in range(POPULATION):
        noise = 1 if not k else rng.uniform(0.8, 1.2, len(sizes))
        out.append(Packing(sizes, capacity).insert(np.argsort(-base * noise, kind="stable").tolist()))
        if not k and len(out[0].bins) <= math.ceil(sum(sizes) / capacity):
            break  # nothing can be better
    return out


_STATE = "shard long, island int, sizes array<int>, population array<array<int>>, elite array<int>, n_bins int, n_first int, bound int"


def _epoch(capacity: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng = np.random.default_rng([seed, row["shard"] & 0x7FFFFFFFFFFFFFFF, row["island"]])
                sizes = row["sizes"]
                was = [_from_assignment(sizes, capacity, a) for a in [*(row["population"] or []), *([row["elite"]] if row["elite"] else [])]]
                was = was or first_population(sizes, rng, capacity)  # best fit decreasing comes first
                found = evolve(sizes, list(was), GENERATIONS, rng, capacity)[:POPULATION]
                done = found[0].assignment()
                first = row["n_first"] or len(was[0].bins)
                yield pa.RecordBatch.from_pylist(
                    [{"shard": row["shard"], "island": row["island"], "sizes": sizes, "population": [p.assignment() for p in found], "elite": done,
                      "n_bins": len(found[0].bins), "n_first": first, "bound": math.ceil(sum(sizes) / capacity)}],
                    pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())), ("population", pa.list_(pa.list_(pa.int32()))), ("elite", pa.list_(pa.int32())),
                               ("n_bins", pa.int32()), ("n_first", pa.int32()), ("bound", pa.int32())]),
                )

    return run


def _pack_level(items: DataFrame, n: int, level: int, capacity: int, shard_size: int) -> tuple[DataFrame, DataFrame]:
    """``uid, length, shard, bin`` of ``items(uid, length)``, dealt to ``ceil(n / shard_size)`` shards; and per shard its bound, bins of best fit decreasing, and bins."""
    spark = items.sparkSession
    n_shards = max(1, -(-n // shard_size))
    shards = stage(
        items.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n_shards)))
        .groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("size")))).alias("items")),  # about shard_size
        "op2-shards",
    )
    tasks = max(spark.sparkContext.defaultParallelism, min(n_shards * ISLANDS, 4 * spark.sparkContext.defaultParallelism, n_shards))
    state = shards.select("shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.col("items.size").alias("sizes"),
                          F.lit(None).cast("array<array<int>>").alias("population"), F.lit(None).cast("array<int>").alias("elite"), F.lit(None).cast("int").alias("n_first"))
    done = None
    for epoch in range(EPOCHS):
        if epoch:
            # a shard rests when one of its islands has reached the bound
            resting = state.groupBy("shard").agg(F.min("n_bins").alias("n"), F.min("bound").alias("bound")).filter("n <= bound").select("shard")
            rested, state = state.join(resting, "shard", "left_semi"), state.join(resting, "shard", "left_anti")
            done = rested if done is None else done.unionByName(rested)
            if state.isEmpty():
                break
            elites = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), "elite")
            state = state.drop("elite").join(elites, ["shard", "island"])
        state = stage(state.select("shard", "island", "sizes", "population", "elite", "n_first").repartition(tasks, "shard", "island").mapInArrow(_epoch(capacity, level * 97 + epoch), _STATE), "op2-epoch")
    state = state if done is None else done.unionByName(state)
    best = state.groupBy("shard").agg(F.min_by("elite", F.struct("n_bins", "island")).alias("of"), F.min("bound").alias("bound"), F.max("n_first").alias("n_first"), F.min("n_bins").alias("n_bins"))
    best = stage(best, "op2-best")
    placed = shards.join(best, "shard").select("shard", F.explode(F.arrays_zip(F.col("items.uid").alias("uid"), F.col("items.size").alias("size"), F.col("of").alias("bin"))).alias("x"))
    placed = stage(placed.select("shard", F.col("x.uid").alias("uid"), F.col("x.size").cast("long").alias("length"), F.col("x.bin").alias("bin")), "op2-placed")
    return placed, best.drop("of")


def pack(items: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD, report: list | None = None) -> DataFrame:
    """``uid, sequence_id, offset`` of staged ``items(uid, length)``, every length from 1 to ``capacity``.

    ``report``, if given, receives for each level its number of shards, of those that were searched, and
    the sums of lower bounds, of bins by best fit decreasing, and of bins found.
    """
    full = items.filter(F.col("length") >= capacity).select("uid", (F.col("uid") + F.lit(7 << 56)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo, out = items.filter(F.col("length") < capacity).select("uid", "length"), [full]
    for level in range(LEVELS + 1):
        n = todo.count()
        if not n:
            break
        placed, shards = _pack_level(todo, n, level, capacity, shard_size)
        if report is not None:
            report.append(shards.agg(F.count(F.lit(1)).alias("shards"), F.count_if(F.expr("n_first > bound")).alias("searched"), F.sum("bound").alias("bound"), F.sum("n_first").alias("best_fit"), F.sum("n_bins").alias("bins")).first().asDict())
        bins = placed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"), F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("own"))  # capacity pieces at most
        last = level == LEVELS or n <= shard_size
        shut = bins if last else bins.filter(F.col("fill") >= int(LOOSE * capacity))
        named = shut.select((F.lit(level << 56) + F.shiftleft("shard", 20) + F.col("bin")).alias("sequence_id"), "own")
        with_offsets = named.select("sequence_id", F.posexplode("own").alias("k", "x"), "own").select(
            F.col("x.uid").alias("uid"), "sequence_id",
            F.expr("aggregate(slice(own, 1, k), 0L, (a, y) -> a + y.length)").alias("offset"))
        out.append(stage(with_offsets, "op2-bins"))
        if last:
            break
        todo = bins.filter(F.col("fill") < int(LOOSE * capacity)).select(F.explode("own").alias("x")).select("x.uid", "x.length")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def pack_documents(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """All pieces of ``docs`` with ``sequence_id`` and ``offset``; with ``keep_ids`` also their token ids."""
    cut = stage(pieces(docs, tokenizer_path, keep_ids=keep_ids), "op2-pieces")
    return cut.join(pack(cut.select("uid", "length")), "uid").drop("uid")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_packing": op2_packing}
SQL: dict[str, str] = {}
