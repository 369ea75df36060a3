"""Exact top-k inner products through a pivot-distance index.

Inner products become distances: a vector x gets one more coordinate, sqrt(M - |x|^2) with M the largest
squared norm, and a query gets 0 there, so |q' - x'|^2 = |q|^2 + M - 2<q, x>.  Every vector is keyed by
its nearest pivot and its distance to it; rows are range-partitioned and sorted by that key and cut into
annuli of one pivot (``ANNULUS`` vectors), several to a part.  For a query at distance d from the pivot, a
vector in the annulus [lo, hi] is at least max(d - hi, lo - d) away (triangle inequality), which bounds
its score from above.

A query starts with the k-th best score in the pivots' sample, a lower bound of its result.  Blocks of
queries meet only the parts whose annuli can still reach it; within a part the annuli are expanded in
order of their bounds, and the expansion stops when no bound reaches the k-th best score so far.  The
pivots come from a bounded sample (``SAMPLE`` rows); every row is indexed, and results are exact.

Defined results: vectors that are null, hold a null or a non-finite component, or have another length
than most take no part, nor do rows without vec_id; rows that repeat a vec_id are all candidates of the
other queries, never of their own id, and form one query (their least vector); ties go to the smaller
vec_id; fewer than k candidates are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kvasir.llm.common import stage, table

TOP = 20
SAMPLE = 4096
PIVOTS = 64
ANNULUS = 512
PART = 8192
QUERY_BLOCK = 256
_NONE = int(np.iinfo(np.int64).min)


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """``vec_id, v``: integer vectors, of valid rows alone."""
    ok = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = vectors.filter("vec_id IS NOT NULL").filter(F.expr(f"coalesce({ok}, false)"))
    return rows.select(F.col("vec_id").cast("long"), F.expr(f"transform(embedding, x -> floor({scale}D * cast(x AS double)))").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    gap = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(gap, 0))


def _augmented(v: np.ndarray, largest: float, query: bool = False) -> np.ndarray:
    extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(largest - (v * v).sum(1), 0))
    return np.column_stack([v, extra])


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first points of the sample."""
    chosen, near = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return sample[chosen]


def _kind(bound: float) -> tuple[str, str]:
    """Narrowest stored and computing types for integers whose squares sum to ``bound`` at most; sums are exact in the latter."""
    stored = "<i1" if bound <= 127**2 else "<i2" if bound <= 32767**2 else "<i8"
    return stored, "f4" if bound < 1 << 24 else "f8" if bound < 1 << 53 else "O"


class Best:
    """The k best (score, id) of each query; ties to the smaller id."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.score = np.full((len(floor), k), _NONE)
        self.ids = np.full((len(floor), k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` ascend; ``scores`` holds the least integer where a vector is no candidate."""
        if len(ids) > self.k:
            order = _largest(scores, self.k)
            scores, cand = np.take_along_axis(scores, order, 1), ids[order]
        else:
            cand = np.broadcast_to(ids, scores.shape)
        s = np.concatenate([self.score[rows], scores], 1)
        c = np.concatenate([self.ids[rows], np.where(scores == _NONE, np.iinfo(np.int64).max, cand)], 1)
        order = np.lexsort((c, -np.maximum(s, -(1 << 62))), axis=1)[:, : self.k]
        self.score[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(c, order, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])


def _largest(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, ties to the earlier column."""
    m = scores.shape[1]
    if m >= 1 << 13 or np.maximum(np.abs(np.maximum(scores, -(1 << 49))).max(), 0) >= 1 << 50:
        return np.lexsort((np.broadcast_to(np.arange(m), scores.shape), -np.maximum(scores, -(1 << 62))), axis=1)[:, :k]
    key = np.maximum(scores, -(1 << 49)) * m + np.arange(m - 1, -1, -1)  # unique in a row
    return np.argpartition(key, -k, axis=1)[:, -k:]


def scores_of(q: np.ndarray, x: np.ndarray, compute: str, query_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    got = q.astype(compute) @ x.astype(compute).T
    got = np.array(got.tolist(), np.int64).reshape(len(q), len(x)) if compute == "O" else np.rint(got).astype(np.int64)
    got[query_ids[:, None] == ids[None]] = _NONE
    return got


@contextlib.contextmanager
def _small_batches(spark: SparkSession, rows: int):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for staged ``vec_id, v`` rows; ``queries`` are rows of the same kind."""
    spark = vectors.sparkSession
    lengths = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = lengths["d"]
    vectors, queries = vectors.filter(F.size("v") == dim), queries.filter(F.size("v") == dim)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, largest = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    if largest >= float(1 << 62):
        raise ValueError("components too large for 64-bit scores")
    stored, compute = _kind(largest)
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toPandas()
    sample, sample_ids = np.array(picked.v.tolist(), np.float64).reshape(-1, dim), picked.vec_id.to_numpy()
    by_id = np.argsort(sample_ids, kind="stable")
    sample, sample_ids = sample[by_id], sample_ids[by_id]
    fixed = spark.sparkContext.broadcast((choose_pivots(_augmented(sample, largest), PIVOTS), sample, sample_ids))

    def key(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots = fixed.value[0]
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column(1), dim)
                d = _distances(_augmented(v, largest, query), pivots)
                near = d.argmin(1)
                raw = v.astype(stored)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), batch.column(0), pa.array([r.tobytes() for r in raw], pa.binary())], ["pivot", "dist", "vec_id", "raw"])

        return run

    def sorted_rows(df: DataFrame, query: bool, parts: int) -> DataFrame:
        keyed = df.select("vec_id", "v").mapInArrow(key(query), "pivot int, dist double, vec_id long, raw binary")
        return keyed.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")

    def rows_of(batches, most: int):
        held = []
        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns)))
            while len(held) >= most:
                yield held[:most]
                held = held[most:]
        if held:
            yield held

    cores = spark.sparkContext.defaultParallelism
    part_size = int(np.clip(n // (2 * cores) + 1, ANNULUS, PART))

    def parts_run(batches):
        part = TaskContext.get().partitionId() << 24
        for rows in rows_of(batches, part_size):
            cuts, at = [], 0
            while at < len(rows):
                end = at
                while end < len(rows) and end - at < ANNULUS and rows[end][0] == rows[at][0]:
                    end += 1
                cuts.append((at, end))
                at = end
            order = [i for a, b in cuts for i in sorted(range(a, b), key=lambda i: rows[i][2])]  # by vec_id within an annulus
            cols = [[part], [[rows[a][0] for a, _ in cuts]], [[rows[a][1] for a, _ in cuts]], [[rows[b - 1][1] for _, b in cuts]], [[b for _, b in cuts]],
                    [np.array([rows[i][2] for i in order], "<i8").tobytes()], [b"".join(rows[i][3] for i in order)]]
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["part", "pivots", "lo", "hi", "ends", "ids", "raw"])
            part += 1

    index = stage(
        sorted_rows(vectors, False, max(1, -(-n // (4 * PART)), min(cores, -(-n // part_size))))
        .mapInArrow(parts_run, "part long, pivots array<int>, lo array<double>, hi array<double>, ends array<int>, ids binary, raw binary"),
        "op4-index",
    )

    def blocks_run(batches):
        block = TaskContext.get().partitionId() << 24
        pivots, near_v, near_ids = fixed.value
        for rows in rows_of(batches, QUERY_BLOCK):
            ids = np.array([r[2] for r in rows], np.int64)
            q = np.frombuffer(b"".join(r[3] for r in rows), stored).reshape(len(rows), dim)
            best = Best(np.full(len(ids), _NONE), k)
            best.offer(np.arange(len(ids)), scores_of(q, near_v, compute, ids, near_ids), near_ids)
            floor = best.score[:, -1]
            wide = q.astype(np.float64)
            d = _distances(_augmented(wide, largest, True), pivots)
            cols = [[block], [ids.astype("<i8").tobytes()], [q.tobytes()], [floor.astype("<i8").tobytes()], [d.min(0).tolist()], [d.max(0).tolist()], [float((wide * wide).sum(1).max())], [int(floor.min())]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["block", "q_ids", "q_raw", "floor", "d_min", "d_max", "norm", "least"])
            block += 1

    one_each = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = stage(
        sorted_rows(one_each, True, max(1, min(cores, n // (20 * QUERY_BLOCK))))
        .mapInArrow(blocks_run, "block long, q_ids binary, q_raw binary, floor binary, d_min array<double>, d_max array<double>, norm double, least long"),
        "op4-queries",
    )
    # which parts a block can need, from bounds alone: a row for each block and pivot against the pivot's annuli
    rings = index.select("part", F.explode(F.arrays_zip("pivots", "lo", "hi")).alias("a")).groupBy("part", F.col("a.pivots").alias("pivot")).agg(F.min("a.lo").alias("lo"), F.max("a.hi").alias("hi"))
    spans = blocks.select("block", "norm", "least", F.posexplode(F.arrays_zip("d_min", "d_max")).alias("pivot", "d"))
    gap = F.greatest(F.lit(0.0), F.col("d.d_min") - F.col("hi"), F.col("lo") - F.col("d.d_max"))
    reach = (F.col("norm") + F.lit(largest) - gap * gap) / 2 + F.lit(1e-6 * (1 + largest))
    pairs = spans.join(rings, "pivot").filter(reach >= F.col("least")).select("block", "part").distinct()

    def expand(batches):
        pivots = fixed.value[0]
        for batch in batches:
            for row in batch.to_pylist():
                q_ids = np.frombuffer(row["q_ids"], "<i8")
                q = np.frombuffer(row["q_raw"], stored).reshape(-1, dim)
                ids, x = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["raw"], stored).reshape(-1, dim)
                wide = q.astype(np.float64)
                d = _distances(_augmented(wide, largest, True), pivots[row["pivots"]])
                lo, hi, ends = np.array(row["lo"]), np.array(row["hi"]), np.array(row["ends"])
                gap = np.maximum(0, np.maximum(d - hi, lo - d))
                reach = ((wide * wide).sum(1)[:, None] + largest - gap * gap) / 2 + 1e-6 * (1 + largest)
                best = Best(np.frombuffer(row["floor"], "<i8"), k)
                for a in np.argsort(-reach.max(0), kind="stable").tolist():
                    rows = np.flatnonzero(reach[:, a] >= best.floor)
                    if not len(rows):
                        if (reach.max(0)[a] < best.floor.min()):
                            break  # the annuli that follow reach no further
                        continue
                    own = slice(ends[a - 1] if a else 0, ends[a])
                    best.offer(rows, scores_of(q[rows], x[own], compute, q_ids[rows], ids[own]), ids[own])
                floor = np.frombuffer(row["floor"], "<i8")
                keep = (best.score >= floor[:, None]) & (best.ids != np.iinfo(np.int64).max)
                who, at = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[who]), pa.array(best.ids[who, at]), pa.array(best.score[who, at])], ["query_id", "vec_id", "score"])

    with _small_batches(spark, 8):
        found = stage(
            pairs.join(blocks.select("block", "q_ids", "q_raw", "floor"), "block").join(index, "part")
            .select("q_ids", "q_raw", "floor", "pivots", "lo", "hi", "ends", "ids", "raw")
            .mapInArrow(expand, "query_id long, vec_id long, score long"),
            "op4-found",
        )
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows at most of each part that reaches the query
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(quantised(table(spark, sf_dir, "embeddings")), "op4-rows")
    return top_k(rows, rows.filter("vec_id % 20 = 0"))


QUERIES = {"op4_topk": op4_topk}
SQL = {
    "op4_topk": """
WITH v AS (
  SELECT vec_id, [floor(64.0::DOUBLE * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""",
}
