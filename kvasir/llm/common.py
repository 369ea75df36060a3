"""Shared pieces of the training-data operators: scratch tables, readers, clustering of links."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.functions.shipping import ship

_ROOTS: dict[str, tuple] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kvasir-")
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; everything of this process goes when it ends."""
    root = shared_root(spark)
    if root not in _ROOTS:
        own = f"{root}/kvasir-{uuid.uuid4().hex}"
        _ROOTS[root] = own
        atexit.register(_forget, spark, own)
    return f"{_ROOTS[root]}/{name}-{uuid.uuid4().hex[:12]}"


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no returned plan reads any more."""
    for path in paths:
        _forget(spark, path)


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession):
    """What the statement shuffles goes when it ends, as no later one reads it, and not when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends in files that survive lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    with _shuffles_end(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What this worker holds unused goes back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim:
        trim(0)


def sliced(batches: Iterable[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of the text or binary ``column``; a row is never cut.

    At the end what the worker holds unused goes back to the system.
    """
    try:
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + 64, dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
                yield batch.slice(at, end - at)
                at = end
    finally:
        give_back()


#: Bytes of an Arrow batch that goes to a Python worker: rows of whole texts can be long.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> None:
    """Executors get the package's sources, and batches to Python workers a bound in bytes, unless the session's own is lower."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"\d+", spark.conf.get(name))
    if not now or int(now[0]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for ``rows``: as many as ``per_task`` asks, at least two rounds of the cluster's cores."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // per_task), 1)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root the smallest node.

    Alternates large-star and small-star steps until neither changes the edge set.  Each step is one
    group minimum and one join; a hub only ever sends its group's minimum, so no task gathers a group.
    Nodes without an edge do not appear.  Rounds are checkpointed.
    """
    spark = edges.sparkSession
    shared_root(spark)
    cur = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u != v").distinct().checkpoint()
    )

    def fingerprint(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    seen = fingerprint(cur)
    if not seen[0]:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        # large star: every larger neighbour of x links to the smallest of x and its neighbours
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # small star: x and its smaller neighbours link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = fingerprint(small)
        cur = small
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
