"""Loops over graphs: frontier expansion, components, trees.  Each round's state is checkpointed."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checkpoints(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="kvasir-"))


def keep(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def bfs(arcs: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``source, node, depth``: least number of ``arcs(src, dst)`` from each of ``sources(node)``."""
    seen = front = keep(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("depth")).distinct())
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.select("source", F.col("node").alias("src")).join(arcs, "src").select("source", F.col("dst").alias("node")).distinct()
        front = keep(step.join(seen, ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = keep(seen.unionByName(front))
    return seen


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that ``pairs(src, dst)`` connect to, with every one of ``nodes(node)``.

    Large-star and small-star rounds: each links nodes to the least neighbour, so the number of rounds
    grows with the logarithm of a component's length.
    """
    cur = keep(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        now = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        cur = keep(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """Minimum spanning forest of ``pairs(src, dst, weight)`` by Boruvka rounds; ties by (weight, src, dst)."""
    edges = keep(pairs.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")))
    chosen = None
    while not edges.isEmpty():
        rank = F.struct("weight", "src", "dst")
        ends = edges.select(F.col("a").alias("c"), rank.alias("r")).unionByName(edges.select(F.col("b").alias("c"), rank.alias("r")))
        best = keep(ends.groupBy("c").agg(F.min("r").alias("r")).select("r.weight", "r.src", "r.dst").distinct())
        chosen = best if chosen is None else keep(chosen.unionByName(best))
        picked = edges.join(best.select("src", "dst"), ["src", "dst"]).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        root = components(nodes, picked)
        edges = edges.join(root.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(root.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        edges = keep(edges.filter("x != y").select("src", "dst", "weight", F.col("x").alias("a"), F.col("y").alias("b")))
    return chosen if chosen is not None else pairs.select("weight", "src", "dst").limit(0)


def closure(step, facts: DataFrame) -> DataFrame:
    """Adds ``step(all, new)`` to ``facts`` until nothing is new (semi-naive), however many rounds that takes."""
    every = new = keep(facts.distinct())
    while True:
        new = keep(step(every, new).distinct().join(every, facts.columns, "left_anti"))
        if new.isEmpty():
            break
        every = keep(every.unionByName(new))
    return every
