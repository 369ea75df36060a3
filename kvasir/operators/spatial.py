"""Range joins, nearest neighbours, ray casts and clustering of points and boxes in space.

Joins meet in grid cells: a box is dealt to the cells that it covers, and a pair is kept only in the cell
of the lesser corner of the boxes' overlap, so it comes out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kvasir.operators import iterate

AXES = ("x", "y", "z")


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def box_pairs(boxes: DataFrame, cell: float, tolerance: float = 0.0) -> DataFrame:
    """``a, b`` (a < b) of ``boxes(bid, x0, y0, z0, x1, y1, z1)`` that overlap or touch within the tolerance."""
    dealt = boxes
    for a in AXES:
        dealt = dealt.withColumn(f"c{a}", F.explode(_cells(F.col(f"{a}0") - tolerance, F.col(f"{a}1") + tolerance, cell)))
    keys = [f"c{a}" for a in AXES]
    l = dealt.select(*keys, F.col("bid").alias("a"), *[F.col(f"{a}{k}").alias(f"l{a}{k}") for a in AXES for k in (0, 1)])
    r = dealt.select(*keys, F.col("bid").alias("b"), *[F.col(f"{a}{k}").alias(f"r{a}{k}") for a in AXES for k in (0, 1)])
    keep = F.col("a") < F.col("b")
    for a in AXES:
        keep &= (F.col(f"l{a}0") - tolerance <= F.col(f"r{a}1")) & (F.col(f"r{a}0") - tolerance <= F.col(f"l{a}1"))
        keep &= F.col(f"c{a}") == F.floor((F.greatest(f"l{a}0", f"r{a}0") - tolerance) / cell)
    return l.join(r, keys).filter(keep).select("a", "b")


def squared(p: str, q: str) -> Column:
    out = F.lit(0.0)
    for a in AXES:
        d = F.col(f"{p}{a}") - F.col(f"{q}{a}")
        out = out + d * d
    return out


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """``a, b, d2`` of ordered pairs (a != b) of ``points(pid, x, y, z)`` at a distance below the radius."""
    own = points.select(F.col("pid").alias("a"), *[F.col(a).alias(f"p{a}") for a in AXES], *[F.floor(F.col(a) / radius).alias(f"c{a}") for a in AXES])
    other = points.select(F.col("pid").alias("b"), *[F.col(a).alias(f"q{a}") for a in AXES], *[F.floor(F.col(a) / radius).alias(f"g{a}") for a in AXES])
    for a in AXES:
        other = other.withColumn(f"c{a}", F.explode(F.sequence(F.col(f"g{a}") - 1, F.col(f"g{a}") + 1)))
    d2 = squared("p", "q")
    return own.join(other, [f"c{a}" for a in AXES]).filter((F.col("a") != F.col("b")) & (d2 < radius * radius)).select("a", "b", d2.alias("d2"))


def nearest(points: DataFrame, queries: DataFrame, k: int, cell: float) -> DataFrame:
    """``qid, pid, d2, rank``: the k nearest ``points`` of each of ``queries(qid, x, y, z)``, ties to the smaller pid.

    Rings of cells around the query widen (radius 1, 2, 4 ... cells) until k points lie within the ring's
    sure distance; a query that is settled leaves the loop.
    """
    spread = points.agg(*[F.min(a).alias(f"l{a}") for a in AXES], *[F.max(a).alias(f"h{a}") for a in AXES]).first()
    far = queries.agg(*[F.min(a).alias(f"l{a}") for a in AXES], *[F.max(a).alias(f"h{a}") for a in AXES]).first()
    if spread["lx"] is None or far["lx"] is None:
        return queries.select("qid", F.lit(None).cast("long").alias("pid"), F.lit(0.0).alias("d2"), F.lit(1).alias("rank")).limit(0)
    widest = max(max(spread[f"h{a}"], far[f"h{a}"]) - min(spread[f"l{a}"], far[f"l{a}"]) for a in AXES)
    todo = iterate.keep(queries.select("qid", *[F.col(a).alias(f"p{a}") for a in AXES]))
    size, done = cell, None
    while True:
        last = size > widest
        data = points.select("pid", *[F.col(a).alias(f"q{a}") for a in AXES], *[F.floor(F.col(a) / size).alias(f"c{a}") for a in AXES])
        ask = todo
        for a in AXES:
            ask = ask.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"p{a}") / size) - 1, F.floor(F.col(f"p{a}") / size) + 1)))
        d2 = squared("p", "q")
        w = W.partitionBy("qid").orderBy("d2", "pid")
        found = ask.join(data, [f"c{a}" for a in AXES]).select("qid", *[f"p{a}" for a in AXES], "pid", d2.alias("d2"))
        ranked = iterate.keep(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
        sure = ranked.filter((F.col("rank") == k) & (F.col("d2") < size * size)).select("qid") if not last else todo.select("qid")
        part = ranked.join(sure, "qid", "left_semi").select("qid", "pid", "d2", "rank")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        todo = iterate.keep(todo.join(sure, "qid", "left_anti"))
        if todo.isEmpty():
            return done
        size *= 2


def interpolate(values: DataFrame, queries: DataFrame, k: int, cell: float, tolerance: float = 1e-4) -> DataFrame:
    """``qid, value``: inverse-distance mean of the k nearest of ``values(pid, x, y, z, value)``; a point within the tolerance gives its own."""
    n = nearest(values, queries, k, cell).join(values.select("pid", "value"), "pid").withColumn("d", F.sqrt("d2"))
    hit = F.min_by("value", F.struct("d", "pid"))
    mean = F.sum(F.col("value") / F.col("d")) / F.sum(1 / F.col("d"))
    return n.groupBy("qid").agg(F.min("d").alias("least"), hit.alias("own"), mean.alias("mean")).select("qid", F.round(F.when(F.col("least") <= tolerance, F.col("own")).otherwise(F.col("mean")), 6).alias("value"))


def ray_hits(boxes: DataFrame, origin: tuple, direction: tuple) -> DataFrame:
    """``bid, t``: boxes that a ray enters, with the parameter of entry (slab test)."""
    near, far, ok = F.lit(0.0), F.lit(float("inf")), F.lit(True)
    for a, o, d in zip(AXES, origin, direction):
        lo, hi = F.col(f"{a}0"), F.col(f"{a}1")
        if d == 0:
            ok &= (lo <= o) & (hi >= o)
            continue
        t0, t1 = (lo - o) / d, (hi - o) / d
        near, far = F.greatest(near, F.least(t0, t1)), F.least(far, F.greatest(t0, t1))
    return boxes.filter(ok & (near <= far)).select("bid", F.round(near, 6).alias("t"))


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``pid, cluster``: distances strictly below eps, a point counts itself; clusters from 1 by their least core point, 0 noise, a border point to the first cluster that reaches it."""
    near = iterate.keep(near_pairs(points, eps).select("a", "b"))
    core = iterate.keep(points.select("pid").join(near.groupBy(F.col("a").alias("pid")).agg(F.count(F.lit(1)).alias("n")), "pid", "left").filter(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("pid"))
    cores = near.join(core.withColumnRenamed("pid", "a"), "a").join(core.withColumnRenamed("pid", "b"), "b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    root = iterate.keep(iterate.components(core.withColumnRenamed("pid", "node"), cores))
    order = root.select("component").distinct().withColumn("cluster", F.row_number().over(W.orderBy("component")))
    named = root.join(order, "component").select(F.col("node").alias("pid"), "cluster")
    border = near.join(named.withColumnRenamed("pid", "b"), "b").groupBy(F.col("a").alias("pid")).agg(F.min("cluster").alias("reached"))
    return points.select("pid").join(named, "pid", "left").join(border, "pid", "left").select("pid", F.coalesce("cluster", "reached", F.lit(0)).cast("long").alias("cluster"))


def kmeans(points: DataFrame, k: int, rounds: int = 20, seed: int = 1) -> tuple[DataFrame, float]:
    """``pid, cluster`` and the sum of squared distances, by the library's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(AXES), outputCol="features").transform(points)
    model = KMeans(k=k, maxIter=rounds, seed=seed).fit(rows)
    return model.transform(rows).select("pid", F.col("prediction").alias("cluster")), model.summary.trainingCost


def fuse(points: DataFrame, tolerance: float) -> DataFrame:
    """``pid, seed``: in order of pid, a point joins the first earlier seed within the tolerance, else it is a seed.

    Cells are so small that all points in one are within the tolerance: a cell has one seed at most, and the
    first of its points that no seed takes is it.  A round makes seeds of those that no cell with an earlier
    open point can reach, and takes out what lies within the tolerance of them; pairs of points are never
    listed.  Points without three finite coordinates or a pid are their own seeds.
    """
    reach, side = tolerance * (1 + 1e-12), tolerance / 1.75  # a cell's diagonal is 0.99 of the tolerance
    keys = [f"c{a}" for a in AXES]
    finite = F.col("pid").isNotNull()
    for a in AXES:
        finite &= F.abs(a) < float("inf")  # neither null nor NaN, which is greater
    own = iterate.keep(points.select("pid", *AXES, *[F.when(finite, F.floor(F.col(a) / side)).alias(f"c{a}") for a in AXES]))

    def around(df: DataFrame) -> DataFrame:
        """Points as ``b, q*`` of cell ``h*``, dealt to the cells ``g*`` that may hold points within reach."""
        out = df.select(F.col("pid").alias("b"), *[F.col(a).alias(f"q{a}") for a in AXES], *[F.col(k).alias(f"h{k[1]}") for k in keys])
        for a in AXES:
            out = out.withColumn(f"g{a}", F.explode(F.sequence(F.col(f"h{a}") - 2, F.col(f"h{a}") + 2)))
        return out

    same, d2, gap = F.lit(True), F.lit(0.0), F.lit(0.0)
    for a in AXES:
        same &= F.col(f"c{a}") == F.col(f"g{a}")
        d = F.col(a) - F.col(f"q{a}")
        d2 = d2 + d * d
        off = F.greatest(F.col(f"h{a}") * side - F.col(a), F.col(a) - (F.col(f"h{a}") + 1) * side, F.lit(0.0))
        gap = gap + off * off
    near = d2 < reach * reach
    todo, seeds = own.filter("cx IS NOT NULL"), None
    while not todo.isEmpty():
        first = todo.groupBy(*keys).agg(F.min(F.struct("pid", *AXES)).alias("p")).select("p.*", *keys)
        ready = iterate.keep(first.join(around(first), same & (F.col("b") < F.col("pid")) & (gap < reach * reach * (1 + 1e-6)), "left_anti"))
        seeds = ready if seeds is None else iterate.keep(seeds.unionByName(ready))
        todo = iterate.keep(todo.join(around(ready), same & near, "left_anti"))
    if seeds is None:
        return points.select("pid", F.col("pid").alias("seed"))
    held = around(seeds).groupBy("gx", "gy", "gz").agg(F.collect_list(F.struct("b", "qx", "qy", "qz")).alias("held"))  # 125 at most
    d2 = lambda s: sum(((F.col(a) - s[f"q{a}"]) * (F.col(a) - s[f"q{a}"]) for a in AXES), F.lit(0.0))
    taken = F.filter("held", lambda s: (s["b"] <= F.col("pid")) & (d2(s) < reach * reach))
    return own.join(held, same, "left").select("pid", F.coalesce(F.array_min(F.transform(taken, lambda s: s["b"])), "pid").alias("seed"))
