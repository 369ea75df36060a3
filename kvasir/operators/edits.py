"""Building, changing and looking up graphs whose nodes are points.

``vertices(vid, x, y, z)`` and ``edges(src, dst)``, other columns allowed.  Points are the same if their
coordinates agree when rounded to ``DIGITS`` places: an equal-key join, never a comparison of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kvasir.functions import vectors
from kvasir.operators import iterate
from kvasir.operators.model import undirected

DIGITS = 4
_XYZ = ["x", "y", "z"]


def _key(prefix: str = "", digits: int = DIGITS) -> list[Column]:
    """Rounded coordinates, zero without a sign."""
    return [(F.round(F.col(f"{prefix}{c}"), digits) + F.lit(0.0)).alias(f"k{c}") for c in _XYZ]


def _keyed(df: DataFrame, prefix: str = "") -> DataFrame:
    return df.withColumns({f"k{c}": F.round(F.col(f"{prefix}{c}"), DIGITS) + F.lit(0.0) for c in _XYZ})


_K = ["kx", "ky", "kz"]


def by_vertices_edges(vertices: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of points and of ``segments(eid, ax, ay, az, bx, by, bz)``: ends that no listed vertex has are added, equal points welded to the least id."""
    segments = segments.select("eid", *[f"{e}{c}" for e in "ab" for c in _XYZ])
    listed = _keyed(vertices).groupBy(*_K).agg(F.min("vid").alias("vid"), *[F.min_by(c, "vid").alias(c) for c in _XYZ])
    ends = segments.select(*[F.col(f"a{c}").alias(c) for c in _XYZ]).union(segments.select(*[F.col(f"b{c}").alias(c) for c in _XYZ]))
    more = _keyed(ends).join(listed.select(*_K), _K, "left_anti").groupBy(*_K).agg(*[F.min(c).alias(c) for c in _XYZ])
    # an added vertex is known by a hash of its key, below all listed ids
    more = more.withColumn("vid", -F.abs(F.xxhash64(*_K)) - 1)
    every = listed.unionByName(more)
    one = lambda p, name: every.select("vid", *_K).withColumnRenamed("vid", name)
    out = _keyed(segments, "a").join(one("a", "src"), _K).drop(*_K)
    out = _keyed(out, "b").join(one("b", "dst"), _K).drop(*_K)
    return every.select("vid", *_XYZ), out.select("eid", "src", "dst")


def add_vertices(vertices: DataFrame, points: DataFrame) -> DataFrame:
    """``vertices`` with those of ``points(vid, x, y, z)`` that are at none of its places, one for each place."""
    new = _keyed(points).join(_keyed(vertices).select(*_K), _K, "left_anti").groupBy(*_K).agg(F.min("vid").alias("vid"), *[F.min_by(c, "vid").alias(c) for c in _XYZ])
    return vertices.select("vid", *_XYZ).unionByName(new.select("vid", *_XYZ))


def contains_vertices(vertices: DataFrame, points: DataFrame) -> DataFrame:
    """``pid, vid`` of ``points(pid, x, y, z)``: the least vertex at the place, or null."""
    at = _keyed(vertices).groupBy(*_K).agg(F.min("vid").alias("vid"))
    return _keyed(points).join(at, _K, "left").select("pid", "vid")


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def contains_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """``src, dst, found`` of ``wanted(src, dst)``, either way round."""
    w = wanted.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    return w.join(_ordered(edges).withColumn("hit", F.lit(True)), ["a", "b"], "left").select("src", "dst", F.coalesce("hit", F.lit(False)).alias("found"))


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """``edges(src, dst)`` with those of ``more`` that it lacks in either direction."""
    new = _ordered(more).join(_ordered(edges), ["a", "b"], "left_anti").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return edges.select("src", "dst").unionByName(new)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    g = _ordered(gone)
    return edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(g, ["a", "b"], "left_anti").select("src", "dst")


def remove_isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("vid")).union(edges.select("dst"))
    return vertices.join(ends, "vid", "left_semi")


def connect(a: DataFrame, b: DataFrame) -> DataFrame:
    """``src, dst``: the nodes of ``a(ord, node)`` and of ``b`` that have one place in their lists."""
    return a.select("ord", F.col("node").alias("src")).join(b.select("ord", F.col("node").alias("dst")), "ord").filter("src != dst").select("src", "dst")


def complete(nodes: DataFrame) -> DataFrame:
    """``src, dst``: every pair of nodes, by definition; for small sets of nodes."""
    return nodes.select(F.col("node").alias("src")).join(nodes.select(F.col("node").alias("dst")), F.col("src") < F.col("dst"))


def counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Order, size, and whether the graph is empty."""
    n = vertices.agg(F.count(F.lit(1)).alias("graph_order"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("size"))).withColumn("empty", (F.col("graph_order") == 0) & (F.col("size") == 0))


def neighbours(edges: DataFrame, mode: str = "all") -> DataFrame:
    """``node, neighbour``: of outgoing, incoming or all edges, each once."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"))
    return {"out": out, "in": back, "all": out.unionByName(back)}[mode].filter("node != neighbour").distinct()


def edge_ends(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst`` with the coordinates of both ends, ``ax .. bz``."""
    a = vertices.select(F.col("vid").alias("src"), *[F.col(c).alias(f"a{c}") for c in _XYZ])
    b = vertices.select(F.col("vid").alias("dst"), *[F.col(c).alias(f"b{c}") for c in _XYZ])
    return edges.select("src", "dst").join(a, "src").join(b, "dst")


def neighbours_by_direction(vertices: DataFrame, edges: DataFrame, compass: str) -> DataFrame:
    """``node, neighbour`` whose direction has the compass name."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = edge_ends(vertices, both)
    d = F.array(*[F.col(f"b{c}") - F.col(f"a{c}") for c in _XYZ])
    return e.filter(vectors.compass_direction(d) == compass).select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))


def neighbours_by_vector(vertices: DataFrame, edges: DataFrame, direction: tuple[float, float, float], degrees: float) -> DataFrame:
    """``node, neighbour`` whose direction lies within an angle of a vector."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = edge_ends(vertices, both)
    d = F.array(*[F.col(f"b{c}") - F.col(f"a{c}") for c in _XYZ])
    cosine = vectors.dot(d, F.array(*[F.lit(x) for x in direction])) / vectors.magnitude(d) / F.lit(sum(x * x for x in direction) ** 0.5)
    return e.filter(cosine >= F.cos(F.radians(F.lit(degrees)))).select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))


def adjacency_map(edges: DataFrame) -> DataFrame:
    """``node, neighbours``: a map from neighbour to weight of each node's outgoing ``edges(src, dst, weight)``; a node's degree bounds its row."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dst", "weight")))).alias("neighbours"))


def adjacency_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, row``: weights to all nodes in order of id, 0 where there is none; by definition as wide as the graph."""
    order = nodes.agg(F.array_sort(F.collect_list("node")).alias("ids"))
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    own = both.groupBy(F.col("src").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("m"))
    return nodes.join(own, "node", "left").crossJoin(order).select("node", F.transform("ids", lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("row"))


def by_adjacency_matrix(rows: DataFrame) -> DataFrame:
    """``src, dst, weight``, places from 0, of ``node, row``: what stands above the diagonal and is not 0."""
    at = W.orderBy("node")
    place = rows.withColumn("src", F.row_number().over(at) - 1)  # as many rows as a row is wide
    return place.select("src", F.posexplode("row").alias("dst", "weight")).filter("weight != 0 AND src < dst")


def indices(vertices: DataFrame) -> DataFrame:
    """``vid, place``: each vertex's place, from 0, in order of id, by a count for each task and one offset."""
    parts = vertices.select("vid").repartitionByRange("vid").sortWithinPartitions("vid").withColumn("part", F.spark_partition_id())
    parts = iterate.keep(parts)
    own = F.row_number().over(W.partitionBy("part").orderBy("vid"))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each task
    return parts.withColumn("own", own).join(before, "part").select("vid", (F.col("before") + F.col("own") - 1).alias("place"))


def mesh_data(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, by definition the whole graph: ``vertices``, arrays of coordinates in order of id, and ``edges``, pairs of places."""
    v = vertices.agg(F.array_sort(F.collect_list(F.struct("vid", *_XYZ))).alias("v"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))
    ids = F.transform("v", lambda r: r["vid"])
    return v.crossJoin(e).select(
        F.transform("v", lambda r: F.array(r["x"], r["y"], r["z"])).alias("vertices"),
        F.transform("e", lambda r: F.array((F.array_position(ids, r["src"]) - 1).cast("int"), (F.array_position(ids, r["dst"]) - 1).cast("int"))).alias("edges"))


def by_mesh_data(mesh: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = mesh.select(F.posexplode("vertices").alias("vid", "p")).select(F.col("vid").cast("long"), *[F.element_at("p", k + 1).alias(c) for k, c in enumerate(_XYZ)])
    return v, mesh.select(F.explode("edges").alias("e")).select(F.element_at("e", 1).cast("long").alias("src"), F.element_at("e", 2).cast("long").alias("dst"))


def json_rows(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, json``: a JSON text for each vertex and edge, what a line of an export holds."""
    v = vertices.select(F.lit("vertex").alias("kind"), F.to_json(F.struct(*vertices.columns)).alias("json"))
    return v.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))


def by_json_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = rows.filter("kind = 'vertex'").select(F.from_json("json", "vid long, x double, y double, z double").alias("r")).select("r.*")
    return v, rows.filter("kind = 'edge'").select(F.from_json("json", "src long, dst long").alias("r")).select("r.*")


def compare(nodes_a: DataFrame, a: DataFrame, nodes_b: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard similarity of the node sets and of the edge sets, and their mean."""
    def jaccard(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        cols = x.columns
        both = x.distinct().withColumn("l", F.lit(1)).join(y.distinct().withColumn("r", F.lit(1)), cols, "full")
        return both.agg((F.count(F.col("l") + F.col("r")) / F.count(F.lit(1))).alias(name))

    out = jaccard(nodes_a.select("node"), nodes_b.select("node"), "nodes").crossJoin(jaccard(_ordered(a), _ordered(b), "edges"))
    return out.withColumn("similarity", (F.col("nodes") + F.col("edges")) / 2)


def depth_map(edges: DataFrame, root: int) -> DataFrame:
    """``depth, nodes``: how many nodes lie how many edges from the root."""
    arcs = undirected(edges)
    far = iterate.bfs(arcs, arcs.sparkSession.range(1).select(F.lit(root).cast("long").alias("node")))
    return far.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


def shortest_tree(edges: DataFrame, root: int) -> DataFrame:
    """``node, parent, depth`` along shortest paths from the root, the least parent on ties: the path to any node is its parents'."""
    arcs = undirected(edges)
    far = iterate.bfs(arcs, arcs.sparkSession.range(1).select(F.lit(root).cast("long").alias("node"))).select("node", "depth")
    up = far.select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    parents = far.join(arcs.select("src", F.col("dst").alias("node")), "node").join(up, ["src", "depth"]).groupBy("node").agg(F.min("src").alias("parent"))
    return far.join(parents, "node", "left").select("node", "parent", "depth")
