"""Measures and set operations of graphs given as ``pairs(src, dst[, weight])``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kvasir.operators import iterate
from kvasir.operators.model import undirected


def degrees(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, degree``: distinct neighbours, 0 for isolated nodes."""
    n = undirected(pairs).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(n.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_sequence(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``degree, nodes``."""
    return degrees(nodes, pairs).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def density(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges over possible edges of a simple undirected graph."""
    e = pairs.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    n = nodes.agg(F.count_distinct("node").alias("n"))
    return n.crossJoin(e.agg(F.count(F.lit(1)).alias("m"))).select("n", "m", F.when(F.col("n") > 1, F.round(2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1)), 9)).otherwise(0.0).alias("density"))


def isolated(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("src").alias("node")).union(pairs.select("dst"))
    return nodes.join(ends, "node", "left_anti")


def erdos_gallai(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether the degree sequence is graphical, from the counts by degree: a row for each distinct degree, not for each node."""
    c = degree_sequence(nodes, pairs)
    # the k-th inequalities need only be checked at the last node of each degree
    upto = c.select(F.col("degree").alias("d"), F.col("nodes").alias("own"))
    w = W.orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, 0)
    at = upto.select("d", F.sum("own").over(w).alias("k"), F.sum(F.col("own") * F.col("d")).over(w).alias("head"))
    other = c.select(F.col("degree").alias("e"), F.col("nodes").alias("many"))
    tail = at.join(other, F.col("e") < F.col("d"), "left").groupBy("d", "k", "head").agg(F.coalesce(F.sum(F.least("e", "k") * F.col("many")), F.lit(0)).alias("tail"))
    ok = F.coalesce(F.bool_and(F.col("head") <= F.col("k") * (F.col("k") - 1) + F.col("tail")), F.lit(True))
    even = c.agg((F.coalesce(F.sum(F.col("degree") * F.col("nodes")), F.lit(0)) % 2 == 0).alias("even"))
    return tail.agg(ok.alias("ok")).crossJoin(even).select((F.col("ok") & F.col("even")).alias("graphical"))


def set_operation(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """``src, dst, weight`` of two graphs' edges: union, intersect, difference, symdiff, impose (b's weights win), imprint (a's edges, b's weights)."""
    x = a.select("src", "dst", F.col("weight").alias("wa"))
    y = b.select("src", "dst", F.col("weight").alias("wb"))
    if kind == "difference":
        return a.join(b, ["src", "dst"], "left_anti").select("src", "dst", "weight")
    how, weight, where = {
        "union": ("full", F.coalesce("wa", "wb"), None),
        "intersect": ("inner", F.col("wa"), None),
        "symdiff": ("full", F.coalesce("wa", "wb"), "wa IS NULL OR wb IS NULL"),
        "impose": ("full", F.coalesce("wb", "wa"), None),
        "imprint": ("left", F.coalesce("wb", "wa"), None),
    }[kind]
    out = x.join(y, ["src", "dst"], how)
    return (out.filter(where) if where else out).select("src", "dst", weight.alias("weight"))


def quotient(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``a, b, edges`` of the graph of ``groups(node, grp)``: edges between unlike groups, merged."""
    e = pairs.join(groups.select(F.col("node").alias("src"), F.col("grp").alias("g")), "src").join(groups.select(F.col("node").alias("dst"), F.col("grp").alias("h")), "dst")
    return e.filter("g != h").groupBy(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b")).agg(F.count(F.lit(1)).alias("edges"))


def is_bipartite(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """No odd cycle: a node's two sides never meet in one component of the doubled graph."""
    e = undirected(pairs)
    both = nodes.select((F.col("node") * 2).alias("node")).union(nodes.select(F.col("node") * 2 + 1))
    cross = e.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"))
    c = iterate.components(both, cross)
    side = c.groupBy(F.floor(F.col("node") / 2).alias("n")).agg((F.min("component") == F.max("component")).alias("odd"))
    return side.agg((~F.coalesce(F.bool_or("odd"), F.lit(False))).alias("bipartite"))


def all_paths(arcs: DataFrame, source: int, target: int, max_length: int) -> DataFrame:
    """``path, length``: simple paths up to a length, as arrays of nodes."""
    cur = iterate.keep(arcs.sparkSession.range(1).select(F.array(F.lit(source).cast("long")).alias("path")))
    found = None
    for _ in range(max_length):
        step = cur.withColumn("src", F.element_at("path", -1)).filter(F.col("src") != target).join(arcs, "src").filter(~F.array_contains("path", F.col("dst")))
        cur = iterate.keep(step.select(F.array_append("path", F.col("dst")).alias("path")))
        hit = cur.filter(F.element_at("path", -1) == target)
        found = hit if found is None else found.unionByName(hit)
    return found.select("path", (F.size("path") - 1).alias("length"))


def closeness(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, closeness``: (reached - 1) / sum of distances, scaled by (reached - 1) / (n - 1)."""
    n = nodes.count()
    d = iterate.bfs(undirected(pairs), nodes)
    s = d.groupBy("source").agg(F.sum("depth").alias("far"), (F.count(F.lit(1)) - 1).alias("reached"))
    value = F.when(F.col("far") > 0, F.col("reached") / F.col("far") * F.col("reached") / F.lit(max(1, n - 1))).otherwise(0.0)
    return s.select(F.col("source").alias("node"), F.round(value, 9).alias("closeness"))


def diameter(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The greatest finite distance."""
    return iterate.bfs(undirected(pairs), nodes).agg(F.max("depth").cast("int").alias("diameter"))


def betweenness(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, betweenness`` (unordered pairs, not normalised): shortest-path counts forward by level, dependencies backward, of all sources together."""
    arcs = undirected(pairs)
    level = iterate.keep(nodes.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("source", "node")
    while True:
        step = level.select("source", F.col("node").alias("src"), "paths").join(arcs, "src").groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = iterate.keep(step.join(seen, ["source", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = iterate.keep(seen.unionByName(level.select("source", "node")))
    below = levels[-1].withColumn("delta", F.lit(0.0))
    total = below.filter("node != source").select("node", "delta")
    for up in reversed(levels[:-1]):
        flow = below.select("source", F.col("node").alias("src"), ((1 + F.col("delta")) / F.col("paths")).alias("share")).join(arcs, "src").groupBy("source", F.col("dst").alias("node")).agg(F.sum("share").alias("share"))
        below = iterate.keep(up.join(flow, ["source", "node"], "left").select("source", "node", "paths", F.coalesce(F.col("share") * F.col("paths"), F.lit(0.0)).alias("delta")))
        total = total.unionByName(below.filter("node != source").select("node", "delta"))
    sums = total.groupBy("node").agg((F.sum("delta") / 2).alias("b"))
    return nodes.join(sums, "node", "left").select("node", F.round(F.coalesce("b", F.lit(0.0)), 6).alias("betweenness"))


def degree_centrality(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, centrality``: degree / (n - 1)."""
    n = max(1, nodes.count() - 1)
    return degrees(nodes, pairs).select("node", F.round(F.col("degree") / F.lit(n), 9).alias("centrality"))


def delta(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The least and the greatest degree."""
    return degrees(nodes, pairs).agg(F.min("degree").alias("minimum"), F.max("degree").alias("maximum"))


def is_complete(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    return density(nodes, pairs).select((F.col("m") * 2 == F.col("n") * (F.col("n") - 1)).alias("complete"))


def adjacency_list(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, neighbours`` (sorted, empty for isolated nodes)."""
    near = undirected(pairs).groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))
    return nodes.join(near, "node", "left").select("node", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def incident_edges(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges at any of ``vertices(node)``."""
    return pairs.join(vertices.select(F.col("node").alias("src")), "src", "left_semi").unionByName(pairs.join(vertices.select(F.col("node").alias("dst")), "dst", "left_semi").select(*pairs.columns)).distinct()


def remove_vertices(nodes: DataFrame, pairs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without some vertices and their edges."""
    out = pairs
    for end in ("src", "dst"):
        out = out.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return nodes.join(gone, "node", "left_anti"), out.select(*pairs.columns)


def spanning_tree(pairs: DataFrame, root: int) -> DataFrame:
    """``node, parent, depth`` of a breadth-first tree; the parent is the smallest neighbour one level up."""
    arcs = undirected(pairs)
    level = iterate.bfs(arcs, pairs.sparkSession.range(1).select(F.lit(root).cast("long").alias("node"))).select("node", "depth")
    up = level.select(F.col("node").alias("dst"), (F.col("depth") + 1).alias("depth"))
    parents = level.join(arcs, level.node == arcs.src).join(up, ["dst", "depth"]).groupBy("node").agg(F.min("dst").alias("parent"))
    return level.join(parents, "node", "left").select("node", "parent", F.col("depth").cast("int").alias("depth"))


def bridges(pairs: DataFrame) -> DataFrame:
    """``src, dst`` of edges on no cycle: tree edges that no other edge's tree paths cross.

    Each non-tree edge walks its two ends up to their meeting, a level a round, and covers what it
    passes; walkers at one place with one goal level merge, since only what is covered matters.
    """
    e = iterate.keep(pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a != b").distinct())
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    roots = iterate.components(nodes, e.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("component").alias("node")).distinct()
    arcs = undirected(e.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    level = iterate.bfs(arcs, roots).select("node", "depth")
    up = level.select(F.col("node").alias("dst"), (F.col("depth") + 1).alias("depth"))
    tree = iterate.keep(level.join(arcs, level.node == arcs.src).join(up, ["dst", "depth"]).groupBy("node", "depth").agg(F.min("dst").alias("parent")))
    on_tree = tree.select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"), F.col("node").alias("child"))
    depth = iterate.keep(level)
    walk = e.join(on_tree, ["a", "b"], "left_anti").select("a", "b")
    covered = None
    while True:
        da, db = depth.select(F.col("node").alias("a"), F.col("depth").alias("da")), depth.select(F.col("node").alias("b"), F.col("depth").alias("db"))
        walk = iterate.keep(walk.join(da, "a").join(db, "b").filter("a != b"))
        if walk.isEmpty():
            break
        moved = walk.join(tree.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a", "left").join(tree.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b", "left")
        passed = moved.filter("da >= db").select(F.col("a").alias("child")).union(moved.filter("db >= da").select("b"))
        covered = iterate.keep((passed if covered is None else covered.union(passed)).distinct())
        walk = moved.select(F.when(F.col("da") >= F.col("db"), F.col("pa")).otherwise(F.col("a")).alias("a"), F.when(F.col("db") >= F.col("da"), F.col("pb")).otherwise(F.col("b")).alias("b")).distinct()
    out = on_tree if covered is None else on_tree.join(covered, "child", "left_anti")
    return out.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def communities(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, community`` by label propagation: each round the commonest label around and at a node, the smallest on ties.

    Rounds go on until labels stay, or come back after two rounds, as symmetric votes can; then the lesser of both counts.
    """
    arcs = undirected(pairs)
    before, label = None, iterate.keep(nodes.select("node", F.col("node").alias("community")))

    def equal(a: DataFrame, b: DataFrame | None) -> bool:
        return b is not None and a.join(b, ["node", "community"], "left_anti").isEmpty()

    while True:
        votes = arcs.join(label, arcs.dst == label.node).select(F.col("src").alias("node"), "community").unionByName(label)
        n = votes.groupBy("node", "community").agg(F.count(F.lit(1)).alias("n"))
        new = iterate.keep(n.groupBy("node").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community")))
        if equal(new, label):
            return new
        if equal(new, before):
            return new.unionByName(label).groupBy("node").agg(F.min("community").alias("community"))
        before, label = label, new
