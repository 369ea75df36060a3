"""Queries over stored graphs: ``graphs``, ``vertices(vid, label, ...)`` and ``edges(src, dst, ...)`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOTH = ["src", "dst"]


def _labelled(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with their ends' labels; edges of unknown or blank labels go."""
    v = vertices.select("vid", "label").filter("label IS NOT NULL AND label != ''")
    out = edges.select(*_BOTH)
    for end, name in (("src", "a"), ("dst", "b")):
        out = out.join(v.select(F.col("vid").alias(end), F.col("label").alias(name)), end)
    return out


def label_pairs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``a_label, b_label, pair, count`` of unordered label pairs."""
    e = _labelled(vertices, edges)
    out = e.groupBy(F.least("a", "b").alias("a_label"), F.greatest("a", "b").alias("b_label")).agg(F.count(F.lit(1)).alias("count"))
    return out.select("a_label", "b_label", F.concat_ws("-", "a_label", "b_label").alias("pair"), "count")


def _directions(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    e = _labelled(vertices, edges)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("b").alias("a"), F.col("a").alias("b")))


def candidate_counts(vertices: DataFrame, edges: DataFrame, labels: list[str], exclude: list[str] = (), limit: int | None = None) -> DataFrame:
    """``label, count`` of the labels next to any of ``labels``, in both directions, without case; by count, then label."""
    wanted, out = [x.lower() for x in labels], [x.lower() for x in exclude]
    e = _directions(vertices, edges).filter(F.lower("a").isin(wanted) & ~F.lower("b").isin(out or [""]))
    rows = e.groupBy(F.col("b").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return rows.orderBy(F.desc("count"), "label").limit(limit) if limit else rows


def _neighbours(vertices: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """``vid, degree`` of a label's vertices: distinct neighbours."""
    own = vertices.filter(F.lower("label") == label.lower()).select("vid")
    both = edges.select(*_BOTH).union(edges.select("dst", "src")).distinct().groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return own.join(both.withColumnRenamed("src", "vid"), "vid", "left").select("vid", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def max_neighbors(vertices: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """The most distinct neighbours of a vertex of the label, 0 if there is none."""
    return _neighbours(vertices, edges, label).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_neighbors"))


def best_example(vertices: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """The vertex of the label with the highest degree, the smallest id on ties."""
    return _neighbours(vertices, edges, label).orderBy(F.desc("degree"), "vid").limit(1)


def class_summary(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy(F.coalesce("ontology_class", F.lit("")).alias("ontology_class")).agg(F.count(F.lit(1)).alias("count"))


def list_graphs(graphs: DataFrame, where: dict[str, object], skip: int = 0, limit: int = 100) -> DataFrame:
    """Graphs that meet all given predicates, ordered by id; ``min_x`` and ``max_x`` bound a column."""
    out = graphs
    for k, v in where.items():
        if v is None:
            continue
        c: Column = F.col(k[4:]) >= v if k.startswith("min_") else F.col(k[4:]) <= v if k.startswith("max_") else F.col(k) == v
        out = out.filter(c)
    return out.orderBy("graph_id").offset(skip).limit(limit)


def upsert(stored: DataFrame, new: DataFrame, key: str = "graph_id") -> DataFrame:
    """Rows of ``new``'s keys replace the stored ones."""
    return stored.join(new.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def delete(stored: DataFrame, keys: DataFrame, key: str = "graph_id") -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti").select(*stored.columns)


def mirrored(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, loops once."""
    back = edges.filter("src != dst").withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(back)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """``key, n`` of ids that are null or occur twice or more."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR key IS NULL")
