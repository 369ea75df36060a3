"""Attributed graphs as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns beside the attribute map that queries address by name.
FIELDS = ("label", "category", "ontology_class", "type")


@dataclass(frozen=True)
class Graph:
    """``vertices(vid, label, category, ontology_class, type, props)`` and ``edges(eid, src, dst, ..., props)``.

    ``props`` is MAP<STRING,STRING>; immutable, so every change is a new graph.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)


def text_map(**columns: Column) -> Column:
    """A map of strings, without null values."""
    parts = [x for name, c in columns.items() for x in (F.lit(name), c.cast("string"))]
    return F.map_filter(F.create_map(*parts), lambda k, v: v.isNotNull())


def entity(df: DataFrame, keys: dict[str, Column], props: Column, **fields: Column) -> DataFrame:
    """Rows with ids, the four fields (null if not given) and an attribute map."""
    cols = [c.cast("long").alias(k) for k, c in keys.items()]
    cols += [fields.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS]
    return df.select(*cols, props.alias("props"))


def empty_props() -> Column:
    return F.create_map().cast("map<string,string>")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct neighbour pairs in both directions, without loops."""
    e = edges.select("src", "dst").filter("src != dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
