"""Triples from and to text, and graph datasets from CSV folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z-]+)?)\s*\.\s*$'


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """``s, p, o`` of ``lines(value)``; comments and bad lines go."""
    part = lambda k: F.regexp_extract("value", _LINE, k)
    return lines.filter(F.col("value").rlike(_LINE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o")).distinct()


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def as_ntriples(t: DataFrame) -> DataFrame:
    """``value``: a line for each triple, for ``write.text``."""
    return t.distinct().select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def qname(uri: Column, prefixes: dict[str, str]) -> Column:
    """A URI column with its namespace replaced by a prefix."""
    out = uri
    for prefix, space in prefixes.items():
        out = F.when(uri.startswith(space), F.concat(F.lit(prefix + ":"), F.substring(uri, len(space) + 1, 1 << 20))).otherwise(out)
    return out


def read_graph_csv(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``graphs, nodes, edges`` of a dataset folder, all columns as text; blank masks stay null."""
    read = lambda n: spark.read.option("header", True).csv(f"{folder}/{n}.csv")
    return read("graphs"), read("nodes"), read("edges")
