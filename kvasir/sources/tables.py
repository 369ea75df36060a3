"""Graph views of relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.operators.model import Graph, empty_props, entity, text_map


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Offsets that keep the ids of different tables apart.
NATION, SUPPLIER, CUSTOMER, PART, ORDER = 1_000, 1 << 33, 1 << 34, 1 << 35, 1 << 36


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers; nation to region, customer and supplier to nation."""
    t = lambda n: table(spark, sf_dir, n)
    region, nation, customer, supplier = t("region"), t("nation"), t("customer"), t("supplier")
    vertices = (
        entity(region, {"vid": F.col("r_regionkey")}, text_map(name=F.col("r_name")), label=F.lit("Region"))
        .unionByName(entity(nation, {"vid": F.col("n_nationkey") + NATION}, text_map(name=F.col("n_name")), label=F.lit("Nation")))
        .unionByName(entity(supplier, {"vid": F.col("s_suppkey") + SUPPLIER}, text_map(name=F.col("s_name"), acctbal=F.col("s_acctbal")), label=F.lit("Supplier"), ontology_class=F.lit("bot:Party")))
        .unionByName(entity(customer, {"vid": F.col("c_custkey") + CUSTOMER}, text_map(name=F.col("c_name"), acctbal=F.col("c_acctbal"), segment=F.col("c_mktsegment")), label=F.lit("Customer"), ontology_class=F.lit("bot:Party")))
    )
    none = empty_props()
    edges = (
        entity(nation, {"eid": F.col("n_nationkey") + NATION, "src": F.col("n_nationkey") + NATION, "dst": F.col("n_regionkey")}, none, label=F.lit("IN_REGION"))
        .unionByName(entity(supplier, {"eid": F.col("s_suppkey") + SUPPLIER, "src": F.col("s_suppkey") + SUPPLIER, "dst": F.col("s_nationkey") + NATION}, none, label=F.lit("IN_NATION")))
        .unionByName(entity(customer, {"eid": F.col("c_custkey") + CUSTOMER, "src": F.col("c_custkey") + CUSTOMER, "dst": F.col("c_nationkey") + NATION}, none, label=F.lit("IN_NATION")))
    )
    return Graph(vertices, edges)


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected part pairs ``src < dst`` that share an order, with their number of orders as weight."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = items.select("l_orderkey", F.col("l_partkey").alias("src")), items.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three embedding dimensions as coordinates, rounded to six places."""
    x = [F.round(F.element_at("embedding", k).cast("double"), 6) for k in (1, 2, 3)]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), x[0].alias("x"), x[1].alias("y"), x[2].alias("z"))
