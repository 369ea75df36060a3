"""All queries of the reference's operator families, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvasir.plans import analysis, edits, extras, graphs, language, semantics, shapes, solids

QUERIES: dict = {**language.QUERIES, **graphs.QUERIES, **analysis.QUERIES, **extras.QUERIES, **shapes.QUERIES, **edits.QUERIES, **solids.QUERIES, **semantics.QUERIES}
SQL: dict[str, str] = {**language.SQL, **graphs.SQL, **analysis.SQL, **extras.SQL, **shapes.SQL, **edits.SQL, **solids.SQL, **semantics.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["gql_order_skip_limit"](spark, sf_dir)
