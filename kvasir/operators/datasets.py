"""Preparation and scoring of machine-learning tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 weighted by the true classes' sizes; 0 where undefined."""
    c = confusion(df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()), actual, predicted)
    rows = c.groupBy(F.col("actual").alias("k")).agg(F.sum("n").alias("true"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    cols = c.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("given"))
    j = rows.join(cols, "k", "left").na.fill(0)
    p = F.when(F.col("given") > 0, F.col("hit") / F.col("given")).otherwise(0.0)
    r = F.col("hit") / F.col("true")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    mean = lambda x: F.round(F.sum(x * F.col("true")) / F.sum("true"), 9)
    return j.agg(F.round(F.sum("hit") / F.sum("true"), 9).alias("accuracy"), mean(p).alias("precision"), mean(r).alias("recall"), mean(f1).alias("f1"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.agg(F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(1 - F.avg(e * e) / F.var_pop(actual), 6).alias("r2"))


def split(df: DataFrame, key: str, ratios: tuple[float, float, float], group: str | None = None) -> DataFrame:
    """Adds ``part`` (train, val, test) by a hash of the key or of its group: each row is dealt on its own, so no task sees all rows."""
    u = F.pmod(F.xxhash64(group or key), F.lit(1 << 20)) / float(1 << 20)
    a, b = ratios[0] / sum(ratios), (ratios[0] + ratios[1]) / sum(ratios)
    return df.withColumn("part", F.when(u < a, "train").when(u < b, "val").otherwise("test"))


def masks(train: Column, val: Column, test: Column) -> Column:
    """The part that a row's masks name; a null mask is false."""
    on = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    return F.when(on(train), "train").when(on(val), "val").when(on(test), "test").otherwise("none")


def stratified_folds(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """Adds ``fold``: ranks within a label, in order of the key, modulo k."""
    return df.withColumn("fold", ((F.row_number().over(W.partitionBy(label).orderBy(key)) - 1) % k).cast("int"))


def pareto_front(df: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    """Rows that no other dominates (all objectives at least as large, one larger); equal rows all stay.

    Two objectives need one sort: in order of the first, a row stays if its second exceeds all before it,
    taken over distinct first values, so a row per value reaches the single window.
    """
    if len(objectives) != 2:
        a, b = df.select(key, *objectives).alias("a"), df.select(*objectives).distinct().alias("b")
        worse = F.lit(True)
        some = F.lit(False)
        for o in objectives:
            worse &= F.col(f"b.{o}") >= F.col(f"a.{o}")
            some |= F.col(f"b.{o}") > F.col(f"a.{o}")
        return a.join(b, worse & some, "left_anti")
    x, y = objectives
    best = df.groupBy(x).agg(F.max(y).alias("_best"))
    before = F.max("_best").over(W.orderBy(F.desc(x)).rowsBetween(W.unboundedPreceding, -1))
    front = best.withColumn("_before", before).filter("_before IS NULL OR _best > _before").select(x, F.col("_best").alias(y))
    return df.join(front, [x, y], "left_semi").select(key, *objectives)


def feature_array(columns: list[str], prefix: str = "feat_") -> Column:
    """``feat_<i>`` columns in order of their numbers, nulls as 0."""
    names = sorted((c for c in columns if c.startswith(prefix) and c[len(prefix):].isdigit()), key=lambda c: int(c[len(prefix):]))
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])


def feature_cell(cell: Column) -> Column:
    """``[1,2]``, JSON, ``1,2`` or a scalar as an array of doubles."""
    inner = F.regexp_replace(cell, r"[\[\]\s]", "")
    return F.transform(F.filter(F.split(inner, ","), lambda x: x != ""), lambda x: x.cast("double"))


def resized(features: Column, width: int) -> Column:
    """Trimmed or padded with 0."""
    return F.slice(F.concat(features, F.array_repeat(F.lit(0.0), width)), 1, width)
