"""List helpers: over rows where the list is a table's column, over arrays where it is a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bin_average(df: DataFrame, group: str, value: str, gap: float) -> DataFrame:
    """``group, bin, average``: sorted values fall into chains whose steps are at most ``gap``; each chain's mean."""
    w = W.partitionBy(group).orderBy(value)
    starts = (F.col(value) - F.lag(value).over(w) > gap) | F.lag(value).over(w).isNull()
    chained = df.select(group, value).withColumn("s", F.when(starts, 1).otherwise(0)).withColumn("bin", F.sum("s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return chained.groupBy(group, "bin").agg(F.round(F.avg(value), 6).alias("average"))


def merge_by_threshold(values: Column, threshold: float) -> Column:
    """A fold over the sorted array: a value within the threshold of the last one is averaged into it."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (F.abs(x - F.try_element_at(acc, F.lit(-1))) <= threshold)
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array((last + x) / 2))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), step)


def normalize(value: Column, low: Column, high: Column) -> Column:
    """To [0, 1]; 0 where all are equal."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def make_unique(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``unique_name``: the name, with ``_1``, ``_2`` for later repeats."""
    n = F.row_number().over(W.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat_ws("_", F.col(name), n.cast("string"))))


def trim(values: Column, size: int) -> Column:
    return F.slice(values, 1, size)


def repeat_to(values: Column, size: int) -> Column:
    """The array over and over, to a size."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.element_at(values, (i % F.size(values) + 1).cast("int")))


def closest_index(values: Column, target: Column) -> Column:
    """Position from 0 of the value nearest to the target, the first on ties."""
    ranked = F.transform(values, lambda x, i: F.struct(F.abs(x - target).alias("d"), i.alias("i")))
    return F.array_min(ranked)["i"]


def maximum_indices(values: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.get(values, i) == F.array_max(values))


def minimum_indices(values: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.get(values, i) == F.array_min(values))


def position(values: Column, item: Column) -> Column:
    """Place from 0 in the sorted array, or where the item would go."""
    return F.size(F.filter(values, lambda x: x < item))


def remove_even(values: Column) -> Column:
    """Without the members at even places from 0."""
    return F.filter(values, lambda x, i: i % 2 == 1)


def remove_odd(values: Column) -> Column:
    return F.filter(values, lambda x, i: i % 2 == 0)


def iterate_to(values: Column, size: Column) -> Column:
    """Cycles through the array up to a size."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(values, i % F.size(values)))


def pad_last(values: Column, size: Column) -> Column:
    """Repeats the last member up to a size."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(values, F.least(i, F.size(values) - 1)))


def trim_all(nested: Column) -> Column:
    """All sublists at the shortest one's size."""
    return F.transform(nested, lambda x: F.slice(x, 1, F.array_min(F.transform(nested, F.size))))


def transpose(nested: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.array_min(F.transform(nested, F.size)) - 1), lambda j: F.transform(nested, lambda r: F.get(r, j)))


def grow(pairs: DataFrame, seed: int, size: int) -> DataFrame:
    """``node, step``: a connected group of up to ``size`` nodes from a seed, breadth first, smaller nodes first."""
    from kvasir.operators import iterate
    from kvasir.operators.model import undirected

    reached = iterate.bfs(undirected(pairs), pairs.sparkSession.range(1).select(F.lit(seed).cast("long").alias("node")))
    return reached.select("node", F.col("depth").alias("step")).orderBy("step", "node").limit(size)
