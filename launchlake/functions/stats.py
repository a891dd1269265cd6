"""Aggregate column sets shared by the counter operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stats6(name: str, prefix: str) -> list[Column]:
    """Mean, population deviation, min, max, median and nearest-rank p95.

    Nulls are ignored and an all-null group gives nulls. Both percentiles
    count distinct values, so repeated samples cost no extra memory.
    """
    col = F.col(name).cast("double")
    return [
        F.avg(col).alias(f"{prefix}_mean"),
        F.stddev_pop(col).alias(f"{prefix}_std"),
        F.min(col).alias(f"{prefix}_min"),
        F.max(col).alias(f"{prefix}_max"),
        F.percentile(col, 0.5).alias(f"{prefix}_median"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY CAST(`{name}` AS DOUBLE))").alias(f"{prefix}_p95"),
    ]


def gathered(value: Column, order: Column) -> Column:
    """Aggregate: the non-null values of a small group as an array in the given order, whatever the order of arrival."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("at"), value.cast("double").alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def mean_in_order(values: Column) -> Column:
    """Mean of an array summed from left to right, so that equal inputs give equal last digits; null if empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def deviation_in_order(values: Column) -> Column:
    """Population deviation of an array in one pass from left to right; null if empty."""
    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        mean = a["mean"] + (x - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["square"] + (x - mean) * (x - a["mean"])).alias("square"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))
    return F.when(F.size(values) > 0, F.sqrt(F.aggregate(values, start, step)["square"] / F.size(values)))


STATS = ("mean", "std", "min", "max", "median", "p95")
