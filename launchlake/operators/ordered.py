"""Ordered scans that do not put a whole group into one task.

A plain ``Window.partitionBy(key)`` sorts every group in a single task, so one
stream or run that holds a third of the data decides the run time. The scans
here cut each group into order-preserving buckets, scan the buckets in
parallel, and carry one summary row per bucket across. Only the summaries are
ever gathered per group.

``bucket`` is a list of columns that never decrease in scan order, such as
``sequence div 65536``. The result does not depend on its width.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 16


def bucket_of(value: Column | str, width: int = DEFAULT_WIDTH) -> Column:
    """Order-preserving bucket number of an integer position."""
    col = F.col(value) if isinstance(value, str) else value
    return F.floor(col / F.lit(width)).cast("long")


def _null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def _with_buckets(df: DataFrame, bucket: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_bucket{i}" for i in range(len(bucket))]
    return df.withColumns(dict(zip(names, bucket))), names


def _attach(rows: DataFrame, carried: DataFrame, names: Sequence[str]) -> DataFrame:
    joined = rows.join(carried, _null_safe(rows, carried, names), "left")
    return joined.drop(*[carried[n] for n in names])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Sequence[Column],
    totals: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums per group, one column per entry of ``totals``."""
    rows, buckets = _with_buckets(df, bucket)
    names = [*keys, *buckets]
    rows = rows.withColumns({f"_part_{n}": c.cast("long") for n, c in totals.items()})
    before = Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*names).agg(*[F.sum(f"_part_{n}").alias(f"_sum_{n}") for n in totals])
    carried = carried.select(*names, *[F.sum(f"_sum_{n}").over(before).alias(f"_part_{n}") for n in totals], F.lit(False).alias("_is_row"))
    # the sum carried into a bucket stands in it as a row before all others, so the rows are shuffled once and meet no join
    both = rows.withColumn("_is_row", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    local = Window.partitionBy(*names).orderBy("_is_row", *order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({n: F.coalesce(F.sum(f"_part_{n}").over(local), F.lit(0).cast("long")) for n in totals}).where("_is_row")
    return out.drop(*[f"_part_{n}" for n in totals], *buckets, "_is_row")


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Sequence[Column], name: str
) -> DataFrame:
    """Zero-based position of each row in its group."""
    out = running_totals(df, keys, order, bucket, {"_counted": F.lit(1)})
    return out.withColumn(name, F.col("_counted") - 1).drop("_counted")


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Sequence[Column],
    columns: dict[str, str],
) -> DataFrame:
    """Add the value each column had in the row before (null for the first)."""
    rows, buckets = _with_buckets(df, bucket)
    names = [*keys, *buckets]
    local = Window.partitionBy(*names).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*buckets)
    position = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    values = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    carried = rows.groupBy(*names).agg(F.max_by(values, position).alias("_last"))
    carried = carried.select(*names, F.lag("_last").over(across).alias("_carry"))
    scanned = rows.withColumn("_here", F.lag(values).over(local))
    out = _attach(scanned, carried, names)
    source = F.coalesce(F.col("_here"), F.col("_carry"))
    out = out.withColumns({new: source[new] for new in columns})
    return out.drop("_here", "_carry", *buckets)


def quantile_by_rank(df: DataFrame, keys: Sequence[str], value: str, bins: int = 1024) -> DataFrame:
    """Exact median per group for groups of any size.

    Values are first counted per distinct value (combined on the map side).
    A coarse histogram per group then tells which bins hold the middle ranks,
    and only the rows of those bins are ranked. Even counts average the two
    middle values.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    span = counted.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("n")
    )
    placed = _attach(counted, span, keys).withColumn(
        "_bin",
        F.when(F.col("_hi") > F.col("_lo"),
               F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)).otherwise(F.lit(0)),
    )
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins_df = placed.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m"))
    bins_df = bins_df.withColumn("_below", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    names = [*keys, "_bin"]
    first_rank, second_rank = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    ranked = _attach(placed, bins_df, names).where(
        (F.col("_below") < second_rank) & (F.col("_below") + F.col("_m") >= first_rank)
    )
    within = Window.partitionBy(*names).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranked.withColumn("_upto", F.col("_below") + F.sum("_n").over(within))
    hit = lambda r: (F.col("_upto") >= r) & (F.col("_upto") - F.col("_n") < r)
    return upto.groupBy(*keys).agg(
        F.max("n").alias("n"),
        ((F.max(F.when(hit(first_rank), F.col("_v"))) + F.max(F.when(hit(second_rank), F.col("_v")))) / 2).alias("median"),
    )
