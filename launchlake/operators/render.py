"""Window text: fragments of the member kernels, clipped to the budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from launchlake.functions import text as T


def kernel_fragments(fragments: DataFrame) -> DataFrame:
    """One row per kernel: its lines and costs in order, boundary last."""
    rows = fragments.groupBy("kernel_id").agg(F.array_sort(F.collect_list(F.struct("idx", "line", "cost"))).alias("ls"))
    lines = F.concat(F.transform("ls", lambda x: F.struct(x["line"].alias("line"), x["cost"].alias("cost"))),
                     F.array(F.struct(F.lit(T.KERNEL_BOUNDARY).alias("line"), F.lit(1).cast("long").alias("cost"))))
    return rows.select("kernel_id", lines.alias("lines"), F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["cost"]).alias("fragment_cost"))


def render_windows(
    members: DataFrame, kernels: DataFrame, fragments: DataFrame, keys: Sequence[str], budget: int | None
) -> DataFrame:
    """Text of each window with its costs and what was clipped or missing.

    Fragments are built once per kernel. With a budget, the newest lines are
    kept; members are cut by the costs of their fragments before any line is
    joined, so no window carries more text than the budget allows. A window
    none of whose launches has a listing is kept with ``failed`` and no text.
    ``missing_kernels`` names the kernels without a listing.
    """
    frags = kernels.join(kernel_fragments(fragments), "kernel_id").select("kernel", "lines", "fragment_cost")
    rows = members.select(*keys, "pos", "kernel_id").join(
        frags.select("kernel", "fragment_cost"), F.col("kernel_id") == F.col("kernel"), "left")
    newest = Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("after", F.coalesce(F.sum("fragment_cost").over(newest), F.lit(0)))
    unknown = F.array_sort(F.collect_set(F.when(F.col("kernel").isNull(), F.coalesce(F.col("kernel_id").cast("string"), F.lit("unnamed")))))
    totals = rows.groupBy(*keys).agg(
        F.count("kernel").alias("included_launches"), F.count_if(F.col("kernel").isNull()).alias("missing_launches"), unknown.alias("missing_kernels"),
        F.coalesce(F.sum("fragment_cost"), F.lit(0)).alias("pre_clip_token_cost"))
    live = rows.where(F.col("kernel").isNotNull())
    if budget is not None:
        live = live.where(F.col("after") < budget)
    lines = live.select(*keys, "pos", "kernel").join(frags.select("kernel", "lines"), "kernel").select(
        *keys, "pos", F.posexplode("lines").alias("at", "l")).select(*keys, "pos", "at", F.col("l.line").alias("line"), F.col("l.cost").alias("cost"))
    if budget is not None:
        back = Window.partitionBy(*keys).orderBy(F.desc("pos"), F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
        lines = lines.withColumn("upto", F.sum("cost").over(back)).where(F.col("upto") <= budget)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at", "line"))), lambda x: x["line"]), "\n")
    out = totals.join(lines.groupBy(*keys).agg(F.sum("cost").alias("token_cost"), text.alias("text")), list(keys), "left")
    cost = F.coalesce("token_cost", F.lit(0))
    front = F.col("pre_clip_token_cost") > budget if budget is not None else F.lit(False)
    return out.select(*keys, "included_launches", "missing_launches", "missing_kernels", "pre_clip_token_cost", cost.alias("token_cost"), front.alias("front_clipped"),
                      F.greatest(F.lit(0), F.col("pre_clip_token_cost") - cost).alias("clipped_token_count"), (F.col("included_launches") == 0).alias("failed"), "text")
