"""Token-budget windows over launch streams.

A stream's queue holds the newest launches whose token costs fit the budget.
Every launch that overflows it, and the rest of the queue at the end, is a
candidate window; a candidate counts when its kernels pass the ratio gate and
its composition is new on the stream. Costs are at least one, so the queue in
front of launch ``j`` is exactly the launches whose exclusive prefix cost lies
within one budget of that of ``j``: a RANGE frame. The frames run in buckets
of the prefix cost, each with one budget of overlap, so a stream of any length
spreads over as many tasks as it has buckets and no frame or group is ever
larger than a fixed multiple of the budget.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchlake.functions import scalars
from launchlake.operators import launches as L
from launchlake.operators import ordered, sweep
from launchlake.session import materialize

STREAM = ("pid", "device_pci_bus_id", "stream")


@dataclass(frozen=True)
class WindowConfig:
    budget: int = 8190
    use_gate: bool = True
    threshold: float = 0.65
    include_tid: bool = False
    flush: bool = True
    # Physical knobs: results do not depend on them.
    scan_width: int = ordered.DEFAULT_WIDTH
    budgets_per_bucket: int = 16

    def keys(self, scope: Sequence[str] = ("capture_id",)) -> list[str]:
        return [*scope, *STREAM, *(["tid"] if self.include_tid else [])]


def stream_scan(launches: DataFrame, config: WindowConfig, scope: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Ready launches with ``idx``, prefix costs and the unready count so far."""
    rows = L.with_order(L.launch_readiness(launches))
    rows = ordered.running_totals(
        rows, config.keys(scope), L.ORDER, L.order_bucket(config.scan_width),
        {
            "upto": F.col("ready").cast("long"),
            "cost_upto": F.coalesce(F.col("token_cost"), F.lit(0)),
            "unready_upto": (~F.col("ready")).cast("long"),
        },
    )
    return rows.where("ready").withColumns(
        {"idx": F.col("upto") - 1, "cost_before": F.col("cost_upto") - F.col("token_cost")}
    )


def _queue_ends(launches: DataFrame, config: WindowConfig, scope: Sequence[str]) -> DataFrame:
    """One row per stream standing for the queue left at its end."""
    rows = L.with_order(L.launch_readiness(launches))
    return rows.groupBy(*config.keys(scope)).agg(
        F.coalesce(F.sum("token_cost"), F.lit(0)).alias("cost_before"),
        F.count_if("ready").alias("idx"),
        F.count_if(~F.col("ready")).alias("unready_upto"),
        F.min(F.struct(*L.ORDER)).alias("place"),
    )


def candidate_windows(
    launches: DataFrame, config: WindowConfig, scope: Sequence[str] = ("capture_id",)
) -> DataFrame:
    """Every gate-passing candidate with its composition, before de-duplication."""
    keys = config.keys(scope)
    scanned = stream_scan(launches, config, scope)
    place = F.struct(*L.ORDER).alias("place")
    rows = scanned.select(*keys, "idx", "cost_before", "token_cost", "unready_upto", place, F.col("kernel_id").alias("kernel"), "ratio", F.lit(False).alias("is_flush"))
    if config.flush:
        ends = _queue_ends(launches, config, scope)
        rows = rows.unionByName(ends.withColumn("is_flush", F.lit(True)), allowMissingColumns=True)
    budget, span = config.budget, config.budget * config.budgets_per_bucket
    own = F.floor(F.col("cost_before") / span).cast("long")
    tail = ~F.col("is_flush") & (F.col("cost_before") % span >= span - budget)
    rows = rows.withColumn("own", own).withColumn(
        "bucket", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    rows = rows.withColumn("warm", F.col("own") != F.col("bucket"))
    return sweep.candidates(rows, keys, ["idx", "is_flush", "place", "unready_upto"], budget, config.threshold if config.use_gate else None)


def with_kernel_sets(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``candidates`` with the kernels of every window, not only of the first of a bucket."""
    names = [*keys, "set_id"]
    sets = candidates.where(F.col("kernel_set").isNotNull()).groupBy(*names).agg(F.any_value("kernel_set").alias("kernel_set"))
    rows = candidates.drop("kernel_set").alias("c").join(sets.alias("s"), [F.col(f"c.{n}").eqNullSafe(F.col(f"s.{n}")) for n in names])
    return rows.select("c.*", "s.kernel_set")


def first_signature_only(candidates: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Keep the first candidate of each composition on its stream.

    A plain minimum over structs, so repeats are dropped before the shuffle. The first
    of a stream is the first of its bucket, so it carries its kernels. ``more`` are aggregates
    over all candidates of the composition.
    """
    signature = [*keys, "set_id", "top3"]
    rest = ["is_flush", "idx", *[c for c in candidates.columns if c not in (*signature, "is_flush", "idx")]]
    return candidates.groupBy(*signature).agg(F.min(F.struct(*rest)).alias("_w"), *more).drop("set_id").select("*", "_w.*").drop("_w")


def token_budget_windows(
    launches: DataFrame, config: WindowConfig = WindowConfig(), scope: Sequence[str] = ("capture_id",)
) -> DataFrame:
    """Windows of first-seen compositions, one row each; see ``window_members``."""
    candidates = candidate_windows(launches, config, scope)
    return first_signature_only(candidates, config.keys(scope))


def window_ids(windows: DataFrame, scope: Sequence[str] = ("capture_id",), width: int = ordered.DEFAULT_WIDTH) -> DataFrame:
    """Number windows per capture in emission order and name them.

    Final-flush windows come last, in order of the stream's first appearance.
    """
    flush = F.col("is_flush").cast("int")
    order = [flush, F.col("place._tier"), F.col("place._value"), F.col("place._line")]
    bucket = [flush, F.col("place._tier"), L.value_bucket(F.col("place._tier"), F.col("place._value"), width)]
    numbered = ordered.ordinal(windows, scope, order, bucket, "window_index")
    digits = F.col("window_index").cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return numbered.withColumn("window_id", F.concat(F.lit("w"), padded, F.lit("_dynamic_stream")))


def window_members(
    windows: DataFrame, launches: DataFrame, config: WindowConfig, scope: Sequence[str] = ("capture_id",),
    width: int = 1024,
) -> DataFrame:
    """Member launches of each window with their position in it.

    An interval join made an equi-join: both sides carry the bucket of the
    launch index, and a window is repeated once per bucket it touches.
    """
    keys = config.keys(scope)
    last = F.when(F.col("is_flush"), F.col("idx") - 1).otherwise(F.col("idx"))
    spans = windows.select(
        *keys, "window_id", F.col("start_idx").alias("_lo"), last.alias("_hi")
    ).withColumn("_b", F.explode(F.sequence(ordered.bucket_of("_lo", width), ordered.bucket_of("_hi", width))))
    rows = stream_scan(launches, config, scope).withColumn("_b", ordered.bucket_of("idx", width))
    joined = spans.alias("s").join(
        rows.alias("r"),
        [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
        + [F.col("s._b") == F.col("r._b"), F.col("idx").between(F.col("_lo"), F.col("_hi"))],
    )
    rest = [c for c in rows.columns if c not in (*keys, "_b", *L.ORDER)]
    return joined.select(
        *[F.col(f"s.{k}").alias(k) for k in keys], "window_id", (F.col("idx") - F.col("_lo")).alias("pos"), *rest
    )


def window_features(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The twelve launch features of each window.

    A window never holds more than one budget of launches, so its members fit
    one array; everything else is array expressions on one grouped row.
    """
    item = F.struct(
        "pos", "timestamp_ns", F.col("code_id").cast("string").alias("code"),
        F.coalesce(scalars.shape_key("grid_dim"), F.lit("None")).alias("grid"),
        F.coalesce(scalars.shape_key("block_dim"), F.lit("None")).alias("block"),
    )
    rows = members.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("m"))
    count = F.size("m")
    field = lambda n: F.transform("m", lambda x: x[n])
    counts = lambda n: F.transform(
        F.array_distinct(field(n)), lambda v: F.size(F.filter("m", lambda x: x[n].eqNullSafe(v)))
    )
    times = F.filter(field("timestamp_ns"), lambda t: t.isNotNull())
    rows = rows.select(
        *keys, "m", count.alias("n"),
        F.sort_array(counts("code"), asc=False).alias("code_counts"),
        F.array_max(counts("grid")).alias("grid_mode"), F.array_max(counts("block")).alias("block_mode"),
        times.alias("t"),
    )
    gaps = F.filter(
        F.transform(F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))),
                    lambda v, i: (v - F.col("t")[i]) / 1000.0), lambda g: g >= 0)
    rows = rows.withColumn("gaps", F.when(F.size("t") > 1, gaps).otherwise(F.array().cast("array<double>")))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    n_gaps = F.size("gaps")
    rows = rows.withColumn("gap_avg", F.when(n_gaps > 0, total(F.col("gaps")) / n_gaps).otherwise(0.0))
    spread = F.transform("gaps", lambda g: (g - F.col("gap_avg")) * (g - F.col("gap_avg")))
    rows = rows.withColumn("gap_std", F.when(n_gaps > 0, F.sqrt(total(spread) / n_gaps)).otherwise(0.0))
    share = lambda k: F.aggregate(
        F.slice("code_counts", 1, k), F.lit(0), lambda a, x: a + x) / F.col("n")
    entropy = F.aggregate(
        F.transform("code_counts", lambda c: c / F.col("n")), F.lit(0.0), lambda a, p: a - p * F.ln(p))
    first, last = F.col("m")[0]["timestamp_ns"], F.element_at("m", -1)["timestamp_ns"]
    span = F.when(last >= first, last - first).otherwise(
        F.when(F.size("t") > 1, F.array_max("t") - F.array_min("t")).otherwise(0))
    distinct = F.size("code_counts")
    return rows.select(
        *keys,
        F.col("n").cast("long").alias("launch_count"),
        F.when(F.col("n") < 2, 0.0).otherwise(scalars.ns_to_ms(span)).alias("duration_ms"),
        distinct.cast("long").alias("unique_code_id_count"),
        share(1).alias("dominant_code_id_ratio"),
        share(2).alias("top2_code_id_ratio"),
        share(3).alias("top3_code_id_ratio"),
        F.when(distinct > 1, entropy / F.ln(distinct)).otherwise(0.0).alias("normalized_entropy"),
        (F.col("grid_mode") / F.col("n")).alias("grid_stability"),
        (F.col("block_mode") / F.col("n")).alias("block_stability"),
        F.col("gap_avg").alias("avg_launch_gap_us"),
        F.col("gap_std").alias("launch_gap_std"),
        F.when(F.col("gap_avg") > 0, F.col("gap_std") / F.col("gap_avg")).otherwise(0.0).alias("launch_gap_cv"),
    )


def window_accounting(members: DataFrame, windows: DataFrame, config: WindowConfig, keys: Sequence[str]) -> DataFrame:
    """Eviction and drop counts per window, before and after it was emitted."""
    limit = F.col("start_cost") + F.col("window_cost") - config.budget
    names = [*keys, "window_id"]
    cut = members.join(windows.select(*names, "start_cost", "window_cost", "is_flush"), names)
    after = cut.groupBy(*names).agg(
        F.count_if(~F.col("is_flush") & (F.col("cost_before") < limit)).alias("post_emit_evicted_launches"))
    return windows.join(after, names).withColumns(
        {"evicted_launches": F.col("start_idx"), "dropped_unready_launches": F.col("unready_upto"),
         "distinct_kernel_count": F.size("kernel_set").cast("long")})


def proportional_condense(launches: DataFrame, keys: Sequence[str], target: int, position: str = "pos") -> DataFrame:
    """Shrink each group to ``target`` launches, sharing them over code runs.

    Works on a group of any size: runs are found with bucketed scans, and only
    one row per run takes part in the allocation.
    """
    bucket = [ordered.bucket_of(position)]
    rows = ordered.previous(launches, keys, [position], bucket, {"_before": "code_id"})
    change = (~F.col("_before").eqNullSafe(F.col("code_id"))) | (F.col(position) == 0)
    rows = ordered.running_totals(rows, keys, [position], bucket, {"_run": change.cast("int")})
    rows = materialize(rows, "code-runs")  # read by every step below
    runs = rows.groupBy(*keys, "_run").agg(
        F.min(position).alias("_start"), F.count(F.lit(1)).alias("_len"))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    runs = runs.join(totals, list(keys)).withColumn("_exact", F.col("_len") * target / F.col("_total"))
    runs = runs.withColumns({"_floor": F.greatest(F.lit(1), F.floor("_exact")),
                             "_frac": F.col("_exact") - F.floor("_exact")})
    alloc = _allocate(runs, keys, target)
    count, length = F.col("_alloc"), F.col("_len")
    step = (length - 1) / (count - 1)
    offset = (F.col(position) - F.col("_start"))
    picks = F.array_contains(
        F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.bround(i * step).cast("long")), offset)
    chosen = F.when(F.col("_total") <= target, True).when(count >= length, True).when(
        count == 1, offset == 0).otherwise(picks)
    kept = rows.join(alloc, [*keys, "_run"]).where(chosen)
    kept = ordered.ordinal(kept, keys, [position], bucket, "_nth")
    kept = kept.where((F.col("_nth") < target) | (F.col("_total") <= target))
    return kept.drop("_run", "_before", "_start", "_len", "_total", "_exact", "_floor", "_frac", "_alloc", "_nth", "_given")


def _allocate(runs: DataFrame, keys: Sequence[str], target: int) -> DataFrame:
    """Closed form of the repeat-until-it-fits allocation.

    Too many: the smallest fraction gives up all it can (down to one) before
    the next. Too few: the largest fraction takes the whole rest.
    """
    sums = runs.groupBy(*keys).agg(
        F.sum("_floor").alias("_given"),
        F.max(F.struct("_frac", (-F.col("_run")).alias("r"))).alias("_top"))
    rows = runs.join(sums, list(keys))
    # runs in order of (fraction, run); runs of one length share their fraction, so they are cut by number, too
    rows = ordered.running_totals(rows, keys, ["_frac", "_run"], [F.col("_frac"), ordered.bucket_of("_run")], {"_spare": F.col("_floor") - 1})
    over = F.greatest(F.col("_given") - target, F.lit(0))
    before = F.col("_spare") - (F.col("_floor") - 1)
    cut = F.greatest(F.lit(0), F.least(F.col("_floor") - 1, over - before))
    short = F.greatest(target - F.col("_given"), F.lit(0))
    extra = F.when(-F.col("_top.r") == F.col("_run"), short).otherwise(0)
    return rows.select(*keys, "_run", "_start", "_len", "_total", (F.col("_floor") - cut + extra).cast("long").alias("_alloc"))
