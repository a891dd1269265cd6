"""Shaping, filtering and summarising launch events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchlake.functions import scalars
from launchlake.operators import ordered

# The fields of a launch row and their types.
LAUNCH_FIELDS = {
    "sequence": "long",
    "timestamp_ns": "long",
    "pid": "long",
    "tid": "long",
    "code_id": "long",
    "kernel_name": "string",
    "grid_dim": "array<int>",
    "block_dim": "array<int>",
    "shared_mem_bytes": "long",
    "stream": "long",
    "device_pci_bus_id": "string",
}


def launch_projection(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the launch fields (missing ones null), plus ``keep``."""
    have = set(events.columns)
    fields = [
        (F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in LAUNCH_FIELDS.items()
    ]
    return events.where(F.col("type") == "kernel_launch").select(*keep, *fields)


def order_columns(columns: Sequence[str]) -> tuple[Column, Column, Column]:
    """(tier, value, line): sequence first, else timestamp, else line."""
    pick = lambda n: F.col(n).cast("long") if n in columns else F.lit(None).cast("long")
    seq, ts, line = pick("sequence"), pick("timestamp_ns"), F.coalesce(pick("line"), F.lit(0))
    tier = F.when(seq.isNotNull(), 0).when(ts.isNotNull(), 1).otherwise(2)
    return tier, F.coalesce(seq, ts, line), F.when(tier < 2, line).otherwise(0)


def with_order(df: DataFrame) -> DataFrame:
    tier, value, line = order_columns(df.columns)
    return df.withColumns({"_tier": tier, "_value": value, "_line": line})


ORDER = ("_tier", "_value", "_line")


def value_bucket(tier: Column, value: Column, width: int = ordered.DEFAULT_WIDTH) -> Column:
    """Bucket of an order value; timestamps count nanoseconds, so theirs are a million times as wide."""
    return F.when(tier == 1, ordered.bucket_of(value, width * 1_000_000)).otherwise(ordered.bucket_of(value, width))


def order_bucket(width: int = ordered.DEFAULT_WIDTH) -> list[Column]:
    return [F.col("_tier"), value_bucket(F.col("_tier"), F.col("_value"), width)]


def event_order(events: DataFrame, keys: Sequence[str], width: int = ordered.DEFAULT_WIDTH) -> DataFrame:
    """Add ``position``: the place of each event in its capture's order."""
    return ordered.ordinal(with_order(events), keys, ORDER, order_bucket(width), "position").drop(*ORDER)


def split_by_event_type(events: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Per capture: code and launch counts and the reason it is rejected, if any."""
    counted = events.groupBy(*keys).agg(
        F.count_if(F.col("type") == "code").alias("code_events"),
        F.count_if(F.col("type") == "kernel_launch").alias("launch_events"),
    )
    reason = F.when(F.col("code_events") == 0, "no code event").when(
        F.col("launch_events") == 0, "no kernel_launch event"
    )
    return counted.withColumn("reject_reason", reason)


def launch_readiness(launches: DataFrame) -> DataFrame:
    """Add ``ready``, ``kernel_id``, ``token_cost`` and ``ratio``."""
    cost_raw = F.col("l0_token_cost")
    fractional = dict(launches.dtypes)["l0_token_cost"] in ("double", "float")
    cost = F.floor(cost_raw).cast("long") if fractional else cost_raw.cast("string").try_cast("long")
    ratio = scalars.number("l0_bitwise_integer_ratio")
    ready = F.col("l0_kernel_id").isNotNull() & cost.isNotNull() & ratio.isNotNull() & (cost > 0)
    ready = F.coalesce(ready, F.lit(False))
    return launches.withColumns(
        {
            "ready": ready,
            "kernel_id": F.when(ready, F.col("l0_kernel_id").cast("string")),
            "token_cost": F.when(ready, cost),
            "ratio": F.when(ready, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))),
        }
    )


def readiness_counts(launches: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = launch_readiness(launches)
    return rows.groupBy(*keys).agg(
        F.count_if("ready").alias("ready_launches"), F.count_if(~F.col("ready")).alias("unready_launches")
    )


def limit_launches(launches: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """First ``n`` launches per group.

    The rank filter is pushed below the shuffle, so every map task passes on
    at most ``n`` rows per group.
    """
    rows = with_order(launches)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER)))
    return rows.where(F.col("rank") <= n).drop(*ORDER)


def event_type_counts(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by type with the fallback column, lenient about missing types."""
    names = [F.nullif(F.col(c), F.lit("")) for c in ("type", "event_type") if c in events.columns]
    return events.groupBy(*keys, F.coalesce(*names, F.lit("unknown")).alias("type")).agg(
        F.count(F.lit(1)).alias("n")
    )


def capture_event_summary(events: DataFrame, key: str = "capture_id", names: int = 12) -> DataFrame:
    """One row per capture: type counts, code bytes, devices, names, duration."""
    launch = F.col("type") == "kernel_launch"
    code = F.col("type") == "code"
    base = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(code).alias("code_file_count"),
        F.count_if(launch).alias("launch_count"),
        F.coalesce(F.sum(F.when(code, F.col("size"))), F.lit(0)).alias("code_total_bytes"),
        F.round((F.max("timestamp_ns") - F.min("timestamp_ns")) / 1e9, 6).alias("observed_duration_s"),
        F.array_join(F.sort_array(F.collect_set(F.when(launch, F.col("device_pci_bus_id")))), ",").alias("devices"),
    )
    counts = event_type_counts(events, [key]).groupBy(key).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat_ws("=", x["type"], x["n"])
            ), ","
        ).alias("event_type_counts")
    )
    # distinct names by first appearance; the rank filter keeps n rows per task
    seen = events.where(launch & (F.coalesce("kernel_name", F.lit("")) != "")).groupBy(key, "kernel_name").agg(
        F.min("sequence").alias("first")
    )
    seen = seen.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("first")))
    first_names = seen.where(F.col("nth") <= names).groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "kernel_name"))),
                                 lambda x: x["kernel_name"]), ",").alias("sample_kernel_names")
    )
    return base.join(counts, key, "left").join(first_names, key, "left")


def top_kernels(launches: DataFrame, key: str = "capture_id", n: int = 5) -> DataFrame:
    """Most launched named kernels with rates over all launches of the capture."""
    named = F.trim(F.coalesce("kernel_name", F.lit(""))) != ""
    totals = launches.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_launches"),
        F.count_if(named).alias("named_launches"),
        F.greatest((F.max("timestamp_ns") - F.min("timestamp_ns")) / 1e9, F.lit(1e-9)).alias("duration_s"),
    )
    per_kernel = launches.where(named).groupBy(key, "kernel_name", "code_id").agg(
        F.count(F.lit(1)).alias("launch_count"),
        F.min("sequence").alias("first_seen"),
        scalars.shape_key(F.min_by("grid_dim", "sequence")).alias("first_grid_dim"),
        scalars.shape_key(F.min_by("block_dim", "sequence")).alias("first_block_dim"),
    )
    by_count = Window.partitionBy(key).orderBy(F.desc("launch_count"), "first_seen")
    ranked = per_kernel.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= n)
    return ranked.join(totals, key).withColumn("launches_per_second", F.col("launch_count") / F.col("duration_s"))


def drop_statistics(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Latest cumulative drop counters per session."""
    stats = events.where(F.col("type") == "stats")
    return stats.groupBy(key).agg(
        F.max_by("dropped_events", "sequence").alias("dropped_events"),
        F.max_by("queued_events", "sequence").alias("queued_events"),
        F.count(F.lit(1)).alias("reports"),
    )


def capture_gate(launches: DataFrame, threshold: float, key: str = "capture_id") -> DataFrame:
    """Captures whose best kernel ratio reaches the threshold, with that ratio."""
    rows = launch_readiness(launches).where("ready")
    best = rows.groupBy(key).agg(
        F.max("ratio").alias("max_ratio"), F.count_distinct("kernel_id").alias("unique_kernel_count")
    )
    return best.withColumn("gate_short_circuit", F.col("max_ratio") < threshold)


def launch_gaps(launches: DataFrame, keys: Sequence[str], width: int = ordered.DEFAULT_WIDTH) -> DataFrame:
    """Gaps to the launch before, in microseconds; backward steps are left out."""
    rows = with_order(launches.where(F.col("timestamp_ns").isNotNull()))
    rows = ordered.previous(rows, keys, ORDER, order_bucket(width), {"previous_ns": "timestamp_ns"})
    rows = rows.where(F.col("timestamp_ns") >= F.col("previous_ns"))
    return rows.withColumn("gap_us", scalars.ns_to_us(F.col("timestamp_ns") - F.col("previous_ns"))).drop(*ORDER)


def window_duration(launches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last minus first by position; max minus min when that is null or negative."""
    rows = with_order(launches)
    place = F.struct(*ORDER)
    grouped = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("timestamp_ns"), place)["timestamp_ns"].alias("first_ns"),
        F.max_by(F.struct("timestamp_ns"), place)["timestamp_ns"].alias("last_ns"),
        F.min("timestamp_ns").alias("min_ns"),
        F.max("timestamp_ns").alias("max_ns"),
    )
    span = F.col("last_ns") - F.col("first_ns")
    ns = F.when(F.col("n") < 2, 0).when(span >= 0, span).otherwise(
        F.coalesce(F.col("max_ns") - F.col("min_ns"), F.lit(0))
    )
    return grouped.select(*keys, "n", scalars.ns_to_ms(ns).alias("duration_ms"))


def normalized_entropy(launches: DataFrame, keys: Sequence[str], value: str = "code_id") -> DataFrame:
    """Entropy of ``value`` per group over ln(distinct); 0 for one value."""
    counts = launches.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    # -sum(p ln p) = ln(n) - sum(c ln c) / n, so one pass over the counts is enough
    grouped = counts.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.sum(F.col("c") * F.ln("c")).alias("clnc")
    )
    entropy = (F.ln("n") - F.col("clnc") / F.col("n")) / F.ln("d")
    return grouped.select(
        *keys, F.col("n").alias("launch_count"), F.col("d").alias("unique_values"),
        F.when(F.col("d") <= 1, 0.0).otherwise(entropy).alias("normalized_entropy"),
    )


def process_info(events: DataFrame) -> DataFrame:
    """First process document per session with the workload name from its path."""
    first = events.groupBy("session_id").agg(F.min_by(F.struct(*[F.col(c) for c in events.columns if c != "session_id"]), "sequence").alias("first"))
    rows = first.select("session_id", "first.*")
    return rows.withColumn("workload", F.element_at(F.split("exe_path", "/"), -1))


def message_routing(messages: DataFrame) -> DataFrame:
    """Add ``route`` and ``error`` from the message type and session."""
    kind, session = F.col("type"), F.coalesce(F.col("session_id"), F.lit(""))
    # Message types of the live feed.
    known = ("session_end", "kernel_launch_batch", "process_info", "code_object", "stats")
    control = kind.isin("collector_hello", "collector_shutdown")
    error = (
        F.when(control, None)
        .when(session == "", "missing session_id")
        .when(~F.coalesce(kind.isin(*known), F.lit(False)), F.concat(F.lit("unknown message type: "), F.coalesce(kind, F.lit("None"))))
    )
    route = F.when(F.coalesce(control, F.lit(False)), "control").when(error.isNotNull(), "error").otherwise(kind)
    return messages.withColumns({"route": route, "error": error})


def stream_key(include_tid: bool = False) -> list[str]:
    return ["pid", "device_pci_bus_id", "stream", *(["tid"] if include_tid else [])]


