"""Counter time series: points, adaptive sliding windows, interval joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchlake.functions import scalars
from launchlake.functions.stats import STATS
from launchlake.operators import counter_sweep as sweep
from launchlake.operators import ordered
from launchlake.session import materialize

# Metric columns of the two sample tables.
DEVICE_METRICS = ["gpu_utilization_pct", "memory_utilization_pct", "power_usage_watts", "temperature_celsius", "fan_speed_pct"]
PROCESS_METRICS = ["process_gpu_utilization_pct", "process_gpu_memory_pct", "host_ram_gb"]
# Run metadata attached to every feature row.
METADATA = ["workload", "label", "binary_label", "family", "program", "variant", "experiment", "throttle_mode",
            "target_percent", "repeat", "runtime_sec"]

SECOND = 1_000_000_000


@dataclass(frozen=True)
class Sliding:
    window_s: float = 60.0
    step_s: float = 5.0
    min_ratio: float = 0.6
    interval_s: float = 1.0

    @property
    def window_ns(self) -> int:
        return int(round(self.window_s * SECOND))

    @property
    def step_ns(self) -> int:
        return int(round(self.step_s * SECOND))

    @property
    def interval_ns(self) -> int:
        return int(self.interval_s * SECOND)

    @property
    def needed(self) -> int:
        expected = max(1, math.floor(self.window_s / self.interval_s))
        return math.ceil(expected * self.min_ratio)


def _time_bucket(width_s: int = 3600) -> list[Column]:
    return [ordered.bucket_of("timestamp_ns", width_s * SECOND)]


def device_points(samples: DataFrame, keys: Sequence[str] = ("run_id", "gpu_uuid")) -> DataFrame:
    """One row per sample with its index in time order."""
    rows = samples.where(F.col("timestamp_ns").isNotNull())
    rows = ordered.ordinal(rows, keys, ["timestamp_ns"], _time_bucket(), "sample_index")
    return rows.select(*keys, "sample_index", "timestamp_ns", *[scalars.number(m).alias(m) for m in DEVICE_METRICS])


# Windows of one bucket; the samples that its last windows share with the next bucket travel twice.
BUCKET_WINDOWS = 512


def sliding_windows(samples: DataFrame, keys: Sequence[str], spec: Sliding, values: dict[str, Column] | None = None) -> DataFrame:
    """Windows with enough samples, numbered from 0 per group, with ``k``, ``n``, bounds and six statistics per entry of ``values``.

    A group no longer than one window has the single candidate 0; otherwise
    window ``k`` covers ``[first + k*step, first + k*step + window]``, both ends inclusive, and the
    last one must end by the last sample. All in integer nanoseconds. A group is cut into buckets of windows; each is
    swept once over its samples in time order, so no window is ever gathered as an array.
    """
    values = values or {}
    rows = samples.where(F.col("timestamp_ns").isNotNull()).select(*keys, F.col("timestamp_ns").alias("at"), *[v.cast("double").alias(n) for n, v in values.items()])
    span = rows.groupBy(*keys).agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    rows = rows.alias("x").join(span.alias("g"), [F.col(f"x.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]).select("x.*", "_first", "_last")
    width = max(BUCKET_WINDOWS, 4 * (-(-spec.window_ns // spec.step_ns) + 1))
    short = F.col("_last") - F.col("_first") <= spec.window_ns
    last_k = F.when(short, F.lit(0)).otherwise(_floor_div(F.col("_last") - F.col("_first") - spec.window_ns, spec.step_ns))
    offset = F.col("at") - F.col("_first")
    rows = rows.withColumn("last_k", last_k)
    rows = rows.withColumns({"low_k": F.greatest(_ceil_div(offset - spec.window_ns, spec.step_ns), F.lit(0)), "high_k": F.least(_floor_div(offset, spec.step_ns), "last_k")})
    rows = rows.where("low_k <= high_k").withColumn("bucket", F.explode(F.sequence(_floor_div(F.col("low_k"), width), _floor_div(F.col("high_k"), width))))
    windows = materialize(sweep.sliding(rows.drop("low_k", "high_k"), keys, list(values), spec, width), "windows")
    counts = windows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").where("bucket > 0")
    # windows of a first bucket, which are nearly all where groups are short, are numbered already
    later = windows.where("bucket > 0").alias("x").join(carried.alias("g"), [F.col(f"x.{k}").eqNullSafe(F.col(f"g.{k}")) for k in [*keys, "bucket"]])
    later = later.select("x.*", "_before").withColumn("window_index", F.col("window_index") + F.col("_before")).drop("_before")
    return windows.where("bucket = 0").unionByName(later).drop("bucket")


def _floor_div(value: Column, by: int) -> Column:
    """Exact integer division rounding down."""
    whole = value - F.pmod(value, F.lit(by))
    return F.call_function("div", whole, F.lit(by))


def _ceil_div(value: Column, by: int) -> Column:
    return -_floor_div(-value, by)


def device_windows(samples: DataFrame, spec: Sliding = Sliding(), keys: Sequence[str] = ("run_id", "gpu_uuid")) -> DataFrame:
    return sliding_windows(samples, keys, spec, {m: F.col(m) for m in DEVICE_METRICS})


def process_windows(samples: DataFrame, spec: Sliding = Sliding(), keys: Sequence[str] = ("run_id", "gpu_uuid", "pid")) -> DataFrame:
    rows = sliding_windows(samples.where(F.col("pid").isNotNull()), keys, spec, {m: F.col(m) for m in PROCESS_METRICS})
    util, memory, ram = PROCESS_METRICS
    rows = rows.select(*[c for c in rows.columns if not c.startswith(tuple(f"{m}_" for m in PROCESS_METRICS))],
                       F.col(f"{util}_mean").alias("avg_process_gpu_utilization_pct"), F.col(f"{util}_std").alias("std_process_gpu_utilization_pct"),
                       F.col(f"{memory}_mean").alias("avg_process_gpu_memory_pct"), F.col(f"{ram}_mean").alias("avg_host_ram_gb"))
    status = F.when(F.col("avg_process_gpu_utilization_pct").isNull(), "insufficient_process_util").otherwise("exact")
    return rows.withColumn("status", status).withColumnRenamed("n", "sample_count")


def hybrid_windows(processes: DataFrame, devices: DataFrame, spec: Sliding = Sliding()) -> DataFrame:
    """Process windows with statistics of the device samples inside them.

    Windows ask in the stretch of time they start in, beside the device samples of it and of one window more; so the
    interval join needs no pairs of windows and samples.
    """
    keys, device = ["run_id", "gpu_uuid", "pid"], ["run_id", "gpu_uuid"]
    prefixed = {m if m.startswith("process_") else f"process_{m}": F.col(m) for m in PROCESS_METRICS}
    windows = sliding_windows(processes.where(F.col("pid").isNotNull()), keys, spec, prefixed)
    own = [f"{p}_{s}" for p in prefixed for s in STATS]
    windows = windows.select(*keys, "window_index", F.col("start_ns").alias("window_start_ns"), F.col("end_ns").alias("window_end_ns"), F.col("n").alias("sample_count_process"), *own)
    width = max(BUCKET_WINDOWS * spec.step_ns, 4 * spec.window_ns)
    asks = windows.withColumn("bucket", _floor_div(F.col("window_start_ns"), width))
    samples = devices.where(F.col("timestamp_ns").isNotNull()).select(
        *device, F.col("timestamp_ns").alias("at"), *[F.col(m).cast("double").alias(f"device_{m}") for m in DEVICE_METRICS],
        F.explode(F.sequence(_floor_div(F.col("timestamp_ns") - spec.window_ns, width), _floor_div(F.col("timestamp_ns"), width))).alias("bucket"))
    return sweep.inside(asks, samples, device, [f"device_{m}" for m in DEVICE_METRICS], "sample_count_device")


def enrich_with_metadata(features: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Attach run metadata; the engine broadcasts the runs while they are small."""
    have = [F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c) for c in METADATA]
    return features.join(runs.select(key, *have), key, "left")


def usable_features(rows: DataFrame, candidates: Sequence[str]) -> list[str]:
    """Candidates that are numeric in every row, found in one aggregate."""
    checks = [F.count_if(scalars.number(c).isNull() | F.isnan(scalars.number(c))).alias(c) for c in candidates]
    counts = rows.agg(*checks).first()
    return [c for c in candidates if counts[c] == 0]


def complete_rows(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    typed = rows.withColumns({c: scalars.number(c) for c in features})
    return typed.dropna(subset=list(features)) if features else typed


def feature_report(runs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(metric, key, n): rows per feature table and runs per label."""
    ran = runs.where(F.col("status") != "skipped_missing_executable")
    parts = [ran.groupBy(F.lit("label").alias("metric"), F.col("binary_label").alias("key")).agg(F.count(F.lit(1)).alias("n")),
             runs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("runs").alias("metric"), F.lit("scanned").alias("key"), "n")]
    for name, table in tables.items():
        parts.append(table.agg(F.count(F.lit(1)).alias("n")).select(F.lit("table").alias("metric"), F.lit(name).alias("key"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def join_process_sources(memory: DataFrame, utilisation: DataFrame) -> DataFrame:
    """Union of both snapshots by (time, device, pid), the memory side's name first."""
    keys = ["timestamp_ns", "gpu_uuid", "pid"]
    joined = memory.alias("m").join(utilisation.alias("u"), keys, "full_outer")
    return joined.select(*keys, F.coalesce("m.process_name", "u.process_name").alias("process_name"),
                         "m.memory_used_bytes", "u.process_gpu_utilization_pct")


def rule_accuracy(windows: DataFrame) -> DataFrame:
    """Verdict counts and accuracy over the windows that could be judged."""
    verdict = scalars.process_verdict(
        F.col("status"), F.col("avg_process_gpu_utilization_pct"), F.col("avg_process_gpu_memory_pct"),
        F.col("avg_host_ram_gb"), F.col("std_process_gpu_utilization_pct"))
    rows = windows.withColumn("verdict", verdict)
    comparable = F.col("verdict").isin("benign", "suspicious_mining") & F.col("binary_label").isin("benign", "mining")
    correct = comparable & ((F.col("verdict") == "suspicious_mining") == (F.col("binary_label") == "mining"))
    return rows.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(comparable).alias("comparable"), F.count_if(correct).alias("correct"))


def parse_counter_csv(lines: DataFrame, fields: Sequence[str], text: str = "line") -> DataFrame:
    """Raw monitor CSV lines to one string column per field; short rows padded."""
    cells = F.transform(F.split(text, ","), lambda c: F.trim(c))
    rows = lines.where(F.trim(text) != "").withColumn("_cells", cells)
    picked = {f: F.coalesce(F.get("_cells", F.lit(i)), F.lit("")) for i, f in enumerate(fields)}
    return rows.withColumns(picked).drop("_cells")


def parse_process_monitor(lines: DataFrame, text: str = "line") -> DataFrame:
    """Whitespace process table; the rest of a line is the process name."""
    parts = F.split(F.trim(text), r"\s+")
    rows = lines.where((F.trim(text) != "") & ~F.trim(text).startswith("#"))
    # a generator of one row: filters stay above it, so a line is split once and not for every filter and column again
    rows = rows.withColumn("_p", F.explode_outer(F.array(parts))).where(F.size("_p") >= 10)
    # The numeric columns after index, pid and type.
    numeric = ["process_gpu_utilization_pct", "monitor_memory_utilization_pct", "encoder_utilization_pct",
               "decoder_utilization_pct", "jpg_utilization_pct", "ofa_utilization_pct"]
    rows = rows.withColumns({
        "gpu_index": scalars.counter_number(F.col("_p")[0]).cast("long"), "pid": scalars.counter_number(F.col("_p")[1]).cast("long"),
        "process_type": scalars.dash_to_null(F.col("_p")[2]),
        **{n: scalars.counter_number(F.col("_p")[i + 3]) for i, n in enumerate(numeric)},
        "process_name": scalars.dash_to_null(F.array_join(F.slice("_p", 10, F.size("_p")), " "))})
    return rows.where(F.col("gpu_index").isNotNull() & F.col("pid").isNotNull()).drop("_p")


def in_run_order(points: DataFrame, key: str = "run_id") -> DataFrame:
    """Add ``_at``, the place of a point in its run."""
    return ordered.ordinal(points, [key], ["timestamp_ns"], _time_bucket(), "_at")


def run_alarms(placed: DataFrame, key: str = "run_id") -> DataFrame:
    """``run_alarm_rows`` of points that have their place; they are read once."""
    positive = F.col("prediction") == "mining"
    p = F.coalesce(F.col("mining_probability"), F.lit(0.0))
    per_label = placed.groupBy(key, "binary_label").agg(
        F.count(F.lit(1)).alias("c"), F.min("_at").alias("f"), F.count_if(positive).alias("positive"), F.sum(p).alias("total"), F.max(p).alias("most"),
        F.min(F.when(positive, F.col("_at"))).alias("first"), F.count(positive).alias("judged"))
    return per_label.groupBy(key).agg(
        F.sum("positive").alias("positive_count"), F.sum("c").alias("sample_count"), (F.sum("positive") / F.sum("judged")).alias("positive_ratio"),
        (F.sum("total") / F.sum("c")).alias("mean_mining_probability"), F.max("most").alias("max_mining_probability"), F.min("first").alias("first_positive_index"),
        F.max(F.struct("c", (-F.col("f")).alias("f"), "binary_label"))["binary_label"].alias("binary_label"))


def run_alarm_rows(points: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run: majority label, positive share, probabilities, first positive place."""
    return run_alarms(in_run_order(points, key), key)
