"""Stream operators built from plain stream aggregates and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlake.operators.counter_sweep import list_windows6

Scorer = Callable[[pd.DataFrame], pd.Series]


def score_windows(windows: DataFrame, scorer: Callable[[], Scorer]) -> DataFrame:
    """Add ``score`` and ``failed`` with a model loaded once per task.

    Works on batch and stream frames. A batch the model refuses is retried row
    by row; rows it still refuses are flagged with the error, never dropped.
    """
    schema = windows.schema.simpleString()[len("struct<"):-1] + ",score:double,failed:boolean,error:string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for batch in batches:
            try:
                scored = [(s, None) for s in model(batch)]
            except Exception:  # noqa: BLE001 - fail open per window
                scored = [_one(model, batch.iloc[[i]]) for i in range(len(batch))]
            out = batch.copy()
            out["score"] = [s for s, _ in scored]
            out["error"] = [e for _, e in scored]
            out["failed"] = out["error"].notna()
            out = out[[*batch.columns, "score", "failed", "error"]]
            yield out

    return windows.mapInPandas(run, schema)


def _one(model: Scorer, row: pd.DataFrame) -> tuple[float | None, str | None]:
    """Score and no error, or no score and the error."""
    try:
        return float(model(row).iloc[0]), None
    except Exception as failure:  # noqa: BLE001
        return None, f"{type(failure).__name__}: {failure}"


def stream_drop_stats(events: DataFrame, observed: str = "drops") -> DataFrame:
    """Running drop counters and unready launches per session.

    Totals of every batch (launches, unready launches, statistics messages) are observed under the name ``observed``.
    """
    stats, launch = F.col("type") == "stats", F.col("type") == "kernel_launch"
    events = events.observe(observed, F.count_if(launch).alias("launches"), F.count_if(launch & F.col("l0_kernel_id").isNull()).alias("unready_launches"),
                            F.count_if(stats).alias("stats"))
    return events.groupBy("session_id").agg(
        F.max_by(F.when(stats, F.col("dropped_events")), F.when(stats, F.col("sequence"))).alias("dropped_events"),
        F.max_by(F.when(stats, F.col("queued_events")), F.when(stats, F.col("sequence"))).alias("queued_events"),
        F.count_if(launch & F.col("l0_kernel_id").isNull()).alias("unready_launches"))


def stream_counter_windows(samples: DataFrame, metric: str, window: str = "60 seconds", step: str = "5 seconds", delay: str = "30 seconds") -> DataFrame:
    """Event-time windows with a lateness bound, for append mode: the windows that begin in a stretch of two window lengths leave
    the state together, when the watermark passes their last end, and a row that comes more than ``delay`` after the newest one is
    dropped from stretches that have left.

    These start on the epoch grid and exclude their end, so they differ from
    the adaptive windows of the batch operator, which start at a run's first
    sample and include both ends.
    """
    width, each = (pd.Timedelta(x) // pd.Timedelta(microseconds=1) for x in (window, step))
    count = max(1, 2 * width // each)
    length = max(count * each, (count - 1) * each + width)
    rows = samples.withColumn("ts", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark("ts", delay)
    # a sample is kept in the one or two stretches it lies in, and not in every window; windows are cut and judged when a stretch leaves
    rows = rows.select("run_id", "gpu_uuid", "ts", F.col(metric).cast("double").alias("v"), F.window("ts", f"{length} microseconds", f"{count * each} microseconds").alias("w"))
    at = (F.unix_micros("ts") - F.unix_micros("w.start")).cast("int" if length < 1 << 31 else "long")
    out = rows.groupBy("run_id", "gpu_uuid", "w").agg(
        F.collect_list(F.when(F.col("v").isNull(), -1 - at).otherwise(at)).alias("at"), F.collect_list(F.coalesce("v", F.lit(0.0))).alias("values"))
    return list_windows6(out.select("run_id", "gpu_uuid", F.unix_micros("w.start").alias("start_us"), "at", "values"), "m", width, each, count)
