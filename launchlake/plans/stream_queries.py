"""Stream queries, run to the end of the given tables, and file round trips."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlake.operators import dataset as D
from launchlake.operators import ordered
from launchlake.plans import views
from launchlake.plans.counter_queries import rounded
from launchlake.plans.dataset_queries import split_examples
from launchlake.plans.launch_queries import CONFIG, log_rows
from launchlake.plans.metric_queries import TERMINAL, chunks
from launchlake.plans.registry import query
from launchlake.plans.views import sql
from launchlake.session import scratch_dir
from launchlake.sources import files
from launchlake.streaming import runner, stateful, stateless


def event_stream(spark, d) -> DataFrame:
    """The events table as a stream of launch-view rows, in four micro-batches or more."""
    events = views.table(spark, d, "events")
    # dealt by session, the widest key of any stream: files of one append are separate micro-batches
    path = runner.stage_in_order(events, "event_id", [F.col("user_id") % 30 % 10], "event-feed")
    return views.launch_columns(runner.stream_table(spark, path, events.schema, files_per_trigger=1))


WINDOW_SQL = """
SELECT capture_id, pid, device AS device_pci_bus_id, stream, start_idx, end_idx, token_cost, launch_count, kernel_set, top3, max_ratio{} FROM windows WHERE is_flush = 0"""


@query("stream_token_windows", sql(WINDOW_SQL.format(""), "v1", "launch_rows", "scan", "windows"))
def _(spark, d):
    launches = event_stream(spark, d).where(F.col("type") == "kernel_launch")
    return runner.run_append(stateful.stream_token_windows(launches, CONFIG), "token-windows").drop("end_sequence", "dropped_unready_launches")


@query("stream_score_windows", sql(WINDOW_SQL.format(", CASE WHEN launch_count > 6 THEN NULL ELSE max_ratio / launch_count END AS score, launch_count > 6 AS failed, CASE WHEN launch_count > 6 THEN 'ValueError: window too long for the model' END AS error"), "v1", "launch_rows", "scan", "windows"))
def _(spark, d):
    def scorer():
        def model(rows: pd.DataFrame) -> pd.Series:
            if (rows["launch_count"] > 6).any():
                raise ValueError("window too long for the model")
            return rows["max_ratio"] / rows["launch_count"]
        return model

    launches = event_stream(spark, d).where(F.col("type") == "kernel_launch")
    windows = stateful.stream_token_windows(launches, CONFIG)
    return runner.run_append(stateless.score_windows(windows, scorer), "scored-windows").drop("end_sequence", "dropped_unready_launches")


@query("stream_kernel_readiness", sql("""
, c AS (SELECT session_id, code_id, kernel_name, min(sequence) AS s FROM v1 WHERE type = 'code' GROUP BY ALL),
a AS (SELECT session_id, code_id, min(s) AS s FROM c GROUP BY ALL),
r AS (SELECT l.session_id, l.sequence, coalesce(a.s < l.sequence, false) AS ready, coalesce(c.s < l.sequence, false) AS exact FROM launch_rows l
  LEFT JOIN a USING (session_id, code_id) LEFT JOIN c ON c.session_id = l.session_id AND c.code_id = l.code_id AND c.kernel_name = l.kernel_name)
SELECT *, CAST(sum((NOT ready)::INT) OVER (PARTITION BY session_id ORDER BY sequence) AS BIGINT) AS dropped_so_far FROM r""", "v1", "launch_rows"))
def _(spark, d):
    out = runner.run_append(stateful.stream_kernel_readiness(event_stream(spark, d)), "readiness")
    names = views.launches(spark, d).select("sequence", "kernel_name")
    return out.join(names, "sequence").select("session_id", "sequence", "ready", F.coalesce(F.col("artifact") == F.col("kernel_name"), F.lit(False)).alias("exact"), "dropped_so_far")


@query("stream_session_lifecycle", sql("""
, e AS (SELECT session_id, sequence, CASE WHEN type = 'stats' AND k % 20 = 0 THEN 'session_end' ELSE type END AS type FROM v1),
f AS (SELECT session_id, min(sequence) AS s FROM e WHERE type = 'session_end' GROUP BY ALL)
SELECT session_id, sequence, type, s IS NULL OR sequence <= s AS accepted FROM e LEFT JOIN f USING (session_id)""", "v1"))
def _(spark, d):
    kind = F.when((F.col("type") == "stats") & (F.col("k") % 20 == 0), "session_end").otherwise(F.col("type"))
    return runner.run_append(stateful.stream_session_lifecycle(event_stream(spark, d).withColumn("type", kind)), "sessions")


@query("stream_rolling_policy", sql(TERMINAL.format("").replace("nth, ", "observed, round(mean, 6) AS rolling_mean, ", 1), "v6", "roll"))
def _(spark, d):
    rows = chunks(spark, d, 2).select("session_id", "vec_id", F.when(F.col("vec_id") % 6 != 5, F.col("probabilities")[1]).alias("score"))
    indexed = ordered.ordinal(rows, ["session_id"], ["vec_id"], [ordered.bucket_of("vec_id")], "window_index")
    # several files, one per micro-batch, so windows arrive out of order
    path = runner.stage(indexed.select("session_id", "window_index", "score"), "policy-input", files=4)
    schema = "session_id long, window_index long, score double"
    verdicts = runner.run_append(stateful.stream_rolling_policy(runner.stream_table(spark, path, schema, files_per_trigger=1)), "verdicts")
    return rounded(verdicts.join(indexed.select("session_id", "window_index", "vec_id"), ["session_id", "window_index"]).select(
        "session_id", "vec_id", "observed", "rolling_mean", "suspicious", "action"))


@query("stream_drop_stats", sql("""
SELECT session_id, arg_max(k, sequence) FILTER (type = 'stats') AS dropped_events, arg_max(k % 7, sequence) FILTER (type = 'stats') AS queued_events,
  count(*) FILTER (type = 'kernel_launch' AND l0_kernel_id IS NULL) AS unready_launches FROM v1 GROUP BY ALL""", "v1"))
def _(spark, d):
    rows = event_stream(spark, d).withColumns({"dropped_events": F.col("k"), "queued_events": F.col("k") % 7})
    return runner.run_update(stateless.stream_drop_stats(rows), "drop-stats", ["session_id"])


@query("stream_counter_windows", sql("""
, w AS (SELECT run_id, gpu_uuid, power_usage_watts AS v, unnest(range(12)) AS i, timestamp_ns FROM v4),
s AS (SELECT *, (timestamp_ns // 5000000000 - i) * 5000000000 AS start_ns FROM w)
SELECT run_id, gpu_uuid, start_ns, count(*) AS n, round(avg(v), 6) AS m_mean, round(stddev_pop(v), 6) AS m_std, min(v) AS m_min, max(v) AS m_max, round(median(v), 6) AS m_median, quantile_disc(v, 0.95) AS m_p95
FROM s GROUP BY run_id, gpu_uuid, start_ns""", "v4"))
def _(spark, d):
    samples = views.device_samples(spark, d).select("run_id", "gpu_uuid", "timestamp_ns", "power_usage_watts")
    windows = lambda stream: stateless.stream_counter_windows(stream, "power_usage_watts")
    return rounded(runner.run_by_steps(samples, "timestamp_ns", "counter-windows", windows, 600_000_000_000))


@query("stream_events_source", sql("SELECT session_id, sequence, timestamp_ns, kernel_name, code_id, grid_key AS grid_dim FROM launch_rows", "v1", "launch_rows"))
def _(spark, d):
    rows = views.launches(spark, d).where(F.col("type") == "kernel_launch")
    fields = [F.col(f) for f in ("sequence", "timestamp_ns", "pid", "tid", "code_id", "kernel_name", "grid_dim", "block_dim", "shared_mem_bytes", "stream", "device_pci_bus_id")]
    # batches of at most 128 launches of one session
    batches = rows.groupBy("session_id", ordered.bucket_of("sequence", 128).alias("b")).agg(F.collect_list(F.struct(*fields)).alias("launches"))
    out = scratch_dir(spark, "messages")
    batches.select(F.lit("kernel_launch_batch").alias("type"), "session_id", "launches").write.json(out)
    got = runner.run_append(files.stream_messages(spark, out), "feed")
    return got.select("session_id", "sequence", "timestamp_ns", "kernel_name", "code_id", F.array_join(F.col("grid_dim").cast("array<string>"), "x").alias("grid_dim"))


# ---- file round trips ------------------------------------------------------

@query("scan_capture_events", sql("SELECT capture_id, session_id, sequence, type, timestamp_ns, kernel_name, code_id, CASE WHEN type = 'code' THEN k * 100 END AS size FROM v1", "v1"))
def _(spark, d):
    out = scratch_dir(spark, "events")
    log_rows(spark, d).drop("k", "value").write.partitionBy("capture_id").json(out)
    rows = files.read_events(spark, out)
    return rows.select("capture_id", "session_id", "sequence", "type", "timestamp_ns", "kernel_name", "code_id", "size")


@query("scan_metric_jsonl", sql("SELECT run_id, timestamp_ns, gpu_utilization_pct, fan_speed_pct FROM v4", "v4"))
def _(spark, d):
    out = scratch_dir(spark, "metrics")
    rows = views.device_samples(spark, d).select("run_id", "timestamp_ns", "gpu_utilization_pct", "fan_speed_pct")
    # Rebalancing brings a run's rows together and splits large runs, so there are few files.
    rows.hint("rebalance", "run_id").write.partitionBy("run_id").json(out)
    got = files.read_metric_logs(spark, out, "*.json", "timestamp_ns long, gpu_utilization_pct double, fan_speed_pct double")
    return got.select(F.regexp_extract("run_folder", r"run_id=(\d+)", 1).cast("long").alias("run_id"), "timestamp_ns", "gpu_utilization_pct", "fan_speed_pct")


@query("scan_feature_csv", sql("SELECT run_id, timestamp_ns, gpu_utilization_pct, CASE WHEN l_linenumber <> 3 THEN temperature_celsius END AS temperature_celsius, fan_speed_pct FROM v4", "v4"))
def _(spark, d):
    from launchlake.plans.counter_queries import text_rows

    out = scratch_dir(spark, "features")
    rows = text_rows(spark, d).drop("power_usage_watts")
    files.write_feature_csv([rows.where(F.col("fan_speed_pct").isNotNull()), rows.where(F.col("fan_speed_pct").isNull()).drop("fan_speed_pct")], out)
    numeric = ["run_id", "timestamp_ns", "gpu_utilization_pct", "temperature_celsius", "fan_speed_pct"]
    got = files.read_feature_csv(spark, out, numeric[2:])
    return got.select(*[F.col(c).cast("long").alias(c) for c in numeric[:2]], *numeric[2:])


@query("sink_examples", sql("SELECT workload, label, split FROM sp UNION ALL SELECT -1, split, split FROM sp GROUP BY split", "v5", "split"))
def _(spark, d):
    out = scratch_dir(spark, "examples")
    rows = split_examples(spark, d).select("workload", "label", "split")
    marks = rows.groupBy("split").agg(F.lit(-1).cast("long").alias("workload"), F.first("split").alias("label"))
    both = rows.unionByName(marks.select("workload", "label", "split"))
    files.write_examples(both, out)
    files.write_examples(both, out)  # a repeated write changes nothing
    files.write_report(D.split_summary(split_examples(spark, d), ["label"]), out + "-report")
    return spark.read.schema("workload long, label string, split string").json(out)
