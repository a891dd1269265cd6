"""Results that must not depend on the order or the files in which rows arrive."""

from pyspark.sql import functions as F

from launchlake.plans import counter_queries, metric_queries, stream_queries, views
from launchlake.plans.catalog import QUERIES
from launchlake.streaming import runner

stage = runner.stage_in_order


def test_spans_are_summed_in_time_order(spark, monkeypatch):
    rows = [(1, 100, 3_000_000_000 + i * 1_000_000_000, v, v, v) for i, v in enumerate((0.1, 0.2, 0.3))]
    frame = spark.createDataFrame(rows[::-1], "run_id long, pid long, timestamp_ns long, process_gpu_utilization_pct double, process_gpu_memory_pct double, host_ram_gb double").coalesce(1)
    monkeypatch.setattr(views, "process_samples", lambda *_: frame)
    got = counter_queries.process_spans(spark, "").first()
    assert got.avg_process_gpu_utilization_pct == got.avg_process_gpu_memory_pct == got.avg_host_ram_gb == (0.1 + 0.2 + 0.3) / 3 != (0.3 + 0.2 + 0.1) / 3
    assert abs(got.std_process_gpu_utilization_pct - 0.0816496580927726) < 1e-15


def test_group_scores_are_summed_in_order_of_examples(spark, monkeypatch):
    frame = spark.createDataFrame([(2, 0, "mining", 0.3), (1, 0, "mining", 0.2), (3, 0, "mining", None), (0, 0, "mining", 0.1)], "workload long, group_id long, binary_label string, score double").coalesce(1)
    monkeypatch.setattr(views, "examples", lambda *_: frame)
    assert metric_queries.runs(spark, "").first().mean_mining_probability == (0.1 + 0.2 + 0.3) / 3


def test_every_micro_batch_has_whole_sessions(spark, monkeypatch):
    staged, steps = [], 4
    monkeypatch.setattr(runner, "stage_in_order", lambda *a: staged.append(stage(*a, steps=steps, rows_per_file=25)) or staged[0])
    stream_queries.event_stream(spark, "/root/testdata/sf0.001")
    rows = views.launch_columns(spark.read.parquet(staged[0]).withColumn("_file", F.input_file_name())).select("session_id", "sequence")
    files = spark.read.parquet(staged[0]).select((F.col("user_id") % 30 % 10).alias("session"), F.input_file_name().alias("file")).distinct().groupBy("session").count().collect()
    assert rows.select("session_id").distinct().count() == len(files) == 10
    assert all(r["count"] <= steps for r in files)


def test_an_append_of_many_files_is_one_micro_batch(spark, monkeypatch):
    """Runs lie in files of their own, so the second file of an append is behind the watermark that the first would set."""
    rows = spark.range(4000).select((F.col("id") % 4).alias("run_id"), F.lit("g").alias("gpu_uuid"), (F.col("id") * 1_000_000_000).alias("timestamp_ns"),
                                    F.col("id").cast("double").alias("power_usage_watts"))
    monkeypatch.setattr(views, "device_samples", lambda *_: rows.repartition(4, "run_id"))
    monkeypatch.setattr(runner.stage_in_order, "__defaults__", (4, 250))  # rows of a file
    got = QUERIES["stream_counter_windows"](spark, "").agg(F.sum("n").alias("n"), F.count_if(F.col("m_max") - F.col("m_min") > 60).alias("wide")).first()
    assert (got.n, got.wide) == (4000 * 12, 0)
