"""Counter windows by one sweep per bucket, and running totals that shuffle their rows once."""

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from launchlake.operators import counters as N
from launchlake.operators import ordered

SECOND = 1_000_000_000


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_many_buckets_and_batches_against_a_scan(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_WINDOWS", 1)
    rnd = random.Random(5)
    rows = [(run, "g", 7, t * SECOND // 4, None if rnd.random() < 0.2 else rnd.random() * 100)
            for run in ("a", "b", None) for t in sorted(rnd.sample(range(2000), 900))]
    frame = spark.createDataFrame(rows, "run_id string, gpu_uuid string, pid long, timestamp_ns long, v double")
    spec = N.Sliding(20, 3, 0.5, 1.0)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = N.sliding_windows(frame, ["run_id", "gpu_uuid"], spec, {"v": F.col("v")}).collect()
        device = frame.select("run_id", "gpu_uuid", "timestamp_ns", *[F.col("v").alias(m) for m in N.DEVICE_METRICS])
        process = frame.withColumns({m: F.col("v") for m in N.PROCESS_METRICS}).drop("v")
        both = N.hybrid_windows(process, device, spec).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for run in ("a", "b", None):
        own = [r for r in rows if r[0] == run]
        first, last, index, k = own[0][3], own[-1][3], 0, 0
        while first + k * 3 * SECOND + 20 * SECOND <= last:
            inside = [r for r in own if 0 <= r[3] - first - k * 3 * SECOND <= 20 * SECOND]
            if len(inside) >= 10:
                v = sorted(r[4] for r in inside if r[4] is not None)
                want[run, index] = (k, len(inside), inside[0][3], inside[-1][3], statistics.fmean(v), statistics.pstdev(v), v[0], v[-1], statistics.median(v), v[-(-len(v) * 95 // 100) - 1])
                index += 1
            k += 1
    stats = ("v_mean", "v_std", "v_min", "v_max", "v_median", "v_p95")
    found = {(r.run_id, r.window_index): (r.k, r.n, r.start_ns, r.end_ns, *(r[s] for s in stats)) for r in got}
    assert len(got) == len(want) and {k: tuple(round(x, 9) for x in v) for k, v in found.items()} == {k: tuple(round(x, 9) for x in v) for k, v in want.items()}
    # every process sample is a device sample here, so both sides of a window agree
    known = [r for r in both if r.run_id is not None]
    assert len(known) == sum(run is not None for run, _ in want)
    assert all(r.sample_count_device == r.sample_count_process == want[r.run_id, r.window_index][1] for r in known)
    assert all(abs(r.device_fan_speed_pct_p95 - r.process_host_ram_gb_p95) < 1e-12 for r in known)


def test_windows_are_not_gathered_and_totals_meet_no_join(spark):
    rows = spark.range(100).select(F.lit(1).alias("run_id"), F.lit("g").alias("gpu_uuid"), (F.col("id") * SECOND).alias("timestamp_ns"), *[F.col("id").cast("double").alias(m) for m in N.DEVICE_METRICS])
    assert "collect_list" not in plan(N.device_windows(rows))
    numbered = ordered.ordinal(rows, ["run_id"], ["timestamp_ns"], [ordered.bucket_of("timestamp_ns", 7 * SECOND)], "at")
    assert "Join" not in plan(numbered) and [r["at"] for r in numbered.orderBy("timestamp_ns").collect()] == list(range(100))


def test_a_line_of_the_process_monitor_is_split_once(spark):
    lines = spark.range(3).select(F.concat(F.col("id").cast("string"), F.lit("  7 C 1 2 3 4 5 6 a  b")).alias("line"))
    parsed = N.parse_process_monitor(lines)
    assert plan(parsed).count("split(") == 1
    assert [(r.gpu_index, r.pid, r.process_name) for r in parsed.orderBy("gpu_index").collect()] == [(i, 7, "a b") for i in range(3)]


def test_stream_windows_keep_a_sample_in_two_stretches_at_most(spark):
    """Batch use of the stream operator: every window of the grid, with nulls counted but not summed; a sample is not kept once per window."""
    from launchlake.streaming.stateless import stream_counter_windows
    rnd = np.random.default_rng(5)
    samples = [(run, "g", int(t), None if rnd.random() < 0.2 else float(v)) for run in (1, 2)
               for t, v in zip(rnd.integers(-400, 900, 300) * 1_000_000_000 + rnd.integers(0, 3, 300) * 999_999_000, rnd.integers(0, 50, 300))]
    df = spark.createDataFrame(samples, "run_id long, gpu_uuid string, timestamp_ns long, power double")
    for window, step in ((60, 5), (60, 7), (5, 60)):
        out = stream_counter_windows(df, "power", f"{window} seconds", f"{step} seconds")
        got = {(r.run_id, r.start_ns // 1_000_000_000): r for r in out.collect()}
        want = {}
        for run, _, t, v in samples:
            s = t // 1_000_000_000 // step * step
            while s * 1_000_000 + window * 1_000_000 > t // 1000:
                want.setdefault((run, s), []).append(v)
                s -= step
        assert set(got) == set(want)
        for key, values in want.items():
            real = sorted(v for v in values if v is not None)
            assert got[key].n == len(values)
            assert (got[key].m_min, got[key].m_max) == ((real[0], real[-1]) if real else (None, None))
            assert got[key].m_mean is None if not real else abs(got[key].m_mean - sum(real) / len(real)) < 1e-9
    plan = stream_counter_windows(df, "power")._jdf.queryExecution().optimizedPlan().toString()
    expand = next(line for line in plan.split("\n") if "Expand" in line)
    assert expand.count("named_struct") <= 2


def test_samples_meet_windows_without_their_columns(spark):
    """What is shuffled of a device sample is its own columns and one null, however many statistics a window brings."""
    process = spark.createDataFrame([(1, "g", 7, i * SECOND, float(i), 1.0, None) for i in range(100)],
                                    "run_id long, gpu_uuid string, pid long, timestamp_ns long, process_gpu_utilization_pct double, process_gpu_memory_pct double, host_ram_gb double")
    device = spark.createDataFrame([(1, "g", i * SECOND // 2, *[float(i % k) for k in (3, 5, 7, 11, 13)]) for i in range(260)],
                                   "run_id long, gpu_uuid string, timestamp_ns long, " + ", ".join(f"{m} double" for m in N.DEVICE_METRICS))
    rows = N.hybrid_windows(process, device)
    got = rows.orderBy("window_index").collect()
    assert [(r.window_start_ns, r.sample_count_process, r.sample_count_device, r.process_host_ram_gb_mean) for r in got] == [(5 * k * SECOND, 61, 121, None) for k in range(8)]
    assert all(r.device_temperature_celsius_max == 10 and r.process_gpu_utilization_pct_mean == 5 * r.window_index + 30 for r in got)
    tree = rows._jdf.queryExecution().optimizedPlan().toString()
    union = tree[tree.index("Union"):].split("\n")
    sides = [line for line in union if "Project" in line and "named_struct" in line or "AS sample" in line]
    assert sides and all(line.count("null AS") <= 2 for line in sides)


def test_hybrid_samples_are_put_in_order_once(spark, monkeypatch):
    from launchlake.plans import views
    from launchlake.plans.catalog import QUERIES
    rows = [(1, "gpu0", i, i * SECOND, *[1.0] * 5, 1, 2.0, 3) for i in range(70)]
    frame = spark.createDataFrame(rows, "run_id long, gpu_uuid string, n long, timestamp_ns long, " + ", ".join(f"{m} double" for m in N.DEVICE_METRICS)
                                  + ", l_linenumber long, l_quantity double, l_partkey long")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(views, "device_samples", lambda *_: frame.mapInArrow(counted, frame.schema))
    assert QUERIES["hybrid_interval_join"](spark, "").count() > 0
    assert reads.value == 70
