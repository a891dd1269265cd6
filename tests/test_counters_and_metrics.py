"""Counter windows, parsers, pooling, policies, splits and file readers."""

import random

import pytest
from pyspark.sql import functions as F

from launchlake.functions import scalars as S
from launchlake.operators import counters as N
from launchlake.operators import dataset as D
from launchlake.operators import metrics as M
from launchlake.sources import files

SECOND = 1_000_000_000


def test_five_samples_give_one_adaptive_window(spark):
    rows = [("r", "g", i * SECOND, 50.0, 1.0, 2.0, 3.0, None) for i in range(5)]
    df = spark.createDataFrame(rows, "run_id string, gpu_uuid string, timestamp_ns long, " + ", ".join(f"{m} double" for m in N.DEVICE_METRICS))
    out = N.device_windows(df).collect()
    assert len(out) == 1 and out[0].n == 5 and out[0].fan_speed_pct_mean is None and N.device_points(df).count() == 5


@pytest.mark.parametrize("seed", range(3))
def test_sliding_windows_against_a_scan(spark, seed):
    rnd = random.Random(seed)
    ts = sorted({rnd.randrange(0, 200) * SECOND // 2 for _ in range(80)})
    df = spark.createDataFrame([("r", "g", t) for t in ts], "run_id string, gpu_uuid string, timestamp_ns long")
    spec = N.Sliding(20, 3, 0.5, 1.0)
    got = [(r.start_ns, r.end_ns, r.n) for r in N.sliding_windows(df, ["run_id", "gpu_uuid"], spec).orderBy("window_index").collect()]
    want, start = [], ts[0]
    while start + 20 * SECOND <= ts[-1]:
        inside = [t for t in ts if start <= t <= start + 20 * SECOND]
        if len(inside) >= 10:
            want.append((inside[0], inside[-1], len(inside)))
        start += 3 * SECOND
    assert got == want


def test_nearest_rank_and_cells(spark):
    from launchlake.functions.stats import stats6

    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    r = df.agg(*stats6("v", "v")).first()
    assert (r.v_median, r.v_p95, r.v_min, r.v_max) == (5.5, 10.0, 1.0, 10.0)
    cells = spark.createDataFrame([("12 %",), ("[N/A]",), ("7 MiB",), ("x",), ("-",)], "c string")
    assert [x.n for x in cells.select(S.counter_number("c").alias("n")).collect()] == [12.0, None, 7.0, None, None]


def test_decision_tree(spark):
    rows = [("exact", 95.0, 95.0, 4.0, 1.5), ("exact", 80.0, 95.0, 4.0, 1.5), ("exact", 95.0, None, 4.0, 1.5), ("insufficient_process_util", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, u double, m double, r double, d double")
    got = [x.v for x in df.select(S.process_verdict(F.col("s"), F.col("u"), F.col("m"), F.col("r"), F.col("d")).alias("v")).collect()]
    assert got == ["suspicious_mining", "benign", "insufficient_metrics", "insufficient_process_util"]


def test_pooling_and_rules(spark):
    rows = [("a", [0.95, 0.05]), ("a", [0.95, 0.05]), ("a", [0.05, 0.95]), ("b", [0.43, 0.57]), ("c", [0.62, 0.38])]
    pooled = M.pool_chunks(spark.createDataFrame(rows, "workload string, probabilities array<double>"))
    got = {r.workload: (r.suspicious, r.suspicious_reason) for r in M.suspicious_rule(pooled, 1).collect()}
    assert got == {"a": (True, "max_p_mining>=0.9"), "b": (True, "mean_pooling_decision"), "c": (False, "below_threshold")}


def test_rolling_policy_and_release(spark):
    rows = [(1, i, s) for i, s in enumerate([0.4, 0.4, 0.4])] + [(2, i, s) for i, s in enumerate([0.2, 0.2, 0.5, 0.9])] + [(3, i, s) for i, s in enumerate([0.1] * 10 + [None, 0.9])]
    df = spark.createDataFrame(rows, "s long, i long, score double")
    rolled = M.rolling_policy(df, "s", "i", width=3)
    assert [r.suspicious for r in rolled.where("s = 1").collect()] == [False] * 3
    assert [r.nth for r in M.terminal_verdicts(rolled, "s").where("s = 2").orderBy("nth").collect()] == [0, 1, 2]
    last = rolled.where("s = 3").orderBy(F.desc("nth")).first()
    assert last.observed == 8 and abs(last.rolling_mean - (0.1 * 7 + 0.9) / 8) < 1e-12


def test_class_weights_count_groups(spark):
    rows = [(f"g{label}{i}", label) for label in range(4) for i in range(label + 1) for _ in range(3)]
    got = D.class_weights(spark.createDataFrame(rows, "group_id string, label_id long"), 4).orderBy("label_id").collect()
    assert [round(r.weight, 6) for r in got] == [2.5, 1.25, round(10 / 12, 6), 0.625]


@pytest.mark.parametrize("n,want", [(1, (1, 0, 0)), (2, (2, 0, 0)), (3, (1, 1, 1)), (10, (7, 2, 1)), (100, (70, 15, 15))])
def test_split_counts(spark, n, want):
    r = D.split_counts(spark.createDataFrame([(n,)], "n long")).first()
    assert sum((r.n_train, r.n_val, r.n_test)) == n and (r.n_train, r.n_val, r.n_test) == want


def test_mixed_group_is_an_error(spark):
    df = spark.createDataFrame([("w1", "g", "a"), ("w2", "g", "b")], "workload string, group_id string, label string")
    with pytest.raises(Exception, match="several labels"):
        D.grouped_stratified_split(df).collect()


def test_alarm_falls_back_to_the_fewest_false_alarms(spark):
    runs = spark.createDataFrame([("benign", 0.99), ("mining", 0.2)], "binary_label string, mean_mining_probability double")
    best = M.tune_alarm(runs, 0.0).first()
    # the benign run fires at every threshold; of those the highest that also catches the mining run is best
    assert (best.fpr, best.threshold, best.selection_metric) == (1.0, 0.2, "fallback_lowest_fpr_then_balanced_accuracy")
    good = M.tune_alarm(spark.createDataFrame([("benign", 0.1), ("mining", 0.9)], runs.schema), 0.01).first()
    assert (good.threshold, good.balanced_accuracy) == (0.9, 1.0)


def test_a_bad_line_is_named_by_its_number_in_a_split_file(spark, tmp_path):
    """Two files cut into many ranges, blank lines among them; the bad line stands in a later range of the second."""
    lines = ['{"type":"code","sequence":%d}' % i if i % 7 else "" for i in range(1, 400)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    lines[300] = "{bad"
    (tmp_path / "b.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    try:
        rows = files.read_events(spark, str(tmp_path), strict=False)
        assert rows.rdd.getNumPartitions() > 4
        got = {(r._file[-7:], r._line): (r.sequence, r._bad) for r in rows.collect()}
        assert got.pop(("b.jsonl", 301)) == (None, "{bad")
        assert got == {(f, i): (i, None) for f in ("a.jsonl", "b.jsonl") for i in range(1, 400) if i % 7 and (f, i) != ("b.jsonl", 301)}
        with pytest.raises(Exception, match=r"b\.jsonl:301: invalid JSON: \{bad"):
            files.read_events(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_strict_and_lenient_event_reads(spark, tmp_path):
    (tmp_path / "events.jsonl").write_text('{"type":"code","sequence":1}\n\n{bad\n')
    rows = files.read_events(spark, str(tmp_path), strict=False).select("sequence", "_bad").collect()
    assert [(r.sequence, r._bad is None) for r in rows] == [(1, True), (None, False)]
    with pytest.raises(Exception, match="invalid JSON"):
        files.read_events(spark, str(tmp_path)).select("sequence", "_file").collect()


def test_class_weights_leave_out_placeholders_and_refuse_conflicts(spark):
    schema = "group_id string, label_id long, no_window boolean"
    rows = [("a", 0, False), ("a", 0, None), ("b", 1, False), ("c", 1, False), ("a", 1, True), ("d", 0, True)]
    got = {r.label_id: (r.groups, r.weight) for r in D.class_weights(spark.createDataFrame(rows, schema), 2).collect()}
    assert got == {0: (1, 1.5), 1: (2, 0.75)}
    mixed = spark.createDataFrame([*rows, ("b", 0, False)], schema)
    with pytest.raises(Exception, match="conflicting labels for group b"):
        D.class_weights(mixed, 2).collect()
    assert sum(r.conflicts for r in D.class_weights(mixed, 2, strict=False).collect()) == 1
    with pytest.raises(Exception, match="no group has label 2"):
        D.class_weights(spark.createDataFrame(rows, schema), 3).collect()


def test_a_window_without_any_listing_is_kept_as_failed(spark):
    from launchlake.operators import render

    members = spark.createDataFrame([("w1", 0, "k1"), ("w1", 1, "gone"), ("w2", 0, "gone"), ("w2", 1, None)], "w string, pos int, kernel_id string")
    kernels = spark.createDataFrame([("k1", 7)], "kernel string, kernel_id long")
    lines = spark.createDataFrame([(7, 0, "MOV REG, REG", 4)], "kernel_id long, idx int, line string, cost long")
    got = {r.w: r for r in render.render_windows(members, kernels, lines, ["w"], 60).collect()}
    assert (got["w1"].failed, got["w1"].missing_kernels, got["w1"].token_cost) == (False, ["gone"], 5)
    assert (got["w2"].failed, got["w2"].missing_kernels, got["w2"].text, got["w2"].missing_launches) == (True, ["gone", "unnamed"], None, 2)
