"""Token-budget windows against a plain queue, and the small window rules."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from launchlake.operators import launches as L
from launchlake.operators import ordered
from launchlake.operators import windows as W

COLUMNS = ("capture_id string, sequence long, timestamp_ns long, pid long, device_pci_bus_id string, stream long, code_id long, "
           "kernel_name string, grid_dim array<int>, block_dim array<int>, l0_kernel_id string, l0_token_cost long, l0_bitwise_integer_ratio double")


def launch(seq, code=0, cost=4, ratio=0.8, stream=0, grid=1, ready=True):
    return ("c", seq, seq * 1_000_000, 1, "d", stream, code, f"k{code}", [grid, 1, 1], [128, 1, 1],
            f"{code}:k{code}" if ready else None, cost, ratio)


def simulate(rows, config):
    """The rule stated as a queue per stream."""
    state, out = {}, []
    rows = sorted(rows, key=lambda r: r[1])

    def candidate(s, queue, flush, end):
        latest = {}
        for _, kernel, _, ratio in queue:
            latest[kernel] = ratio
        if not queue or (config.use_gate and max(latest.values()) < config.threshold):
            return
        counts = Counter(k for _, k, _, _ in queue)
        top = tuple(sorted(counts, key=lambda k: (-counts[k], k))[:3])
        signature = (tuple(sorted(counts)), top)
        if signature in s["seen"]:
            return
        s["seen"].add(signature)
        out.append((queue[0][0], queue[-1][0], sum(q[2] for q in queue), flush, signature))

    for r in rows:
        s = state.setdefault(r[5], {"queue": deque(), "seen": set()})
        if r[10] is None:
            continue
        s["queue"].append((r[1], r[10], r[11], r[12]))
        if sum(q[2] for q in s["queue"]) > config.budget:
            candidate(s, s["queue"], False, r[1])
            while s["queue"] and sum(q[2] for q in s["queue"]) > config.budget:
                s["queue"].popleft()
    for s in state.values():
        candidate(s, s["queue"], True, None)
    return out


def run(spark, rows, config):
    df = spark.createDataFrame(rows, COLUMNS)
    windows = W.window_ids(W.token_budget_windows(df, config), width=7)
    members = W.window_members(windows, df, config, width=3)
    spans = members.groupBy("window_id").agg(F.min("sequence").alias("a"), F.max("sequence").alias("b"))
    got = windows.join(spans, "window_id").orderBy("window_index").collect()
    return [(r.a, r.b, r.window_cost, r.is_flush, (tuple(r.kernel_set), tuple(r.top3))) for r in got]


@pytest.mark.parametrize("seed", range(4))
def test_matches_queue_simulation_across_buckets(spark, seed):
    rnd = random.Random(seed)
    # one stream holds most launches; ratios change over time; some cost more than the budget
    rows = [launch(i * 3, rnd.randrange(4), rnd.choice([1, 2, 5, 9, 40]), rnd.random(), rnd.choice([0, 0, 0, 1]), ready=rnd.random() > 0.1)
            for i in range(150)]
    rnd.shuffle(rows)
    config = W.WindowConfig(budget=20, threshold=0.7, scan_width=16, budgets_per_bucket=1)
    assert run(spark, rows, config) == simulate(rows, config)


def test_physical_knobs_do_not_change_the_result(spark):
    rows = [launch(i, i % 5, 1 + i % 7, (i % 9) / 9) for i in range(120)]
    a = run(spark, rows, W.WindowConfig(budget=25, threshold=0.6, scan_width=8, budgets_per_bucket=2))
    b = run(spark, rows, W.WindowConfig(budget=25, threshold=0.6))
    assert a == b


def test_gate_is_inclusive_and_signature_is_emitted_once(spark):
    rows = [launch(0, 0, 6, 0.69), launch(1, 0, 6, 0.70), launch(2, 0, 6, 0.70)]
    config = W.WindowConfig(budget=10, threshold=0.70, flush=False)
    assert len(run(spark, rows, config)) == 1


def test_window_holds_the_overflow_and_is_costed_before_eviction(spark):
    config = W.WindowConfig(budget=10, flush=False)
    rows = [launch(0, 0, 6), launch(1, 1, 6)]
    assert run(spark, rows, config)[0][:3] == (0, 1, 12)
    df = spark.createDataFrame(rows, COLUMNS)
    windows = W.window_ids(W.token_budget_windows(df, config))
    members = W.window_members(windows, df, config)
    row = W.window_accounting(members, windows, config, config.keys()).first()
    assert (row.post_emit_evicted_launches, row.evicted_launches) == (1, 0)


def test_top3_order_and_gate_off(spark):
    rows = [launch(i, c) for i, c in enumerate([2, 1, 1, 0, 0])]
    assert run(spark, rows, W.WindowConfig(budget=100))[-1][4][1] == ("0:k0", "1:k1", "2:k2")
    low = [launch(0, 0, 4, 0.2)]
    assert run(spark, low, W.WindowConfig(budget=100)) == []
    assert len(run(spark, low, W.WindowConfig(budget=100, use_gate=False))) == 1


def test_features_capture_repetition(spark):
    rows = [launch(i, c, grid=g) for i, (c, g) in enumerate([(0, 1), (0, 1), (1, 2), (0, 1)])]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("pos", F.col("sequence"))
    f = W.window_features(df, ["capture_id"]).first()
    assert (f.launch_count, f.unique_code_id_count, f.dominant_code_id_ratio, f.grid_stability, f.block_stability) == (4, 2, 0.75, 0.75, 1.0)


def test_proportional_condense(spark):
    rows = [launch(i, 0 if i < 12 else 1) for i in range(18)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("pos", F.col("sequence"))
    got = [r.code_id for r in W.proportional_condense(df, ["capture_id"], 6).orderBy("pos").collect()]
    assert got == [0, 0, 0, 0, 1, 1]


def test_event_order_tiers(spark):
    df = spark.createDataFrame([("c", 3, None, 1), ("c", 1, None, 2), ("c", None, 2, 3)], "capture_id string, sequence long, timestamp_ns long, line long")
    rows = L.event_order(df, ["capture_id"], width=2).orderBy("position").collect()
    assert [r.line for r in rows] == [2, 1, 3]


def test_bucketed_scans_equal_plain_windows(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot", "hot", "cold", None]), i, rnd.randrange(10)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, at long, v long")
    out = ordered.running_totals(df, ["g"], ["at"], [ordered.bucket_of("at", 7)], {"s": F.col("v")})
    out = ordered.previous(out, ["g"], ["at"], [ordered.bucket_of("at", 11)], {"before": "v"})
    last, total = {}, Counter()
    want = {}
    for g, at, v in rows:
        total[g] += v
        want[at] = (total[g], last.get(g))
        last[g] = v
    assert {r["at"]: (r.s, r.before) for r in out.collect()} == want


def test_exact_median_of_groups(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 9)] + [("b", 2.0)] + [("c", 1.0), ("c", 4.0), ("c", 100.0)]
    got = ordered.quantile_by_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", bins=3).collect()
    assert {r.g: r["median"] for r in got} == {"a": 3.0, "b": 2.0, "c": 4.0}
