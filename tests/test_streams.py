"""Streams: late rows, bounded and expiring state, observed totals, sinks that survive a restart."""

import pytest
from pyspark.sql import functions as F

from launchlake.session import scratch_dir
from launchlake.streaming import runner, stateful, stateless

SECOND = 1_000_000_000


def feed(spark, batches, schema, name):
    """One file per batch, in order."""
    path = scratch_dir(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return runner.stream_table(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)


def started(stream, out, mode="append"):
    query = runner.write_batches(stream, out, mode)
    query.awaitTermination()
    return query


def state_rows(query):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]


def test_late_rows_are_dropped_and_state_stays_bounded(spark):
    schema = "run_id string, gpu_uuid string, timestamp_ns long, power double"
    at = lambda *seconds: [("r", "g", s * SECOND, float(s)) for s in seconds]
    # the watermark of one batch holds for late rows from the batch after the next
    batches = [at(0, 7), at(300), at(301), at(12, 290), *[at(*range(300 + 60 * i, 360 + 60 * i, 5)) for i in range(10)], at(5000), at(5000)]
    out = scratch_dir(spark, "late")
    query = started(stateless.stream_counter_windows(feed(spark, batches, schema, "late-feed"), "power"), out)
    rows = {r.start_ns // SECOND: r for r in runner.read_batches(spark, out, spark.createDataFrame([], "run_id string, gpu_uuid string, start_ns long, n long").schema).collect()}
    assert rows[0].n == 2 and rows[-55].n == 1
    assert all(not s <= 12 < s + 60 or rows[s].n == len([t for t in (0, 7) if s <= t < s + 60]) for s in rows)  # 12 came too late
    assert rows[285].n == len([t for t in (290, 300, 301, *range(300, 345, 5)) if 285 <= t < 345])  # 290 did not
    assert max(state_rows(query)[:12]) <= 45  # windows of about a hundred seconds, however long the stream is


@pytest.mark.parametrize("kind", ["lifecycle", "readiness", "policy"])
def test_ended_and_silent_sessions_leave_no_state(spark, kind):
    """Session 1 ends, 2 falls silent, 3 comes later; a far later message moves the watermark over all of them."""
    if kind == "policy":
        schema, make = "session_id long, window_index long, score double, t long", stateful.stream_rolling_policy
        end, last = [(1, None, None, 20), (1, 1, 0.9, 21)], [(4, 7, 0.1, 90_000)]
        batches = [[(1, 0, 0.1, 1), (1, 5, 0.2, 2), (2, 0, 0.3, 3)], end, [(1, 2, 0.9, 22), (3, 0, 0.5, 23)], last, [(5, 7, 0.1, 90_001)], [(6, 7, 0.1, 90_002)]]
    else:
        schema = "session_id string, type string, sequence long, code_id long, kernel_name string, t long"
        make = stateful.stream_session_lifecycle if kind == "lifecycle" else stateful.stream_kernel_readiness
        batches = [[(1, "code", 1, 7, "k", 1), (1, "kernel_launch", 2, 7, "k", 2), (2, "code", 1, 7, "k", 3)], [(1, "session_end", 3, None, None, 20), (1, "kernel_launch", 4, 7, "k", 21)],
                   [(1, "kernel_launch", 5, 7, "k", 22), (3, "kernel_launch", 1, 7, "k", 23)], [(4, "session_end", 1, None, None, 90_000)], [(5, "session_end", 1, None, None, 90_001)],
                   [(6, "session_end", 1, None, None, 90_002)]]
    key = int if kind == "policy" else str
    timed = [[(key(r[0]), *r[1:-1], r[-1] * SECOND) for r in b] for b in batches]
    out = scratch_dir(spark, f"end-{kind}")
    stream = make(feed(spark, timed, schema, f"end-feed-{kind}"), time="t", idle_ms=3_600_000, delay="1 minute")
    query = started(stream, out)
    rows = [r for r in runner.read_batches(spark, out, stream.schema).collect() if int(r.session_id) < 4]
    if kind == "lifecycle":
        assert {(int(r.session_id), r.sequence): r.accepted for r in rows} == {(2, 1): True, (3, 1): True} | {(1, s): s <= 3 for s in range(1, 6)}
    elif kind == "readiness":
        assert sorted((int(r.session_id), r.sequence, r.ready) for r in rows) == [(1, 2, True), (3, 1, False)]
    else:
        assert sorted((r.session_id, r.window_index) for r in rows) == [(1, 0), (2, 0), (3, 0)]
    one = state_rows(started(make(feed(spark, timed[-1:], schema, f"one-{kind}"), time="t", idle_ms=3_600_000, delay="1 minute"), out + "-one"))[-1]
    assert state_rows(query)[-1] == 3 * one > 0  # sessions 4 to 6 only: of 1, 2 and 3 nothing is left


def test_observed_totals_equal_the_batch(spark):
    schema = "session_id string, type string, sequence long, l0_kernel_id string, dropped_events long, queued_events long"
    rows = [(f"s{i % 3}", "stats" if i % 5 == 0 else "kernel_launch", i, None if i % 4 == 0 else "k", i, i % 7) for i in range(60)]
    listener = runner.ObservedTotals()
    spark.streams.addListener(listener)
    try:
        stream = stateless.stream_drop_stats(feed(spark, [rows[i:i + 15] for i in range(0, 60, 15)], schema, "drop-feed"))
        out = scratch_dir(spark, "drops")
        query = started(stream, out, "update")
        listener.wait_for(query)
    finally:
        spark.streams.removeListener(listener)
    launches = [r for r in rows if r[1] == "kernel_launch"]
    assert listener.totals["drops"] == {"launches": len(launches), "unready_launches": sum(r[3] is None for r in launches), "stats": 12}
    versions = runner.read_batches(spark, out, stream.schema).groupBy("session_id").agg(F.max_by("unready_launches", "batch").alias("n")).collect()
    assert {r.session_id: r.n for r in versions} == {s: sum(r[3] is None for r in launches if r[0] == s) for s in ("s0", "s1", "s2")}


def test_a_sink_that_is_killed_delivers_once(spark, monkeypatch):
    """The second batch is written and then the stream dies before it is committed; the restart writes it again in its place."""
    batches = [[(b, i) for i in range(20)] for b in range(4)]
    stream = feed(spark, batches, "batch_no long, i long", "sink-feed")
    out = scratch_dir(spark, "sink")
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")

    def dies(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 1:
            raise RuntimeError("killed")

    query = stream.writeStream.foreachBatch(dies).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    started(stream, out)
    rows = runner.read_batches(spark, out, stream.schema).collect()
    assert sorted((r.batch_no, r.i) for r in rows) == sorted(x for b in batches for x in b)
