"""Queries over the launch log: shaping, summaries, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlake.functions import scalars
from launchlake.operators import launches as L
from launchlake.operators import windows as W
from launchlake.plans import views
from launchlake.plans.registry import query
from launchlake.plans.views import VIEW_BUDGET, VIEW_THRESHOLD, sql

CONFIG = W.WindowConfig(budget=VIEW_BUDGET, threshold=VIEW_THRESHOLD)
KEYS = ["capture_id", "pid", "device_pci_bus_id", "stream"]


def launch_rows(spark, sf_dir) -> DataFrame:
    return views.launches(spark, sf_dir).where(F.col("type") == "kernel_launch")


def log_rows(spark, sf_dir) -> DataFrame:
    """The event log with the payload of code and stats events filled in."""
    k = F.col("k")
    return views.launches(spark, sf_dir).withColumns({
        "size": F.when(F.col("type") == "code", k * 100),
        "path": F.when(F.col("type") == "code", F.concat(F.lit("code/"), k.cast("string"))),
        "dropped_events": F.when(F.col("type") == "stats", k),
        "queued_events": F.when(F.col("type") == "stats", k % 7),
        "exe_path": F.concat(F.lit("/opt/bin/"), F.col("kernel_name"), F.lit("_"), k.cast("string")),
    })


def numbered_windows(spark, sf_dir) -> DataFrame:
    return W.window_ids(W.token_budget_windows(launch_rows(spark, sf_dir), CONFIG))


def window_members(spark, sf_dir) -> DataFrame:
    return W.window_members(numbered_windows(spark, sf_dir), launch_rows(spark, sf_dir), CONFIG)


def r6(col):
    return F.round(col, 6)


# ---- shaping ---------------------------------------------------------------

@query("launch_projection", sql("""
SELECT capture_id, sequence, timestamp_ns, pid, tid, code_id, kernel_name, grid_key AS grid_dim, block_key AS block_dim,
  k * 16 AS shared_mem_bytes, stream, device AS device_pci_bus_id FROM launch_rows""", "v1", "launch_rows"))
def _(spark, d):
    rows = L.launch_projection(views.launches(spark, d), keep=["capture_id"])
    return rows.withColumns({c: scalars.shape_key(c) for c in ("grid_dim", "block_dim")})


@query("split_by_event_type", sql("""
SELECT capture_id, minute, code_events, launch_events, CASE WHEN code_events = 0 THEN 'no code event'
  WHEN launch_events = 0 THEN 'no kernel_launch event' END AS reject_reason
FROM (SELECT capture_id, timestamp_ns // 3600000000000 AS minute, count(*) FILTER (type = 'code') AS code_events,
        count(*) FILTER (type = 'kernel_launch') AS launch_events FROM v1 GROUP BY ALL)""", "v1"))
def _(spark, d):
    rows = views.launches(spark, d).withColumn("minute", F.floor(F.col("timestamp_ns") / 3_600_000_000_000))
    return L.split_by_event_type(rows, ["capture_id", "minute"])


@query("shape_key", sql("SELECT sequence, grid_key, block_key FROM launch_rows", "v1", "launch_rows"))
def _(spark, d):
    return launch_rows(spark, d).select(
        "sequence", scalars.shape_key("grid_dim").alias("grid_key"), scalars.shape_key("block_dim").alias("block_key"))


@query("launch_readiness", sql("""
SELECT capture_id, pid, device AS device_pci_bus_id, stream, count(l0_kernel_id) AS ready_launches,
  count(*) - count(l0_kernel_id) AS unready_launches FROM launch_rows GROUP BY ALL""", "v1", "launch_rows"))
def _(spark, d):
    return L.readiness_counts(launch_rows(spark, d), KEYS)


@query("json_message_routing", sql("""
, m AS (SELECT sequence, CASE WHEN k % 17 <> 0 THEN session_id END AS session_id,
    CASE k % 8 WHEN 0 THEN 'process_info' WHEN 1 THEN 'code_object' WHEN 2 THEN 'stats' WHEN 3 THEN 'session_end'
      WHEN 4 THEN 'collector_hello' WHEN 5 THEN 'bogus' ELSE 'kernel_launch_batch' END AS type FROM v1)
SELECT sequence, type, session_id,
  CASE WHEN type = 'collector_hello' THEN 'control' WHEN session_id IS NULL OR type = 'bogus' THEN 'error' ELSE type END AS route,
  CASE WHEN type = 'collector_hello' THEN NULL WHEN session_id IS NULL THEN 'missing session_id'
    WHEN type = 'bogus' THEN 'unknown message type: bogus' END AS error FROM m""", "v1"))
def _(spark, d):
    k = F.col("k")
    names = F.array(*[F.lit(x) for x in (
        "process_info", "code_object", "stats", "session_end", "collector_hello", "bogus",
        "kernel_launch_batch", "kernel_launch_batch")])
    raw = views.launches(spark, d).select(F.to_json(F.struct(
        "sequence", names[(k % 8).cast("int")].alias("type"), F.when(k % 17 != 0, F.col("session_id")).alias("session_id")
    )).alias("line"))
    parsed = raw.select(F.from_json("line", "sequence long, type string, session_id string").alias("m")).select("m.*")
    return L.message_routing(parsed)


@query("event_order", sql("""
, e AS (SELECT capture_id, sequence AS line, CASE WHEN k % 13 <> 0 THEN sequence END AS sequence,
    CASE WHEN k % 26 <> 0 THEN timestamp_ns END AS timestamp_ns FROM v1)
SELECT capture_id, line, row_number() OVER (PARTITION BY capture_id ORDER BY
    CASE WHEN sequence IS NOT NULL THEN 0 WHEN timestamp_ns IS NOT NULL THEN 1 ELSE 2 END,
    coalesce(sequence, timestamp_ns, line), line) - 1 AS position FROM e""", "v1"))
def _(spark, d):
    rows = views.launches(spark, d).select(
        "capture_id", F.col("sequence").alias("line"), F.when(F.col("k") % 13 != 0, F.col("sequence")).alias("sequence"),
        F.when(F.col("k") % 26 != 0, F.col("timestamp_ns")).alias("timestamp_ns"))
    return L.event_order(rows, ["capture_id"]).select("capture_id", "line", "position")


@query("limit_launches", sql("""
SELECT capture_id, sequence, rank FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY sequence) AS rank
  FROM launch_rows) WHERE rank <= 16""", "v1", "launch_rows"))
def _(spark, d):
    return L.limit_launches(launch_rows(spark, d), ["capture_id"], 16).select(
        "capture_id", "sequence", F.col("rank").cast("long").alias("rank"))


# ---- summaries -------------------------------------------------------------

@query("scan_process_info", sql("""
SELECT session_id, arg_min(pid, sequence) AS pid,
  split_part('/opt/bin/' || arg_min(kernel_name, sequence) || '_' || arg_min(k, sequence), '/', 4) AS workload
FROM v1 GROUP BY session_id""", "v1"))
def _(spark, d):
    return L.process_info(log_rows(spark, d).select("session_id", "sequence", "pid", "exe_path")).select(
        "session_id", "pid", "workload")


@query("event_type_counts", sql("""
SELECT capture_id, type, count(*) AS n FROM (SELECT capture_id, coalesce(CASE WHEN k % 10 <> 0 THEN type END,
  CASE WHEN k % 20 <> 0 THEN kernel_name END, 'unknown') AS type FROM v1) GROUP BY ALL""", "v1"))
def _(spark, d):
    rows = views.launches(spark, d).select(
        "capture_id", F.when(F.col("k") % 10 != 0, F.col("type")).alias("type"),
        F.when(F.col("k") % 20 != 0, F.col("kernel_name")).alias("event_type"))
    return L.event_type_counts(rows, ["capture_id"])


@query("capture_event_summary", sql("""
, c AS (SELECT capture_id, string_agg(type || '=' || n, ',' ORDER BY type) AS event_type_counts
   FROM (SELECT capture_id, type, count(*) AS n FROM v1 GROUP BY ALL) GROUP BY ALL),
nm AS (SELECT capture_id, string_agg(kernel_name, ',' ORDER BY f) AS sample_kernel_names FROM (
   SELECT capture_id, kernel_name, min(sequence) AS f, row_number() OVER (PARTITION BY capture_id ORDER BY min(sequence)) AS r
   FROM launch_rows GROUP BY capture_id, kernel_name) WHERE r <= 3 GROUP BY capture_id)
SELECT v1.capture_id, count(*) AS event_count, count(*) FILTER (type = 'code') AS code_file_count,
  count(*) FILTER (type = 'kernel_launch') AS launch_count,
  CAST(coalesce(sum(k * 100) FILTER (type = 'code'), 0) AS BIGINT) AS code_total_bytes,
  round((max(timestamp_ns) - min(timestamp_ns)) / 1e9, 6) AS observed_duration_s,
  array_to_string(list_sort(list(DISTINCT device) FILTER (type = 'kernel_launch')), ',') AS devices,
  any_value(c.event_type_counts) AS event_type_counts, any_value(nm.sample_kernel_names) AS sample_kernel_names
FROM v1 JOIN c USING (capture_id) JOIN nm USING (capture_id) GROUP BY v1.capture_id""", "v1", "launch_rows"))
def _(spark, d):
    return L.capture_event_summary(log_rows(spark, d), names=3)


@query("top_kernels", sql("""
, t AS (SELECT capture_id, count(*) AS total_launches, count(*) FILTER (kernel_name <> 'view') AS named_launches,
    greatest((max(timestamp_ns) - min(timestamp_ns)) / 1e9, 1e-9) AS duration_s FROM launch_rows GROUP BY ALL),
k AS (SELECT capture_id, kernel_name, code_id, count(*) AS launch_count, min(sequence) AS first_seen,
    arg_min(grid_key, sequence) AS first_grid_dim, arg_min(block_key, sequence) AS first_block_dim
  FROM launch_rows WHERE kernel_name <> 'view' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY launch_count DESC, first_seen) AS rank FROM k)
SELECT capture_id, kernel_name, code_id, launch_count, first_seen, first_grid_dim, first_block_dim, rank, total_launches,
  named_launches, round(duration_s, 6) AS duration_s, round(launch_count / duration_s, 6) AS launches_per_second
FROM r JOIN t USING (capture_id) WHERE rank <= 3""", "v1", "launch_rows"))
def _(spark, d):
    rows = launch_rows(spark, d).withColumn(
        "kernel_name", F.when(F.col("kernel_name") == "view", F.lit(" ")).otherwise(F.col("kernel_name")))
    top = L.top_kernels(rows, n=3)
    return top.withColumns({"duration_s": r6("duration_s"), "launches_per_second": r6("launches_per_second"),
                            "rank": F.col("rank").cast("long")})


@query("drop_statistics", sql("""
SELECT session_id, arg_max(k, sequence) AS dropped_events, arg_max(k % 7, sequence) AS queued_events, count(*) AS reports
FROM v1 WHERE type = 'stats' GROUP BY ALL""", "v1"))
def _(spark, d):
    return L.drop_statistics(log_rows(spark, d))


@query("capture_gate_short_circuit", sql("""
SELECT capture_id, bucket, max(ratio) AS max_ratio, count(DISTINCT l0_kernel_id) AS unique_kernel_count,
  max(ratio) < 0.65 AS gate_short_circuit
FROM (SELECT *, sequence // 8 AS bucket FROM launch_rows WHERE l0_kernel_id IS NOT NULL) GROUP BY capture_id, bucket""",
    "v1", "launch_rows"))
def _(spark, d):
    rows = launch_rows(spark, d).withColumn("capture", F.struct("capture_id", F.floor(F.col("sequence") / 8).alias("bucket")))
    return L.capture_gate(rows, VIEW_THRESHOLD, "capture").select("capture.*", "max_ratio", "unique_kernel_count", "gate_short_circuit")


@query("normalized_entropy", sql("""
, c AS (SELECT capture_id, pid, device AS device_pci_bus_id, stream, code_id, count(*) AS c FROM launch_rows GROUP BY ALL),
n AS (SELECT *, sum(c) OVER (PARTITION BY capture_id, pid, device_pci_bus_id, stream) AS n FROM c)
SELECT capture_id, pid, device_pci_bus_id, stream, CAST(sum(c) AS BIGINT) AS launch_count, count(*) AS unique_values,
  round(CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-(c / n) * ln(c / n)) / ln(count(*)) END, 6) AS normalized_entropy
FROM n GROUP BY ALL""", "v1", "launch_rows"))
def _(spark, d):
    out = L.normalized_entropy(launch_rows(spark, d), KEYS)
    return out.withColumn("normalized_entropy", r6("normalized_entropy"))


@query("launch_gaps", sql("""
, g AS (SELECT *, lag(timestamp_ns) OVER (PARTITION BY capture_id, pid, device, stream ORDER BY sequence) AS previous_ns
   FROM launch_rows WHERE k % 7 <> 0)
SELECT sequence, previous_ns, round((timestamp_ns - previous_ns) / 1000.0::DOUBLE, 3) AS gap_us FROM g
WHERE timestamp_ns >= previous_ns""", "v1", "launch_rows"))
def _(spark, d):
    rows = launch_rows(spark, d).withColumn("timestamp_ns", F.when(F.col("k") % 7 != 0, F.col("timestamp_ns")))
    return L.launch_gaps(rows, KEYS).select("sequence", "previous_ns", F.round("gap_us", 3).alias("gap_us"))


@query("window_duration", sql("""
, t AS (SELECT *, CASE WHEN k % 7 <> 0 THEN timestamp_ns END AS t, sequence // 40 AS part FROM launch_rows),
g AS (SELECT capture_id, pid, device AS device_pci_bus_id, stream, part, count(*) AS n, arg_min_null(t, sequence) AS a,
   arg_max_null(t, sequence) AS b, max(t) - min(t) AS span FROM t GROUP BY ALL)
SELECT capture_id, pid, device_pci_bus_id, stream, part, n, round(CASE WHEN n < 2 THEN 0 WHEN b >= a THEN b - a
  ELSE coalesce(span, 0) END / 1e6, 6) AS duration_ms FROM g""", "v1", "launch_rows"))
def _(spark, d):
    rows = launch_rows(spark, d).withColumns({
        "timestamp_ns": F.when(F.col("k") % 7 != 0, F.col("timestamp_ns")), "part": F.floor(F.col("sequence") / 40)})
    return L.window_duration(rows, [*KEYS, "part"]).withColumn("duration_ms", r6("duration_ms"))


# ---- windows ---------------------------------------------------------------

WINDOW_SQL = """
SELECT capture_id, window_id, pid, device AS device_pci_bus_id, stream, is_flush = 1 AS is_flush, start_idx,
  CASE WHEN is_flush = 1 THEN end_idx - 1 ELSE end_idx END AS end_idx, token_cost, launch_count, distinct_kernel_count,
  max_ratio, kernel_set, top3 FROM window_named"""


@query("token_budget_windows", sql(WINDOW_SQL, "v1", "launch_rows", "scan", "windows"))
def token_budget_windows(spark, d):
    """Which launch windows first showed a new kernel composition above the gate, per stream."""
    w = numbered_windows(spark, d)
    return w.select(
        "capture_id", "window_id", "pid", "device_pci_bus_id", "stream", "is_flush", "start_idx",
        F.when(F.col("is_flush"), F.col("idx") - 1).otherwise(F.col("idx")).alias("end_idx"),
        F.col("window_cost").alias("token_cost"), "launch_count",
        F.size("kernel_set").cast("long").alias("distinct_kernel_count"), "max_ratio",
        F.array_join("kernel_set", ",").alias("kernel_set"), F.array_join("top3", ",").alias("top3"))


@query("window_ids", sql("""
SELECT capture_id, window_id, window_index, pid, device AS device_pci_bus_id, stream, start_idx FROM window_named""",
    "v1", "launch_rows", "scan", "windows"))
def _(spark, d):
    return numbered_windows(spark, d).select(
        "capture_id", "window_id", "window_index", "pid", "device_pci_bus_id", "stream", "start_idx")


@query("first_signature_only", sql("""
SELECT capture_id, pid, device AS device_pci_bus_id, stream, kernel_set, top3, count(*) AS candidates,
  arg_min(start_idx, end_idx + is_flush) AS first_start FROM passing GROUP BY ALL""", "v1", "launch_rows", "scan", "windows"))
def _(spark, d):
    found = W.candidate_windows(launch_rows(spark, d), CONFIG)
    first = W.first_signature_only(found, KEYS, F.count(F.lit(1)).alias("candidates"))
    return first.select(*KEYS, F.array_join("kernel_set", ",").alias("kernel_set"), F.array_join("top3", ",").alias("top3"), "candidates", F.col("start_idx").alias("first_start"))


@query("composition_signature", sql("""
SELECT capture_id, pid, device AS device_pci_bus_id, stream, end_idx, is_flush = 1 AS is_flush, kernel_set, top3
FROM signed WHERE (is_flush = 1 OR token_cost > 60) AND max_ratio >= 0.65""", "v1", "launch_rows", "scan", "windows"))
def _(spark, d):
    found = W.with_kernel_sets(W.candidate_windows(launch_rows(spark, d), CONFIG), KEYS)
    return found.select(*KEYS, F.col("idx").alias("end_idx"), "is_flush", F.array_join("kernel_set", ",").alias("kernel_set"),
                        F.array_join("top3", ",").alias("top3"))


@query("launch_window_features", sql("""
, codes AS (SELECT capture_id, window_id, code_id, count(*) AS c FROM members GROUP BY ALL),
cs AS (SELECT capture_id, window_id, sum(c) AS n, count(*) AS d, max(c) AS c1,
    list_sum(list_slice(list(c ORDER BY c DESC), 1, 2)) AS c2, list_sum(list_slice(list(c ORDER BY c DESC), 1, 3)) AS c3,
    sum(c * ln(c)) AS clnc FROM codes GROUP BY ALL),
gr AS (SELECT capture_id, window_id, max(c) AS g FROM (SELECT capture_id, window_id, grid_key, count(*) AS c FROM members GROUP BY ALL) GROUP BY ALL),
bl AS (SELECT capture_id, window_id, max(c) AS b FROM (SELECT capture_id, window_id, block_key, count(*) AS c FROM members GROUP BY ALL) GROUP BY ALL),
gaps AS (SELECT capture_id, window_id, avg(gap) AS a, stddev_pop(gap) AS s FROM (
    SELECT capture_id, window_id, (timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY capture_id, window_id ORDER BY pos)) / 1000.0::DOUBLE AS gap
    FROM members) WHERE gap >= 0 GROUP BY ALL),
du AS (SELECT capture_id, window_id, (CASE WHEN arg_max(timestamp_ns, pos) >= arg_min(timestamp_ns, pos)
    THEN arg_max(timestamp_ns, pos) - arg_min(timestamp_ns, pos) ELSE max(timestamp_ns) - min(timestamp_ns) END) / 1e6 AS ms
    FROM members GROUP BY ALL)
SELECT capture_id, window_id, CAST(n AS BIGINT) AS launch_count, round(ms, 4) AS duration_ms, d AS unique_code_id_count,
  round(c1 / n, 6) AS dominant_code_id_ratio, round(c2 / n, 6) AS top2_code_id_ratio, round(c3 / n, 6) AS top3_code_id_ratio,
  round(CASE WHEN d > 1 THEN (ln(n) - clnc / n) / ln(d) ELSE 0 END, 6) AS normalized_entropy,
  round(g / n, 6) AS grid_stability, round(b / n, 6) AS block_stability, round(coalesce(a, 0), 3) AS avg_launch_gap_us,
  round(coalesce(s, 0), 3) AS launch_gap_std, round(CASE WHEN a > 0 THEN s / a ELSE 0 END, 6) AS launch_gap_cv
FROM cs JOIN gr USING (capture_id, window_id) JOIN bl USING (capture_id, window_id) JOIN du USING (capture_id, window_id)
LEFT JOIN gaps USING (capture_id, window_id)""", "v1", "launch_rows", "scan", "windows", "members"))
def _(spark, d):
    out = W.window_features(window_members(spark, d), ["capture_id", "window_id"])
    digits = {"duration_ms": 4, "avg_launch_gap_us": 3, "launch_gap_std": 3}
    return out.withColumns({c: F.round(c, digits.get(c, 6)) for c, t in out.dtypes if t == "double"})


@query("window_accounting", sql("""
, sums AS (SELECT capture_id, window_id, sum(cost) AS total FROM members GROUP BY ALL),
runs AS (SELECT capture_id, window_id, pos, total, sum(cost) OVER (PARTITION BY capture_id, window_id ORDER BY pos) - cost AS before
  FROM members JOIN sums USING (capture_id, window_id)),
un AS (SELECT w.capture_id, w.window_id, count(l.sequence) AS unready FROM window_named w LEFT JOIN launch_rows l
  ON l.capture_id = w.capture_id AND l.pid = w.pid AND l.device = w.device AND l.stream = w.stream
  AND l.l0_kernel_id IS NULL AND (w.is_flush = 1 OR l.sequence < w.trigger_seq) GROUP BY ALL)
SELECT w.capture_id, w.window_id, w.token_cost, w.start_idx AS evicted_launches, unready AS dropped_unready_launches,
  w.distinct_kernel_count, (SELECT count(*) FROM runs r WHERE r.capture_id = w.capture_id AND r.window_id = w.window_id
    AND w.is_flush = 0 AND r.before < r.total - 60) AS post_emit_evicted_launches
FROM window_named w JOIN un USING (capture_id, window_id)""", "v1", "launch_rows", "scan", "windows", "members"))
def _(spark, d):
    w = numbered_windows(spark, d)
    out = W.window_accounting(window_members(spark, d), w, CONFIG, KEYS)
    return out.select("capture_id", "window_id", F.col("window_cost").alias("token_cost"), "evicted_launches",
                      "dropped_unready_launches", "distinct_kernel_count", "post_emit_evicted_launches")


@query("collect_window_rows", sql("""
SELECT capture_id, count(*) AS windows, count(DISTINCT kernel_set) AS kernel_sets, CAST(sum(launch_count) AS BIGINT) AS launches
FROM window_named GROUP BY ALL""", "v1", "launch_rows", "scan", "windows"))
def _(spark, d):
    return numbered_windows(spark, d).groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("windows"), F.count_distinct("kernel_set").alias("kernel_sets"),
        F.sum("launch_count").alias("launches"))


@query("proportional_condense", sql("""
, p AS (SELECT capture_id, pid, device, stream, sequence, code_id, row_number() OVER (PARTITION BY capture_id, pid, device, stream ORDER BY sequence) - 1 AS pos FROM launch_rows),
c AS (SELECT *, sum((pos = 0 OR code_id IS DISTINCT FROM before)::INT) OVER (PARTITION BY capture_id, pid, device, stream ORDER BY pos) AS run FROM (SELECT *, lag(code_id) OVER (PARTITION BY capture_id, pid, device, stream ORDER BY pos) AS before FROM p)),
r AS (SELECT *, sum(len) OVER (PARTITION BY capture_id, pid, device, stream) AS total FROM (SELECT capture_id, pid, device, stream, run, min(pos) AS start, count(*) AS len FROM c GROUP BY ALL)),
e AS (SELECT *, greatest(1, floor(len * 20 / total)) AS fl, len * 20 / total - floor(len * 20 / total) AS fr FROM r),
g AS (SELECT *, sum(fl) OVER (PARTITION BY capture_id, pid, device, stream) AS given, row_number() OVER (PARTITION BY capture_id, pid, device, stream ORDER BY fr DESC, run) = 1 AS top,
  sum(fl - 1) OVER (PARTITION BY capture_id, pid, device, stream ORDER BY fr, run ROWS UNBOUNDED PRECEDING) AS spare FROM e),
a AS (SELECT *, CAST(fl - greatest(0, least(fl - 1, greatest(given - 20, 0) - (spare - (fl - 1)))) + CASE WHEN top THEN greatest(20 - given, 0) ELSE 0 END AS BIGINT) AS alloc FROM g),
k AS (SELECT capture_id, pid, device, stream, sequence, pos, code_id, total, row_number() OVER (PARTITION BY capture_id, pid, device, stream ORDER BY pos) AS nth FROM c JOIN a USING (capture_id, pid, device, stream, run)
  WHERE total <= 20 OR alloc >= len OR CASE WHEN alloc = 1 THEN pos = start ELSE list_contains(list_transform(range(alloc), lambda i: CAST(round_even(i * ((len - 1) / (alloc - 1)), 0) AS BIGINT)), pos - start) END)
SELECT capture_id, pid, device AS device_pci_bus_id, stream, sequence, pos, code_id FROM k WHERE nth <= 20 OR total <= 20""", "v1", "launch_rows"))
def _(spark, d):
    rows = L.event_order(launch_rows(spark, d), KEYS).withColumnRenamed("position", "pos")
    return W.proportional_condense(rows, KEYS, 20).select(*KEYS, "sequence", "pos", "code_id")
