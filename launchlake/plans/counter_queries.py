"""Queries over device and process counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlake.functions import scalars
from launchlake.functions.stats import deviation_in_order, gathered, mean_in_order, stats6
from launchlake.operators import counters as N
from launchlake.operators import ordered
from launchlake.plans import views
from launchlake.plans.registry import query
from launchlake.plans.views import SQL, sql
from launchlake.session import materialize

SPEC = N.Sliding(60, 5, 0.6, 1.0)
# processes are sampled every three seconds
PROCESS_SPEC = N.Sliding(60, 5, 0.6, 3.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def stats_sql(value: str, prefix: str) -> str:
    return (f"round(avg({value}), 6) AS {prefix}_mean, round(stddev_pop({value}), 6) AS {prefix}_std, min({value}) AS {prefix}_min, "
            f"max({value}) AS {prefix}_max, round(median({value}), 6) AS {prefix}_median, quantile_disc({value}, 0.95) AS {prefix}_p95")


def windows_sql(name: str, source: str, keys: str, aggs: str, needed: int = 36, interval: int = 1) -> str:
    on = " AND ".join(f"x.{k} = g.{k}" for k in keys.split(", "))
    xk = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""
{name}_g AS (SELECT {keys}, min(timestamp_ns) AS f, max(timestamp_ns) AS l FROM {source} GROUP BY ALL),
{name}_k AS (SELECT {keys}, f, l, l - f <= 60000000000 AS short,
    unnest(CASE WHEN l - f <= 60000000000 THEN [0] ELSE range((l - f - 60000000000) // 5000000000 + 1) END) AS k FROM {name}_g),
{name}_a AS (SELECT {xk}, g.k, any_value(g.short) AS short, count(*) AS n, min(timestamp_ns) AS start_ns, max(timestamp_ns) AS end_ns,
    any_value(g.l - g.f) AS span{', ' + aggs if aggs else ''}
  FROM {source} x JOIN {name}_k g ON {on} AND (g.short OR x.timestamp_ns BETWEEN g.f + g.k * 5000000000 AND g.f + g.k * 5000000000 + 60000000000) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY k) - 1 AS window_index FROM {name}_a
  WHERE CASE WHEN short THEN n >= 2 OR (span < {interval * 1000000000} AND n >= 1) ELSE n >= {needed} END)"""


SQL["dw"] = windows_sql("dw", "v4", "run_id, gpu_uuid", ", ".join(stats_sql(m, m) for m in N.DEVICE_METRICS))
PROC_AGGS = ("round(avg(process_gpu_utilization_pct), 6) AS avg_process_gpu_utilization_pct, round(stddev_pop(process_gpu_utilization_pct), 6) AS std_process_gpu_utilization_pct, "
             "round(avg(process_gpu_memory_pct), 6) AS avg_process_gpu_memory_pct, round(avg(host_ram_gb), 6) AS avg_host_ram_gb")
SQL["pw"] = windows_sql("pw", "v4b", "run_id, gpu_uuid, pid", PROC_AGGS, 12, 3)
SQL["hw"] = windows_sql("hw", "v4b", "run_id, gpu_uuid, pid", ", ".join(stats_sql(m, m if m.startswith("process_") else "process_" + m) for m in N.PROCESS_METRICS), 12, 3)


@query("device_points", sql("""
SELECT run_id, gpu_uuid, row_number() OVER (PARTITION BY run_id, gpu_uuid ORDER BY timestamp_ns) - 1 AS sample_index, timestamp_ns,
  gpu_utilization_pct, round(memory_utilization_pct, 6) AS memory_utilization_pct, power_usage_watts, temperature_celsius, fan_speed_pct FROM v4""", "v4"))
def _(spark, d):
    return rounded(N.device_points(views.device_samples(spark, d)))


@query("adaptive_sliding_windows", sql("SELECT run_id, gpu_uuid, window_index, k, n, start_ns, end_ns FROM dw", "v4", "dw"))
def _(spark, d):
    out = N.sliding_windows(views.device_samples(spark, d), ["run_id", "gpu_uuid"], SPEC)
    return out.select("run_id", "gpu_uuid", "window_index", "k", "n", "start_ns", "end_ns")


_names = [f"{m}_{s}" for m in N.DEVICE_METRICS for s in ("mean", "std", "min", "max", "median", "p95")]


@query("device_windows", sql(f"SELECT run_id, gpu_uuid, window_index, n, {', '.join(f'round({c}, 6) AS {c}' for c in _names)} FROM dw", "v4", "dw"))
def device_windows(spark, d):
    return rounded(N.device_windows(views.device_samples(spark, d), SPEC).select("run_id", "gpu_uuid", "window_index", "n", *_names))


@query("window_stats6", sql(f"""
SELECT run_id, l_linenumber, {', '.join(f'round({c}, 6) AS {c}' for c in _names)} FROM (SELECT run_id, CAST(l_linenumber AS BIGINT) AS l_linenumber,
{', '.join(stats_sql(m, m) for m in N.DEVICE_METRICS)} FROM v4 GROUP BY ALL)""", "v4"))
def _(spark, d):
    rows = views.device_samples(spark, d).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return rounded(rows.groupBy("run_id", "l_linenumber").agg(*[a for m in N.DEVICE_METRICS for a in stats6(m, m)]))


PROC_SELECT = """SELECT run_id, gpu_uuid, pid, window_index, n AS sample_count, avg_process_gpu_utilization_pct, std_process_gpu_utilization_pct,
  avg_process_gpu_memory_pct, avg_host_ram_gb, CASE WHEN avg_process_gpu_utilization_pct IS NULL THEN 'insufficient_process_util' ELSE 'exact' END AS status FROM pw"""


@query("process_windows", sql(PROC_SELECT, "v4", "v4b", "pw"))
def process_windows(spark, d):
    return rounded(N.process_windows(views.process_samples(spark, d), PROCESS_SPEC).drop("k", "start_ns", "end_ns"))


_hyb = [f"{m if m.startswith('process_') else 'process_' + m}_{s}" for m in N.PROCESS_METRICS for s in ("mean", "std", "min", "max", "median", "p95")]


@query("hybrid_interval_join", sql(f"""
, hd AS (SELECT w.run_id, w.gpu_uuid, w.pid, w.window_index, count(*) AS sample_count_device, {', '.join(stats_sql('s.' + m, 'device_' + m) for m in N.DEVICE_METRICS)}
  FROM hw w JOIN v4 s ON s.run_id = w.run_id AND s.gpu_uuid = w.gpu_uuid AND s.timestamp_ns BETWEEN w.start_ns AND w.end_ns GROUP BY ALL)
SELECT run_id, gpu_uuid, pid, window_index, start_ns AS window_start_ns, end_ns AS window_end_ns, n AS sample_count_process,
  coalesce(sample_count_device, 0) AS sample_count_device, {', '.join(f'round({c}, 6) AS {c}' for c in _hyb)},
  {', '.join(f'round(device_{c}, 6) AS device_{c}' for c in _names)} FROM hw LEFT JOIN hd USING (run_id, gpu_uuid, pid, window_index)""", "v4", "v4b", "hw"))
def hybrid_windows(spark, d):
    # put in order and shuffled once for both sides and the span of the runs
    rows = materialize(views.device_samples(spark, d).drop("n"), "samples")
    return rounded(N.hybrid_windows(views.process_side(rows), rows, PROCESS_SPEC))


@query("join_process_sources", sql("""
, m AS (SELECT timestamp_ns, gpu_uuid, pid, max('m' || run_id) AS process_name, CAST(max(host_ram_gb * 10) AS BIGINT) AS memory_used_bytes FROM v4b WHERE process_gpu_memory_pct < 95 GROUP BY ALL),
u AS (SELECT timestamp_ns, gpu_uuid, pid, max('u' || run_id) AS process_name, max(process_gpu_utilization_pct) AS process_gpu_utilization_pct FROM v4b WHERE process_gpu_memory_pct > 88 GROUP BY ALL)
SELECT timestamp_ns, gpu_uuid, pid, coalesce(m.process_name, u.process_name) AS process_name, memory_used_bytes, process_gpu_utilization_pct
FROM m FULL JOIN u USING (timestamp_ns, gpu_uuid, pid)""", "v4", "v4b"))
def _(spark, d):
    rows = views.process_samples(spark, d)
    keys = ["timestamp_ns", "gpu_uuid", "pid"]
    memory = rows.where(F.col("process_gpu_memory_pct") < 95).groupBy(*keys).agg(
        F.max(F.concat(F.lit("m"), "run_id")).alias("process_name"), F.round(F.max(F.col("host_ram_gb") * 10)).cast("long").alias("memory_used_bytes"))
    util = rows.where(F.col("process_gpu_memory_pct") > 88).groupBy(*keys).agg(
        F.max(F.concat(F.lit("u"), "run_id")).alias("process_name"), F.max("process_gpu_utilization_pct").alias("process_gpu_utilization_pct"))
    return N.join_process_sources(memory, util)


def run_metadata(spark, d) -> DataFrame:
    return views.captures(spark, d).select(
        F.col("capture_id").alias("run_id"), "workload", "label", scalars.binary_label("label").alias("binary_label"), "family",
        "program", "variant", "target_percent", "repeat", "runtime_sec", "status")


META = "workload, label, CASE WHEN label = 'mining_like' THEN 'mining' ELSE 'benign' END AS binary_label, family, program, variant, target_percent, repeat, runtime_sec"


@query("enrich_with_run_metadata", sql(f"""
SELECT run_id, gpu_uuid, sample_index, {META}, NULL AS experiment, NULL AS throttle_mode FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp_ns) - 1 AS sample_index FROM v4) s
LEFT JOIN v7 ON v7.capture_id = s.run_id""", "v4", "v7"))
def _(spark, d):
    points = N.device_points(views.device_samples(spark, d)).select("run_id", "gpu_uuid", "sample_index")
    return N.enrich_with_metadata(points, run_metadata(spark, d))


@query("filter_run_status", sql("SELECT run_id, timestamp_ns FROM v4 JOIN v7 ON v7.capture_id = run_id WHERE status <> 'skipped_missing_executable'", "v4", "v7"))
def _(spark, d):
    good = run_metadata(spark, d).where(F.col("status") != "skipped_missing_executable").select("run_id")
    return views.device_samples(spark, d).join(good, "run_id", "left_semi").select("run_id", "timestamp_ns")


@query("feature_build_report", sql("""
SELECT 'label' AS metric, CASE WHEN label = 'mining_like' THEN 'mining' ELSE 'benign' END AS key, count(*) AS n FROM v7 WHERE status = 'ok' GROUP BY ALL
UNION ALL SELECT 'runs', 'scanned', count(*) FROM v7
UNION ALL SELECT 'table', 'points', count(*) FROM v4 UNION ALL SELECT 'table', 'device_windows', count(*) FROM dw
UNION ALL SELECT 'table', 'process_windows', count(*) FROM pw""", "v4", "v4b", "v7", "dw", "pw"))
def _(spark, d):
    return N.feature_report(run_metadata(spark, d), {
        "points": views.device_samples(spark, d),
        "device_windows": N.sliding_windows(views.device_samples(spark, d), ["run_id", "gpu_uuid"], SPEC),
        "process_windows": N.sliding_windows(views.process_samples(spark, d), ["run_id", "gpu_uuid", "pid"], PROCESS_SPEC)})


def text_rows(spark, d) -> DataFrame:
    """Samples as untyped text cells, some of them unparseable."""
    rows = views.device_samples(spark, d)
    return rows.select(
        "run_id", "timestamp_ns", F.col("gpu_utilization_pct").cast("string").alias("gpu_utilization_pct"),
        F.col("power_usage_watts").cast("string").alias("power_usage_watts"),
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("temperature_celsius").cast("string")).alias("temperature_celsius"),
        F.col("fan_speed_pct").cast("string").alias("fan_speed_pct"))


@query("numeric_coercion", sql("""
SELECT run_id, timestamp_ns, gpu_utilization_pct, CASE WHEN l_linenumber <> 3 THEN temperature_celsius END AS temperature_celsius, fan_speed_pct FROM v4""", "v4"))
def _(spark, d):
    cols = ("gpu_utilization_pct", "temperature_celsius", "fan_speed_pct")
    return text_rows(spark, d).select("run_id", "timestamp_ns", *[scalars.number(c).alias(c) for c in cols])


@query("usable_feature_columns", sql("SELECT run_id, timestamp_ns, 'gpu_utilization_pct,power_usage_watts' AS features, gpu_utilization_pct, power_usage_watts FROM v4", "v4"))
def _(spark, d):
    rows = text_rows(spark, d)
    usable = N.usable_features(rows, ["gpu_utilization_pct", "power_usage_watts", "temperature_celsius", "fan_speed_pct"])
    return N.complete_rows(rows, usable).select("run_id", "timestamp_ns", F.lit(",".join(usable)).alias("features"), *usable)


@query("derived_units", sql("""
SELECT run_id, timestamp_ns, round(power_usage_watts * 1000000 / 1e9, 9) AS gb, round(CASE WHEN fan_speed_pct <> 0 THEN power_usage_watts / fan_speed_pct * 100 END, 6) AS pct,
  round((timestamp_ns % 1000000000000) / 1e6, 3) AS ms FROM v4""", "v4"))
def _(spark, d):
    return views.device_samples(spark, d).select(
        "run_id", "timestamp_ns", F.round(scalars.bytes_to_gb(F.col("power_usage_watts") * 1_000_000), 9).alias("gb"),
        F.round(scalars.percent_of("power_usage_watts", "fan_speed_pct"), 6).alias("pct"),
        F.round(scalars.ns_to_ms(F.col("timestamp_ns") % 1_000_000_000_000), 3).alias("ms"))


@query("parse_counter_csv", sql("""
SELECT run_id, timestamp_ns, gpu_utilization_pct AS util, CASE l_linenumber % 3 WHEN 0 THEN NULL ELSE power_usage_watts END AS power,
  CAST(temperature_celsius AS BIGINT) * 1048576 AS memory_bytes, CASE WHEN l_linenumber % 2 <> 0 THEN fan_speed_pct END AS fan FROM v4""", "v4"))
def _(spark, d):
    v = views.device_samples(spark, d)
    line = F.concat_ws(", ", "run_id", "timestamp_ns", F.concat(F.col("gpu_utilization_pct"), F.lit(" %")),
                       F.when(F.col("l_linenumber") % 3 == 0, "[N/A]").otherwise(F.concat(F.col("power_usage_watts"), F.lit(" W"))),
                       F.concat(F.col("temperature_celsius").cast("int"), F.lit(" MiB")), F.col("fan_speed_pct"))
    cells = N.parse_counter_csv(v.select(line.alias("line")), ["run_id", "timestamp_ns", "util", "power", "memory", "fan"])
    return cells.select(F.col("run_id").cast("long").alias("run_id"), F.col("timestamp_ns").cast("long").alias("timestamp_ns"),
                        scalars.counter_number("util").alias("util"), scalars.counter_number("power").alias("power"),
                        scalars.mib_to_bytes("memory").alias("memory_bytes"), scalars.counter_number("fan").alias("fan"))


@query("parse_process_monitor", sql("""
SELECT run_id AS gpu_index, timestamp_ns // 1000000 AS pid, 'C' AS process_type, gpu_utilization_pct AS process_gpu_utilization_pct, fan_speed_pct AS encoder_utilization_pct,
  'job ' || l_linenumber || ' x' AS process_name FROM v4 WHERE l_linenumber <> 4 AND l_linenumber <> 5""", "v4"))
def _(spark, d):
    v = views.device_samples(spark, d)
    pid = F.when(F.col("l_linenumber") == 4, "-").otherwise(F.expr("timestamp_ns div 1000000").cast("string"))
    line = F.concat_ws("   ", "run_id", pid, F.lit("C"), "gpu_utilization_pct", F.lit("1"), F.coalesce(F.col("fan_speed_pct").cast("string"), F.lit("-")),
                       F.lit("- - - job"), F.col("l_linenumber"), F.lit("x"))
    line = F.when(F.col("l_linenumber") == 5, F.lit("# gpu pid type")).otherwise(line)
    return N.parse_process_monitor(v.select(line.alias("line"))).select(
        "gpu_index", "pid", "process_type", "process_gpu_utilization_pct", "encoder_utilization_pct", "process_name")


VERDICT = """CASE WHEN status = 'insufficient_process_util' THEN status WHEN avg_process_gpu_utilization_pct IS NULL OR avg_process_gpu_memory_pct IS NULL OR avg_host_ram_gb IS NULL
  OR std_process_gpu_utilization_pct IS NULL THEN 'insufficient_metrics' WHEN avg_process_gpu_utilization_pct <= 80 OR avg_process_gpu_memory_pct <= 90 OR avg_host_ram_gb < 3
  OR avg_host_ram_gb > 4.5 OR std_process_gpu_utilization_pct >= 3.5 THEN 'benign' ELSE 'suspicious_mining' END"""

# verdicts need varied rows: short spans of three samples each
SQL["ps"] = """
ps AS (SELECT run_id, pid, timestamp_ns // 3000000000 AS span, avg(process_gpu_utilization_pct) AS avg_process_gpu_utilization_pct,
  stddev_pop(process_gpu_utilization_pct) AS std_process_gpu_utilization_pct, avg(process_gpu_memory_pct) AS avg_process_gpu_memory_pct, avg(host_ram_gb) AS avg_host_ram_gb,
  CASE WHEN avg(process_gpu_utilization_pct) IS NULL THEN 'insufficient_process_util' ELSE 'exact' END AS status, CASE WHEN run_id % 2 = 0 THEN 'mining' ELSE 'benign' END AS binary_label
  FROM v4b GROUP BY ALL)"""


def process_spans(spark, d) -> DataFrame:
    # verdicts cut at values that means meet exactly, so a span of three samples is summed in time order
    at, util, memory, ram = F.col("timestamp_ns"), *(F.col(m) for m in N.PROCESS_METRICS)
    rows = views.process_samples(spark, d).groupBy("run_id", "pid", F.expr("timestamp_ns div 3000000000").alias("span")).agg(
        gathered(util, at).alias("util"), gathered(memory, at).alias("memory"), gathered(ram, at).alias("ram"))
    rows = rows.select("run_id", "pid", "span", mean_in_order(F.col("util")).alias("avg_process_gpu_utilization_pct"),
                       deviation_in_order(F.col("util")).alias("std_process_gpu_utilization_pct"),
                       mean_in_order(F.col("memory")).alias("avg_process_gpu_memory_pct"), mean_in_order(F.col("ram")).alias("avg_host_ram_gb"))
    status = F.when(F.col("avg_process_gpu_utilization_pct").isNull(), "insufficient_process_util").otherwise("exact")
    return rows.withColumns({"status": status, "binary_label": F.when(F.col("run_id") % 2 == 0, "mining").otherwise("benign")})


@query("decision_tree_verdict", sql(f"SELECT run_id, pid, span, {VERDICT} AS verdict FROM ps", "v4", "v4b", "ps"))
def _(spark, d):
    verdict = scalars.process_verdict(F.col("status"), F.col("avg_process_gpu_utilization_pct"), F.col("avg_process_gpu_memory_pct"),
                                      F.col("avg_host_ram_gb"), F.col("std_process_gpu_utilization_pct"))
    return process_spans(spark, d).select("run_id", "pid", "span", verdict.alias("verdict"))


@query("rule_accuracy_report", sql(f"""
, v AS (SELECT *, {VERDICT} AS verdict FROM ps)
SELECT verdict, count(*) AS windows, count(*) FILTER (verdict IN ('benign', 'suspicious_mining')) AS comparable,
  count(*) FILTER (verdict IN ('benign', 'suspicious_mining') AND (verdict = 'suspicious_mining') = (binary_label = 'mining')) AS correct FROM v GROUP BY ALL""", "v4", "v4b", "ps"))
def _(spark, d):
    return N.rule_accuracy(process_spans(spark, d))


@query("latency_medians", sql("SELECT run_id, count(*) AS n, round(median(power_usage_watts), 6) AS median FROM v4 GROUP BY ALL", "v4"))
def _(spark, d):
    return rounded(ordered.quantile_by_rank(views.device_samples(spark, d), ["run_id"], "power_usage_watts"))


@query("run_alarm_rows", sql("""
, s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp_ns) - 1 AS idx, gpu_utilization_pct >= 90 AS pos, gpu_utilization_pct / 100 AS p,
   CASE WHEN l_partkey % 2 = 0 THEN 'mining' ELSE 'benign' END AS lab FROM v4),
m AS (SELECT run_id, lab, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, min(idx)) AS r FROM s GROUP BY run_id, lab)
SELECT s.run_id, any_value(m.lab) AS binary_label, count(*) FILTER (pos) AS positive_count, count(*) AS sample_count, round(avg(pos::INT), 6) AS positive_ratio,
  round(avg(p), 6) AS mean_mining_probability, max(p) AS max_mining_probability, min(idx) FILTER (pos) AS first_positive_index
FROM s JOIN m ON m.run_id = s.run_id AND m.r = 1 GROUP BY s.run_id""", "v4"))
def _(spark, d):
    rows = views.device_samples(spark, d).withColumns({
        "prediction": F.when(F.col("gpu_utilization_pct") >= 90, "mining").otherwise("benign"),
        "mining_probability": F.col("gpu_utilization_pct") / 100,
        "binary_label": F.when(F.col("l_partkey") % 2 == 0, "mining").otherwise("benign")})
    return rounded(N.run_alarm_rows(rows))
