"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from launchlake.session import build_session

HEADLINE = [
    "token_budget_windows", "first_signature_only", "top_kernels", "launch_gaps", "capture_event_summary",
    "device_windows", "adaptive_sliding_windows", "latency_medians", "run_alarm_rows", "opcode_mix", "bitwise_integer_ratio",
    "token_prefix_truncate", "natural_loops", "grouped_stratified_split", "chunk_probability_pooling", "chunk_tokens",
    "stream_token_windows",
]


SHIPPED_BUDGET, COPIES = 8190, 5


def shipped_budget(spark, sf_dir: str) -> tuple[float, int]:
    """Seconds and launches of the window scan at the shipped budget: the view's launches, five times in a row per stream."""
    from pyspark.sql import functions as F

    from launchlake.operators import windows as W
    from launchlake.plans.launch_queries import launch_rows

    rows = launch_rows(spark, sf_dir)
    span = rows.agg(F.max("sequence") + 1).first()[0]
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn("sequence", F.col("sequence") + F.col("copy") * span).drop("copy")
    start = time.time()
    W.token_budget_windows(rows, W.WindowConfig(budget=SHIPPED_BUDGET)).write.format("noop").mode("overwrite").save()
    return time.time() - start, rows.count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from launchlake.plans import catalog

    catalog.QUERIES["event_type_counts"](spark, sf_dir).collect()  # start the session
    times = {}
    for key in HEADLINE:
        start = time.time()
        catalog.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - start, 3)
    seconds, launches = shipped_budget(spark, sf_dir)
    times["token_budget_windows_8190"] = round(seconds, 3)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "lineitem")}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times[k] for k in HEADLINE), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir),
        "launches_per_sec": round(rows["events"] / times["token_budget_windows"]), "launches_per_sec_8190": round(launches / seconds), "samples_per_sec": round(rows["lineitem"] / times["device_windows"])}))


if __name__ == "__main__":
    main()
