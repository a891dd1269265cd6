"""JSON, CSV and parquet readers and writers for captures and features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from launchlake.functions import scalars
from launchlake.session import materialize

LAUNCH_SCHEMA = (
    "sequence long, timestamp_ns long, pid long, tid long, code_id long, kernel_name string, grid_dim array<int>, "
    "block_dim array<int>, shared_mem_bytes long, stream long, device_pci_bus_id string")
EVENT_SCHEMA = (
    f"session_id string, capture_id string, type string, event_type string, {LAUNCH_SCHEMA}, "
    "path string, sha256 string, size long, dropped_events long, queued_events long, exe_path string")
MESSAGE_SCHEMA = f"type string, session_id string, launches array<struct<{LAUNCH_SCHEMA.replace(' long', ':long').replace(' string', ':string').replace(' array', ':array')}>>"


# Counts of byte ranges are sent to every task only up to so many, counted after they are written.
SENT_RANGES = 200_000


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value``, partition columns, ``_file`` and ``_line`` (from 1) of every line of text files, however the files are split.

    Lines of one byte range stand together in one task, so a line's place in its range is its running id less the
    range's first. Ranges are counted ahead, one small row each, and added up file by file.
    """
    def ranges() -> DataFrame:
        return spark.read.text(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_id"))

    counted = ranges().groupBy("_file", "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counted = materialize(counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "line-ranges")
    few = counted.limit(SENT_RANGES + 1).count() <= SENT_RANGES
    rows = ranges().join(F.broadcast(counted) if few else counted, ["_file", "_range"])
    return rows.select(*[c for c in rows.columns if c not in ("_range", "_id", "_first", "_before")], (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("_line"))


def read_events(spark: SparkSession, path: str | list[str], schema: str = EVENT_SCHEMA, strict: bool = True) -> DataFrame:
    """Event log lines with their file and line number. Blank lines are skipped but counted.

    A bad line stops a strict read with its file, line number and text; a lenient read
    keeps it in ``_bad``. Partition folders become columns, as in other readers.
    """
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("_event", parsed)
    names = [n for n in rows.schema["_event"].dataType.names if n != "_bad"]
    folders = set(rows.columns)
    rows = rows.select(*[(F.col(n) if n in folders else F.col(f"_event.`{n}`")).alias(n) for n in names], F.col("_event._bad").alias("_bad"), "_file", "_line")
    if not strict:
        return rows
    message = F.concat(F.col("_file"), F.lit(":"), F.col("_line").cast("string"), F.lit(": invalid JSON: "), F.col("_bad"))
    checked = F.when(F.col("_bad").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("_file"))
    return rows.withColumn("_file", checked).drop("_bad")


def read_manifests(spark: SparkSession, patterns: Sequence[str], schema: str | None = None) -> DataFrame:
    """Rows of all manifest files that match, with file path."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(sorted(set(patterns))).withColumn("_file", F.col("_metadata.file_path"))


def read_metric_logs(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """One metric table of every run folder; a run without the file adds nothing."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root)
    return rows.withColumn("run_folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_feature_csv(spark: SparkSession, path: str, numeric: Sequence[str]) -> DataFrame:
    """Feature table with the named columns as doubles, unparseable cells null."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.withColumns({c: scalars.number(c) for c in numeric if c in rows.columns})


def write_examples(examples: DataFrame, path: str, fmt: str = "json") -> None:
    """Examples by split; a repeated write replaces only the splits it holds."""
    examples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").format(fmt).save(path)


def union_of_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames under the sorted union of their columns."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*sorted(out.columns))


def write_feature_csv(frames: Sequence[DataFrame], path: str) -> None:
    union_of_columns(frames).write.mode("overwrite").option("header", "true").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """Small keyed report as JSON lines."""
    report.write.mode("overwrite").json(path)


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Live feed of launch batches, one row per launch."""
    reader = spark.readStream.schema(MESSAGE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.json(path).where(F.col("type") == "kernel_launch_batch")
    return rows.select("session_id", F.explode("launches").alias("l")).select("session_id", "l.*")
