"""Starting streams: sources over tables, sinks, and running to the end."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Sequence
from threading import Condition

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from launchlake.session import materialize, scratch_dir


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_append(stream: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Process everything available into a parquet table and return it; with the ``out`` of a run before, go on where it ended."""
    spark = stream.sparkSession
    out = out or scratch_dir(spark, name)
    started = stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start(out)
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def write_batches(stream: DataFrame, out: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Start a stream whose every micro-batch is one folder named by its number.

    A batch that was cut short is written again under the same number after a restart from the same
    checkpoint and replaces what is there, so every row is delivered once.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")  # a stream without rows is an empty table

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint or out + "-checkpoint").trigger(availableNow=True).start()


def read_batches(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """The rows of all batches, with the number of their batch."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(out)


def run_update(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Aggregates in update mode: a batch writes the keys it changed, and the last version of a key counts."""
    out = scratch_dir(stream.sparkSession, name)
    write_batches(stream, out, "update").awaitTermination()
    rows = read_batches(stream.sparkSession, out, stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


class ObservedTotals(StreamingQueryListener):
    """Adds up the metrics that streams of a session observe (``DataFrame.observe``) batch by batch."""

    def __init__(self) -> None:
        self.totals: dict[str, Counter] = defaultdict(Counter)
        self.ended: set[str] = set()
        self._changed = Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.totals[name].update({k: v for k, v in row.asDict().items() if v is not None})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self.ended.add(str(event.runId))
            self._changed.notify_all()

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Events arrive behind the stream; wait until its last has."""
        with self._changed:
            self._changed.wait_for(lambda: str(query.runId) in self.ended, seconds)


def stage_in_order(rows: DataFrame, order: str, keys: Sequence[Column], name: str, steps: int = 4, rows_per_file: int = 500_000) -> str:
    """Write a table in ``steps`` appends of rising ``order``, so a stream of one file at a time sees it in that order.

    Within an append the rows of a key stay in one file.
    """
    out = scratch_dir(rows.sparkSession, name)
    span = rows.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(F.lit(1)).alias("n")).first()
    width = ((span.high or 0) - (span.low or 0)) // steps + 1
    files = max(1, -(-span.n // (steps * rows_per_file)))
    for step in range(steps):
        low = (span.low or 0) + step * width
        rows.where(F.col(order).between(low, low + width - 1)).repartition(files, *keys).write.mode("append").parquet(out)
    return out


def run_by_steps(rows: DataFrame, order: str, name: str, build: Callable[[DataFrame], DataFrame], beyond: int, steps: int = 4) -> DataFrame:
    """Run a stream over a table that is appended in ``steps`` of rising ``order``, and over an end mark ``beyond`` the last row.

    The stream is started again after every append, from its checkpoint. So an append is one micro-batch however many
    files it has, and no row comes behind a watermark that rows of its own append have set.
    """
    spark = rows.sparkSession
    rows, feed, out = materialize(rows, f"{name}-rows"), scratch_dir(spark, f"{name}-feed"), scratch_dir(spark, name)
    span = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    width = ((span.high or 0) - (span.low or 0)) // steps + 1
    for step in range(steps + 1):
        low = (span.low or 0) + step * width
        if step < steps:
            rows.where(F.col(order).between(low, low + width - 1)).write.mode("append").parquet(feed)
        else:
            close_feed(feed, rows, order, beyond)
        found = run_append(build(stream_table(spark, feed, rows.schema)), name, out)
    return found


def close_feed(path: str, rows: DataFrame, order: str, beyond: int) -> None:
    """Append an end mark to a staged feed: rows of nobody, ``beyond`` after the last, that push the watermark over every window."""
    last = rows.agg((F.max(order) + beyond).alias(order))
    mark = last.select(*[(F.col(order) if f.name == order else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    for _ in range(2):  # the second batch sees the watermark that the first one set
        mark.coalesce(1).write.mode("append").parquet(path)


def stage(rows: DataFrame, name: str, files: int | None = None) -> str:
    """Write a table other jobs or streams read from the shared folder."""
    out = scratch_dir(rows.sparkSession, name)
    (rows.repartition(files) if files else rows).write.parquet(out)
    return out
