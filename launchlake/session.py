"""Session settings shared by batch jobs, streams, tests and benchmarks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job of this library relies on. They are all session
# level, so they can be applied to a session that somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Folders of sessions on one machine that name no shared one, by application.
_local_scratch: dict[str, str] = {}


def build_session(app: str = "launchlake", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for stream checkpoints and hand-off tables.

    On a cluster this lies in the shared folder the session names in
    ``spark.checkpoint.dir``; only a session on one machine (tests) may do
    without one and gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = _local_scratch.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="launchlake-")
        _local_scratch[spark.sparkContext.applicationId] = base
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(rows: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and return it.

    Cuts the lineage on shared storage, so a lost executor costs a re-read
    and not a recomputation.
    """
    path = scratch_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
