"""Helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlake.session import prepare, scratch_dir

# Upper-case ASCII letters to lower case, for ``bytes.translate``; ``bytes.split()``
# then cuts at exactly the six ASCII white-space bytes 0x20 and 0x09-0x0D.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# Rows of text handed to Python at once; texts may be long.
ROWS_PER_BATCH = "1000"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings and small batches for Python."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` to the shared folder and read them back: cuts the lineage, survives lost executors."""
    path = scratch_dir(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# Sides of a join are broadcast only up to so many rows, counted after they are written.
BROADCAST_ROWS = 200_000


def bounded(rows: DataFrame) -> DataFrame:
    """``rows``, marked for broadcast if they are few; they must be written already."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as no column of ``rows`` has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(doc_id: str, text: str) -> Column:
    """128 bits that tell rows apart by id and text; null and empty differ."""
    part = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    return F.unhex(F.md5(F.concat(part(doc_id), F.lit(" "), part(text)).cast("binary")))


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``links`` (a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps: each round replaces the links
    of a node by links to the smallest neighbour, found by a map-side ``min``, so no
    neighbourhood is ever gathered. Rounds grow with the logarithm of the longest
    chain. Every round is written to the shared folder. Null ends and self links are
    dropped; repeated links do no harm; an empty table gives an empty table.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    edges = settle(edges, "components")
    while True:
        # Large star: every neighbour above a node is linked to the node's smallest neighbour or itself.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every neighbour below a node, and the node, are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        following = settle(small, "components")
        # Stars only: no lower end is itself an upper end, and no upper end has two lower ends.
        shape = following.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        chained = following.join(following.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        edges = following
        if shape.n == shape.d and not chained:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
