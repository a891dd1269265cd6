"""Token-id tables in ORC files.

Documents are ordered by id, tokenized, and written with the ids as an integer list
(run-length encoded by the format), a row index, and a Bloom filter on the document id. Stripes
are read in parallel; a lookup of documents skips the files, stripes and row groups whose
statistics or Bloom filter exclude them. ``seq`` is the place of a row in id order.

Null and empty texts hold the end id only. Rows with equal ids stay apart, ordered by the
hash of their text; a null id comes first. Extra columns are not written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from launchlake.llm import tokens
from launchlake.llm.common import settle

STRIPE_BYTES = 16 << 20
ROWS_PER_INDEX = 2000
# monotonically_increasing_id holds the partition above these bits.
ROW_BITS = 33


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = tokens.DEFAULT_TOKENIZER) -> None:
    """Write seq, doc_id and ids of every row to ORC files in ``path``, in ascending order of doc_id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in tokens.slices(texts):
                ids = [i + tokens.END for i in encoder.encode(texts[first:last])]
                ends = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids])))
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                                                 names=["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    encoded = ordered.mapInArrow(encode, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")
    (encoded.select(F.monotonically_increasing_id().alias("seq"), "doc_id", "ids").write
     .option("compression", "zstd").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROWS_PER_INDEX)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """seq, doc_id and ids."""
    return spark.read.orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter reaches the files' indexes and Bloom filters."""
    return read(spark, path).filter(F.col("doc_id").isin(doc_ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all rows before), n_tokens and ids_crc32 of every row, from the files."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            ends = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            checks = [tokens.crc(values[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(checks, pa.int64())],
                                             names=["seq", "doc_id", "n_tokens", "ids_crc32"])

    stored = read(spark, path).select("seq", "doc_id", "ids")
    rows = stored.mapInArrow(scan, f"seq long, doc_id {dict(stored.dtypes)['doc_id']}, n_tokens long, ids_crc32 long")
    rows = settle(rows.withColumn("file", F.shiftright("seq", ROW_BITS)), "token-digests")
    # One total per file, then running sums of files and of the rows of each file.
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("file").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(files, "file").select("doc_id", (F.col("ahead") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
