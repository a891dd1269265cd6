"""Near-duplicate detection by SimHash fingerprints and pigeonhole blocks.

A fingerprint has 64 bits; bit b is set if it is set in over half of the XXH64
values (seed 42) of the text's word shingles, repeats included. Texts are lower-cased
(A-Z) and cut at ASCII white space. A text of fewer words than a shingle has is one
shingle; a text without words, or null, has fingerprint zero and is linked like any other.

Rows link when their fingerprints differ in at most ``distance`` bits. Equal
fingerprints are one node, so copies cost one row each. Fingerprints are cut into
``blocks`` blocks: two that differ in few bits agree in at least ``blocks - distance``
of them, so every choice of that many blocks is a join key and no link is lost. A key
shared by more than ``crowd`` fingerprints is not compared pair by pair: there each
fingerprint is joined on its own value with every single bit of the other blocks turned
over (and unturned), because two values within two bits of each other always meet at a
value within one bit of both. Either way the distance is checked before a link is kept.

Null ids are kept as rows of their own fingerprint and take no part in naming a
component. Repeated rows stay. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlake.llm.common import LOWER, connected_components, settle

BITS = 64
SEED = 42
SLICE = 1 << 16  # shingles whose bits are added at once


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    tokens = text.encode().translate(LOWER).split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    size = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[size - 1:])], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[at:at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return ids.mapInArrow(scan, f"doc_id {dict(ids.dtypes)['doc_id']}, fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    """The bits of every choice of blocks that close fingerprints must share."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(distinct: DataFrame, blocks: int = 5, distance: int = 2, crowd: int = 64) -> DataFrame:
    """(a, b) with a < b: links whose components are those of all pairs within ``distance`` bits."""
    if distance > 2:
        raise ValueError("crowded keys are resolved exactly up to a distance of two bits")
    masks = _masks(blocks, distance)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("at", "key"))
    sizes = keyed.groupBy("at", "key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = settle(keyed.join(sizes, ["at", "key"]), "blocks")

    few = keyed.filter(F.col("n") <= crowd)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = few.select("at", "key", F.col("fp").alias("a")).join(few.select("at", "key", F.col("fp").alias("b")), ["at", "key"]).filter(
        (F.col("a") < F.col("b")) & near).select("a", "b")

    # A crowded key: meet at the values one bit away, each of which links to its smallest member.
    turned = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(BITS)])
    crowded = keyed.filter(F.col("n") > crowd).select("fp").distinct()
    met = crowded.select("fp", F.explode(turned).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("meeting"))
    first = met.groupBy("meeting").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).filter("a < last").select("meeting", "a")
    stars = met.join(first, "meeting").select("a", F.col("fp").alias("b")).filter((F.col("a") < F.col("b")) & near)
    return pairs.union(stars).distinct()


def components(spark: SparkSession, prints: DataFrame, **search: int) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable."""
    prints = settle(prints, "fingerprints")
    owners = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("owner")), "owners")
    joined = connected_components(spark, links(owners.select("fp"), **search))
    grouped = owners.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "owner", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("owner").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, **search: int) -> DataFrame:
    """One row per row of ``docs``, with its fingerprint and component."""
    return components(docs.sparkSession, fingerprints(docs, doc_id, text, words), **search)
