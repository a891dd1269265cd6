"""Exact deduplication by skew-safe combining.

Two texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]``
is deleted. Of equal texts the row with the most code points in the original text stays,
then the one with the smallest id, then any one of the rows that share both.

Rows are numbered and written once with their normalised text, its digest and a salt, which
is the part of the table that the row stood in. Then

1. every part removes its own duplicates (the map side of the grouping by digest, salt and text)
   and the parts of one salt are merged; a group of a third of all rows becomes at most one
   row per part, and one per salt after the merge;
2. the winners of the salts are combined per digest and text;
3. the result travels back over digest and salt, so no task gets a whole large group.

The text is part of every grouping key, so digests only say where texts meet, never that they
are equal. Where different texts share a digest, their rows find their group by the whole text.
Texts whose digest occurs once are not shuffled as long as the repeated digests are few enough
to be sent around; beyond that size, texts are grouped first and sorted out afterwards.

Null counts as empty, so null, empty and white-space texts are one group. A null id counts as
larger than every other. Repeated rows are copies like any other: exactly one row of a group is
kept. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchlake.llm.common import BROADCAST_ROWS, settle

SALTS = 256
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _numbered(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """row, doc_id, n (code points), content, sha256, digest and salt; written, so that row numbers last."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                       F.length(F.coalesce(text, F.lit(""))).alias("n"), normalised(F.col(text)).alias("content"))
    rows = rows.select("*", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), digest(F.col("content")).alias("digest"))
    return settle(rows.withColumn("salt", F.shiftrightunsigned("row", 33) % SALTS), "exact-rows")


def _combined(groups: DataFrame, *keys: str) -> DataFrame:
    """The best row and the size of every group; both combine on the map side."""
    return groups.groupBy(*keys).agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = F.xxhash64,
           sent_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id (the id of the row that stays), group_size, kept and text_sha256."""
    rows = _numbered(docs, doc_id, text, digest)
    often = settle(rows.groupBy("digest").agg(F.count("*").alias("seen")).filter("seen > 1").select("digest"), "repeated-digests")
    single = rows.select("digest", "salt", "content", F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("best"),
                         F.lit(1).cast("long").alias("size"))
    few = often.limit(sent_rows + 1).count() <= sent_rows
    if few:
        single = single.join(F.broadcast(often), "digest", "left_semi")
    merged = _combined(single, "digest", "salt", "content")
    if not few:
        merged = merged.join(often, "digest", "left_semi")
    merged = settle(merged, "salt-winners")
    whole = settle(_combined(merged, "digest", "content"), "group-winners")

    stays = [F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("size").alias("group_size")]
    shared = settle(whole.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "shared-digests")
    own = whole.join(shared, "digest", "left_anti").select("digest", *stays)
    back = merged.select("digest", "salt").distinct().join(own, "digest")
    named = rows.drop("content").join(back, ["digest", "salt"], "left")
    if not shared.isEmpty():
        plain = named.join(shared, "digest", "left_anti")
        named = plain.unionByName(rows.join(shared, "digest", "left_semi").join(whole.select("digest", "content", *stays), ["digest", "content"]).drop("content"))
    return named.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.col("sha256").alias("text_sha256"))
