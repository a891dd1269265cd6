"""Vocabulary, unknown rate, overlapping chunks, artifact checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from launchlake.functions import text as T
from launchlake.operators import dataset as D
from launchlake.operators import ordered

# The special tokens, in id order.
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]


def token_counts(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts per token; placeholders of captures without windows have no text to count."""
    return D.windowed_only(docs).select(*keys, F.explode(T.tokens(text)).alias("token")).groupBy(*keys, "token").agg(
        F.count(F.lit(1)).alias("n"))


def vocab_build(train: DataFrame, min_frequency: int = 1, text: str = "text") -> DataFrame:
    """(token, n, token_id): specials first, then by count and token.

    Ids are positions in one total order. Tokens of one count are placed by a
    bucketed scan over their leading bytes; only one row per distinct count is
    brought together to place the counts.
    """
    kept = token_counts(train, text).where((F.col("n") >= min_frequency) & ~F.col("token").isin(SPECIALS))
    # order-preserving slices: the count, then the first two bytes of the token
    raw = F.encode("token", "UTF-8")
    lead = F.conv(F.rpad(F.hex(F.substring(raw, 1, 2)), 4, "0"), 16, 10).cast("long")
    slices = kept.withColumns({"_c": -F.col("n"), "_a": lead})
    ranked = ordered.ordinal(slices, ["_c"], ["_a", "token"], [F.col("_a")], "_nth")
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.groupBy("_c").agg(F.count(F.lit(1)).alias("_m")).select("_c", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_first"))
    ranked = ranked.join(starts, "_c").select("token", "n", (F.col("_first") + F.col("_nth") + len(SPECIALS)).cast("long").alias("token_id"))
    fixed = kept.sparkSession.createDataFrame(
        [(t, 0, i) for i, t in enumerate(SPECIALS)], "token string, n long, token_id long")
    return fixed.unionByName(ranked)


def unknown_rate(docs: DataFrame, vocab: DataFrame, split: str = "split") -> DataFrame:
    """Tokens, unknown tokens and rate per split, from counts per token."""
    counts = token_counts(docs, keys=(split,)).join(
        vocab.select("token", F.lit(True).alias("known")), "token", "left")
    out = counts.groupBy(split).agg(
        F.sum("n").alias("tokens"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unknown_tokens"))
    return out.withColumn("unknown_rate", F.when(F.col("tokens") > 0, F.col("unknown_tokens") / F.col("tokens")).otherwise(0.0))


def top_unknown(docs: DataFrame, vocab: DataFrame, split: str = "split", n: int = 25) -> DataFrame:
    counts = token_counts(docs, keys=(split,)).join(vocab.select("token"), "token", "left_anti")
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(split).orderBy(F.desc("n"), "token")))
    return ranked.where(F.col("rank") <= n)


def chunk_tokens(rows: DataFrame, ids: str, window: int, stride: int, cls_id: int | None = None,
                 sep_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Overlapping chunks of an id array; an empty array gives one empty chunk."""
    if window <= 0 or stride >= window:
        raise ValueError("stride must be smaller than a positive window")
    step, n = window - stride, F.size(ids)
    count = F.when(n <= window, 1).otherwise(F.floor((n - window - 1) / step) + 2).cast("int")
    if limit is not None:
        count = F.least(count, F.lit(max(1, limit)))
    at = F.sequence(F.lit(0), F.col("num_chunks") - 1)
    parts = F.transform(at, lambda i: F.slice(F.col(ids), i * step + 1, window))
    rest = [c for c in rows.columns if c != ids]
    # slices are cut before they are spread out, so no row carries the whole array
    out = rows.withColumn("num_chunks", count).select(*rest, "num_chunks", F.posexplode(parts).alias("chunk_index", "input_ids"))
    if cls_id is not None:
        out = out.withColumn("input_ids", F.concat(F.array(F.lit(cls_id)), "input_ids", F.array(F.lit(sep_id))))
    return out.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


# What a workload's manifest must name.
REQUIRED_FIELDS = ["workload", "label", "family", "opt_level"]


def artifact_validation(workloads: DataFrame, max_launches: int = 16) -> DataFrame:
    """One (workload, rule, severity) row per broken rule.

    Takes the manifest fields, ``text``, ``launch_count`` and
    ``missing_kernels`` per workload.
    """
    boundaries = F.size(F.filter(F.split("text", "\n"), lambda s: s == T.KERNEL_BOUNDARY))
    cap = F.least(F.col("launch_count"), F.lit(max_launches))
    issue = lambda test, rule, level: F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("severity")))
    empty = T.strip("text") == ""
    missing_field = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(1)) for c in REQUIRED_FIELDS]))
    issues = F.array_compact(F.array(
        issue(F.size(missing_field) > 0, "manifest_missing_fields", "error"),
        issue(empty, "text_empty", "error"),
        issue(~empty & (boundaries < 1), "no_boundary", "error"),
        issue(boundaries > cap, "too_many_boundaries", "error"),
        issue(F.col("missing_kernels") > 0, "missing_kernel", "warning")))
    return workloads.select("workload", F.explode(issues).alias("i")).select("workload", "i.rule", "i.severity")
