"""The training-text pipeline: language ID, near-duplicates, benchmark text, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlake.llm import decontaminate, language_id, packing, pii, simhash
from launchlake.llm.common import free_name, prepared, read_table, row_key, settle

# A cosine below this with every language is no language at all.
LEAST_COSINE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was learned; profiles come from the rows of ``docs`` that name one.

    Null texts and texts without a letter are in no language and go.
    """
    prepared(spark)
    language, cosine = free_name(docs, "language_found"), free_name(docs, "cosine_found")
    judged = language_id.predict(docs, language_id.learn(docs), pred=language, score=cosine)
    return judged.filter((F.col(language) != language_id.UNDETERMINED) & (F.col(cosine) >= LEAST_COSINE)).drop(language, cosine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of close fingerprints: the one with the smallest id, then the smallest 128-bit key.

    Rows are told apart by id and text: equal rows are one document, rows that share an id but not the text are
    judged by themselves, and a missing id comes before all others.
    """
    prepared(spark)
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    grouped = simhash.near_duplicates(keyed.select(F.struct("doc_id", F.col(key).alias("key")).alias("id"), "text"), doc_id="id")
    kept = settle(grouped.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id.key").alias(key)).distinct(), "kept-rows")
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Null and empty texts hold none."""
    prepared(spark)
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; n_chars follows. Null texts stay null."""
    prepared(spark)
    redacted = pii.redact(docs, pii.learn(docs))
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; null and empty texts are one end id."""
    prepared(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("pii", redact_personal_data),
    ("packing", pack),
]

# Hyperdimensional profiles, the span classifier and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
