"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlake.llm import (chat_view, collocations, decontaminate, exact_dedup, language_id, lm_scoring, neighbours, packing, pii, repeats, simhash, spelling,
                            token_file, tool_calls)
from launchlake.llm.common import read_table
from launchlake.llm.registry import query
from launchlake.session import scratch_dir


def _fold(doc_id: str, parts: int):
    """crc32 of the id's text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = read_table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.filter(_fold("doc_id", 4) != 2))
    rows = docs.select("doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), "text")
    return language_id.predict(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document holds a benchmark item, copied or re-parameterised."""
    return decontaminate.decisions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op8_pii_weak_supervision")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and all spans of personal data in every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs)).drop("text")
    kinds = F.col("base.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"))


@query("op6_token_orc")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the ORC files."""
    path = scratch_dir(spark, "token-ids")
    token_file.write(read_table(spark, sf_dir, "documents"), path)
    return token_file.digests(spark, path)


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return packing.pack(packing.pieces(read_table(spark, sf_dir, "documents")))


@query("op9_nearest_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows found for every embedding whose id is divisible by 100."""
    return neighbours.search(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos, len(words) AS n FROM d),
k AS (SELECT r, pos, CASE WHEN pos + 35 <= n THEN sha256(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h, word FROM w),
c AS (SELECT r, pos, word, CASE WHEN h IS NOT NULL THEN count(*) OVER (PARTITION BY h) > 1 ELSE false END AS again FROM k),
g AS (SELECT r, pos, word, bool_or(again) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
s AS (SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM g GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""


@query("op5_de_bruijn_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages."""
    left = repeats.remove(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op4_context_tree_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from nine tenths of them, beside a unigram base."""
    scored = lm_scoring.score(read_table(spark, sf_dir, "documents"), _fold("doc_id", 10) != 0)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op1_tool_call_linking", chat_view.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tool call and result of the conversations, linked, ordered, checked and serialised."""
    conversations = read_table(spark, sf_dir, "conversations")
    return tool_calls.link(chat_view.calls(conversations), chat_view.results(conversations), chat_view.schemas(spark))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its number of near words, its form and the last of its forms."""
    return spelling.variants(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS size, unnest(w) AS phrase FROM q
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM q
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM q),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT lang, phrase, a, 1 AS k, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM c UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE size = 3),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lp JOIN f y ON y.lang = k.lang AND y.phrase = k.rp),
b AS (SELECT lang, phrase, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM s GROUP BY lang, phrase, a),
i AS (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE size = 3),
m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
w AS (SELECT doc_id, content, row_number() OVER g AS place, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY content) AS group_size
  FROM d WINDOW g AS (PARTITION BY content ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(content) AS text_sha256 FROM w
"""


@query("op13_exact_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document, and whether it stays."""
    return exact_dedup.groups(read_table(spark, sf_dir, "documents"))
