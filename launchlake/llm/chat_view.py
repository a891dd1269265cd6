"""A view of ``conversations`` as tool calls and results, in DataFrames and in SQL.

Every assistant turn is a call that needs the one two turns before, or no other; every user
turn is the result for the turn before it. Arguments hold the whole text; some are faulty on
purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOOLS = ["search", "lookup", "translate"]


def schemas(spark: SparkSession) -> DataFrame:
    rows = [(tool, parameter, kind, True) for tool in TOOLS for parameter, kind in (("query", "string"), ("limit", "integer"))]
    return spark.createDataFrame(rows, "name string, parameter string, type string, required boolean")


def calls(conversations: DataFrame) -> DataFrame:
    n = F.length("text")
    query, limit = F.col("text").alias("query"), n.alias("limit")
    arguments = (F.when(n % 5 == 1, F.to_json(F.struct(query, limit.cast("string").alias("limit")))).when(n % 5 == 2, F.to_json(F.struct(query)))
                 .when(n % 5 == 3, F.to_json(F.struct(query, limit, F.lit("any").alias("lang")))).otherwise(F.to_json(F.struct(query, limit))))
    identify = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    name = F.get(F.array(*[F.lit(t) for t in [*TOOLS, "unlisted"]]), (n % 4).cast("int"))
    needs = F.when(n % 3 != 0, F.array(identify(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    return conversations.filter("role = 'assistant' and text is not null").select(
        "conv_id", "turn", identify(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), needs.alias("needs"))


def results(conversations: DataFrame) -> DataFrame:
    return conversations.filter("role = 'user' and text is not null and turn > 0").select(
        "conv_id", "turn", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))


SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, 'call-' || turn AS call_id, length(text) AS n, text,
         CASE length(text) % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'translate' ELSE 'unlisted' END AS name
  FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
r AS (SELECT conv_id, turn AS result_turn, 'call-' || (turn - 1) AS call_id, text AS content
      FROM conversations WHERE role = 'user' AND text IS NOT NULL AND turn > 0),
edge AS (SELECT c.conv_id, c.turn, p.turn AS need FROM c JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2 WHERE c.n % 3 <> 0),
lv AS (
  SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.conv_id = c.conv_id AND e.turn = c.turn)
  UNION ALL SELECT e.conv_id, e.turn, lv.level + 1 FROM lv JOIN edge e ON e.conv_id = lv.conv_id AND e.need = lv.turn),
full_rows AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, r.result_turn, c.name, c.n, c.text, r.content,
         CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, lv.level,
         CASE WHEN c.n % 3 <> 0 AND p.turn IS NULL THEN '["call-' || (c.turn - 2) || '"]' END AS missing,
         CASE WHEN c.turn IS NULL THEN NULL WHEN c.name = 'unlisted' THEN '["unknown_tool"]' WHEN c.n % 5 = 1 THEN '["type:limit"]'
              WHEN c.n % 5 = 2 THEN '["missing:limit"]' WHEN c.n % 5 = 3 THEN '["unknown:lang"]' ELSE '[]' END AS errors
  FROM c FULL JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
  LEFT JOIN lv ON lv.conv_id = c.conv_id AND lv.turn = c.turn LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2),
parts AS (
  SELECT *, to_json(text)::VARCHAR AS q FROM full_rows)
SELECT conv_id, call_id, turn, result_turn, name, status, level,
  row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(level, 2147483647), coalesce(turn, result_turn), call_id) - 1 AS place,
  CASE WHEN turn IS NULL THEN 0 ELSE 1 END AS n_calls, CASE WHEN result_turn IS NULL THEN 0 ELSE 1 END AS n_results,
  CASE WHEN errors IS NULL OR errors = '[]' THEN 0 ELSE 1 END AS n_errors, CASE WHEN missing IS NULL THEN 0 ELSE 1 END AS n_missing,
  '{' || CASE WHEN turn IS NULL THEN '' ELSE '"arguments":{' || CASE n % 5 WHEN 1 THEN '"limit":"' || n || '","query":' || q WHEN 2 THEN '"query":' || q
      WHEN 3 THEN '"lang":"any","limit":' || n || ',"query":' || q ELSE '"limit":' || n || ',"query":' || q END || '},' END
  || '"call_id":"' || call_id || '"' || coalesce(',"content":' || to_json(content)::VARCHAR, '') || coalesce(',"errors":' || errors, '')
  || coalesce(',"level":' || level, '') || coalesce(',"missing":' || missing, '') || coalesce(',"name":"' || name || '"', '')
  || ',"status":"' || status || '"}' AS line
FROM parts
"""
