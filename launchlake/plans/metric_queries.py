"""Queries over chunk probabilities and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlake.functions.stats import gathered, mean_in_order
from launchlake.operators import metrics as M
from launchlake.plans import views
from launchlake.plans.registry import query
from launchlake.plans.views import SQL, sql
from launchlake.session import scratch_dir
from launchlake.streaming import runner


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def chunks(spark, d, n_labels: int = 4) -> DataFrame:
    """Class probabilities; with fewer labels the logits are folded onto them."""
    logits = F.array(*[sum((F.col("logits")[j] for j in range(i + n_labels, 4, n_labels)), F.col("logits")[i]) for i in range(n_labels)])
    return views.chunk_logits(spark, d).withColumn("probabilities", M.softmax(logits))


def windowed(spark, d, n_labels: int) -> DataFrame:
    """Chunks of the workloads that have windows; every tenth has none."""
    return chunks(spark, d, n_labels).where(F.col("workload") % 10 != 9)


SQL["pool2"] = """
lg2 AS (SELECT workload, class_id, p FROM (SELECT workload, unnest([0, 1]) AS class_id, unnest([p0, p1]) AS p FROM prob2) WHERE workload % 10 <> 9),
pool2 AS (SELECT workload, class_id, avg(p) AS mean, max(p) AS max, count(*) AS num_chunks, list_avg(list_slice(list(p ORDER BY p DESC), 1, 3)) AS topk_mean FROM lg2 GROUP BY ALL),
pred2 AS (SELECT workload, arg_max(class_id, (mean, -class_id)) AS pred_id FROM pool2 GROUP BY ALL),
none2 AS (SELECT DISTINCT workload FROM v6 WHERE workload % 10 = 9),
full2 AS (SELECT p.*, d.pred_id FROM pool2 p JOIN pred2 d USING (workload) UNION ALL
  SELECT workload, c, (c = 0)::INT::DOUBLE, (c = 0)::INT::DOUBLE, 0, (c = 0)::INT::DOUBLE, 0 FROM none2, (SELECT unnest([0, 1]) AS c)),
susp AS (SELECT workload, pred_id, num_chunks, mean AS mining_mean, max AS mining_max, topk_mean AS mining_topk, pred_id = 1 OR max >= 0.9 OR topk_mean >= 0.75 AS suspicious,
  CASE WHEN pred_id = 1 THEN 'mean_pooling_decision' WHEN max >= 0.9 THEN 'max_p_mining>=0.9' WHEN topk_mean >= 0.75 THEN 'top' || least(3, greatest(1, num_chunks)) || '_mean_p_mining>=0.75' ELSE 'below_threshold' END AS suspicious_reason
  FROM full2 WHERE class_id = 1)"""


def pooled2(spark, d) -> DataFrame:
    pooled = M.pool_chunks(windowed(spark, d, 2))
    records = views.chunk_logits(spark, d).select("workload").distinct()
    return pooled.select("workload", "class_id", "mean", "max", "num_chunks", "topk_mean", "pred_id").unionByName(
        M.no_window_defaults(records, pooled, 2, 0))


def suspicious(spark, d) -> DataFrame:
    return M.suspicious_rule(pooled2(spark, d), 1)


def records(spark, d) -> DataFrame:
    rows = views.chunk_logits(spark, d)
    return rows.groupBy("workload").agg(F.min("group_id").alias("group_id"), F.min("label_id").alias("label_id"), F.min("session_id").alias("session_id"))


@query("softmax", sql("SELECT vec_id, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3 FROM prob4", "v6"))
def _(spark, d):
    return chunks(spark, d).select("vec_id", *[F.round(F.col("probabilities")[i], 9).alias(f"p{i}") for i in range(4)])


@query("chunk_probability_pooling", sql("""
, a AS (SELECT workload, class_id, avg(p) AS mean, max(p) AS max, count(*) AS num_chunks, list_avg(list_slice(list(p ORDER BY p DESC), 1, 3)) AS topk_mean FROM long4 GROUP BY ALL)
SELECT workload, class_id, round(mean, 6) AS mean, round(max, 6) AS max, num_chunks, round(topk_mean, 6) AS topk_mean, arg_max(class_id, (mean, -class_id)) OVER (PARTITION BY workload) AS pred_id FROM a""", "v6", "long4"))
def _(spark, d):
    return rounded(M.pool_chunks(chunks(spark, d)))


@query("topk_mean", sql("SELECT session_id, class_id, round(list_avg(list_slice(list(p ORDER BY p DESC), 1, 3)), 6) AS topk_mean FROM long4 GROUP BY ALL", "v6", "long4"))
def _(spark, d):
    rows = M.long_probabilities(chunks(spark, d).select("session_id", "probabilities"))
    return rounded(M.topk_mean(rows, ["session_id", "class_id"], "p", 3))


@query("no_window_default_predictions", sql("SELECT workload, class_id, round(mean, 6) AS mean, num_chunks, pred_id FROM full2", "v6", "pool2"))
def _(spark, d):
    return rounded(pooled2(spark, d).select("workload", "class_id", "mean", "num_chunks", "pred_id"))


@query("suspicious_rule", sql("""SELECT workload, pred_id, num_chunks, round(mining_mean, 6) AS mining_mean, round(mining_max, 6) AS mining_max, round(mining_topk, 6) AS mining_topk, suspicious, suspicious_reason FROM susp""", "v6", "pool2"))
def _(spark, d):
    return rounded(suspicious(spark, d))


def group_inputs(spark, d) -> DataFrame:
    pooled = pooled2(spark, d)
    probs = pooled.groupBy("workload").agg(F.array(F.max(F.when(F.col("class_id") == 0, F.col("mean"))), F.max(F.when(F.col("class_id") == 1, F.col("mean")))).alias("probabilities"))
    return suspicious(spark, d).join(probs, "workload").join(records(spark, d), "workload")


@query("group_predictions", sql("""
, w AS (SELECT f.workload, f.workload // 5 AS group_id, max(mean) FILTER (class_id = 0) AS q0, max(mean) FILTER (class_id = 1) AS q1 FROM full2 f GROUP BY ALL),
g AS (SELECT group_id, avg(q0) AS p0, avg(q1) AS p1, max(mining_max) AS mining_max, count(*) AS num_windows, bool_or(suspicious) AS any_s FROM w JOIN susp USING (workload) GROUP BY ALL)
SELECT 'any' AS policy, group_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(mining_max, 6) AS mining_max, num_windows, any_s AS suspicious, any_s::INT AS pred_id,
  CASE WHEN any_s THEN 'any_window_suspicious' ELSE 'all_windows_benign' END AS suspicious_reason FROM g
UNION ALL SELECT 'mean', group_id, round(p0, 6), round(p1, 6), round(mining_max, 6), num_windows, p1 >= 0.3, (p1 >= 0.3)::INT, CASE WHEN p1 >= 0.3 THEN 'mean_mining_probability>=0.3' ELSE 'mean_mining_probability<0.3' END FROM g""", "v6", "pool2"))
def _(spark, d):
    rows = group_inputs(spark, d)
    both = M.group_predictions(rows, 2, 1).withColumn("policy", F.lit("any")).unionByName(
        M.group_predictions(rows, 2, 1, "mean_mining_probability").withColumn("policy", F.lit("mean")))
    return rounded(both)


@query("mean_and_max_group_policy", sql("""
SELECT group_id, round(avg(p1), 6) AS mean, round(max(p1), 6) AS max, avg(p1) >= 0.3 AND max(p1) >= 0.5 AS suspicious FROM prob2 GROUP BY ALL""", "v6"))
def _(spark, d):
    rows = chunks(spark, d, 2).select("group_id", F.col("probabilities")[1].alias("p"))
    return rounded(M.mean_and_max_policy(rows, "group_id", "p"))


@query("suspicious_metrics", sql("""
, t AS (SELECT s.workload, s.suspicious, (s.workload % 4) = 3 AS truth FROM susp s)
, c AS (SELECT count(*) FILTER (truth AND suspicious) AS tp, count(*) FILTER (NOT truth AND suspicious) AS fp, count(*) FILTER (truth AND NOT suspicious) AS fn, count(*) FILTER (NOT truth AND NOT suspicious) AS tn FROM t)
SELECT label_id, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM (
  SELECT 1 AS label_id, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c
  UNION ALL SELECT 0, tn + fp, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END FROM c)""", "v6", "pool2"))
def _(spark, d):
    rows = suspicious(spark, d).join(records(spark, d), "workload").select(
        (F.col("label_id") == 3).cast("int").alias("truth"), F.col("suspicious").cast("int").alias("prediction"))
    return rounded(M.class_scores(M.confusion(rows, "truth", "prediction", [0, 1])).select("label_id", "support", "precision", "recall", "f1"))


SQL["truth"] = "truth AS (SELECT * FROM v5 WHERE truth IS NOT NULL)"


def judged(spark, d) -> DataFrame:
    return views.examples(spark, d).where(F.col("truth").isNotNull())


@query("confusion_matrix", sql("""
SELECT a AS truth, b AS prediction, (SELECT count(*) FROM truth t WHERE t.truth = a AND t.prediction = b) AS n FROM (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS b)""", "v5", "truth"))
def _(spark, d):
    return M.confusion(judged(spark, d), "truth", "prediction", [0, 1, 2])


SQL["scores"] = """
cls AS (SELECT c AS label_id, count(*) FILTER (truth = c) AS support, count(*) FILTER (prediction = c) AS predicted, count(*) FILTER (truth = c AND prediction = c) AS hits FROM truth, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c),
scores AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
  SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM cls))"""


@query("classification_report", sql("""
SELECT metric, label_id, round(value, 6) AS value FROM (
  SELECT label_id, unnest(['precision', 'recall', 'f1', 'support']) AS metric, unnest([precision, recall, f1, support::DOUBLE]) AS value FROM scores
  UNION ALL SELECT NULL, unnest(['accuracy', 'micro_f1', 'macro_f1', 'weighted_f1']), unnest([sum(hits) / sum(support), sum(hits) / sum(support), avg(f1) FILTER (support + predicted > 0), sum(f1 * support) / sum(support)]) FROM scores)""", "v5", "truth", "scores"))
def _(spark, d):
    return rounded(M.classification_report(M.confusion(judged(spark, d), "truth", "prediction", [0, 1, 2])))


@query("balanced_accuracy", sql("SELECT round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy FROM scores", "v5", "truth", "scores"))
def _(spark, d):
    return rounded(M.balanced_accuracy(M.confusion(judged(spark, d), "truth", "prediction", [0, 1, 2])))


@query("per_family_breakdown", sql("""
, l AS (SELECT family, string_agg(truth || '=' || n, ',' ORDER BY truth) AS labels FROM (SELECT family, truth, count(*) AS n FROM truth GROUP BY ALL) GROUP BY family),
p AS (SELECT family, string_agg(prediction || '=' || n, ',' ORDER BY prediction) AS predictions FROM (SELECT family, prediction, count(*) AS n FROM truth GROUP BY ALL) GROUP BY family)
SELECT t.family, count(*) AS examples, round(avg((truth = prediction)::INT), 6) AS accuracy, any_value(labels) AS labels, any_value(predictions) AS predictions
FROM truth t JOIN l USING (family) JOIN p USING (family) GROUP BY t.family""", "v5", "truth"))
def _(spark, d):
    return rounded(M.per_family(judged(spark, d).select("family", "truth", "prediction")))


@query("roc_auc_ovr", sql("""
, w AS (SELECT workload, class_id, label_id = class_id AS positive, avg(p) AS p FROM long4 GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY class_id ORDER BY p) + (count(*) OVER (PARTITION BY class_id, p) - 1) / 2.0::DOUBLE AS rk FROM w)
SELECT class_id, round((sum(rk) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)), 6) AS auc FROM r GROUP BY class_id""", "v6", "long4"))
def _(spark, d):
    rows = M.long_probabilities(chunks(spark, d).select("workload", "label_id", "probabilities"))
    mean = rows.groupBy("workload", "label_id", "class_id").agg(F.avg("p").alias("p"))
    return rounded(M.roc_auc_ovr(mean.select("class_id", "p", (F.col("label_id") == F.col("class_id")).alias("positive"))))


def runs(spark, d) -> DataFrame:
    rows = views.examples(spark, d)
    # thresholds are compared with these means exactly, so the examples of a group are summed in their order
    scores = rows.groupBy("group_id", "binary_label").agg(gathered(F.col("score"), F.col("workload")).alias("scores"))
    return scores.select("group_id", "binary_label", mean_in_order(F.col("scores")).alias("mean_mining_probability"))


SQL["runs5"] = "runs5 AS (SELECT group_id, binary_label, avg(score) AS p FROM v5 GROUP BY ALL)"
SQL["grid"] = """
cand AS (SELECT DISTINCT round(p, 4) AS t FROM runs5 UNION SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]::DOUBLE[])),
fired AS (SELECT t, count(*) AS runs, count(*) FILTER (p >= t) AS alarms, count(*) FILTER (binary_label = 'mining') AS m, count(*) FILTER (binary_label = 'benign') AS b,
  count(*) FILTER (binary_label = 'mining' AND p >= t) AS tp, count(*) FILTER (binary_label = 'benign' AND p >= t) AS fp FROM cand, runs5 GROUP BY t),
grid AS (SELECT t AS threshold, alarms, runs, (tp + b - fp) / runs AS accuracy, (tp / m + (b - fp) / b) / 2 AS balanced_accuracy, tp / m AS recall, fp / b AS fpr FROM fired)"""
GRID_COLS = "threshold, alarms, runs, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(recall, 6) AS recall, round(fpr, 6) AS fpr"


@query("threshold_grid_join", sql(f"SELECT {GRID_COLS} FROM grid", "v5", "runs5", "grid"))
def _(spark, d):
    return rounded(M.threshold_table(runs(spark, d)))


@query("tune_alarm_threshold", sql(f"""
SELECT {GRID_COLS}, 'balanced_accuracy_with_fpr_constraint' AS selection_metric FROM grid WHERE fpr <= 0.1 + 1e-12 ORDER BY grid.balanced_accuracy DESC, grid.accuracy DESC, grid.recall DESC, grid.fpr, threshold DESC LIMIT 1""", "v5", "runs5", "grid"))
def _(spark, d):
    return rounded(M.tune_alarm(runs(spark, d), 0.1))


@query("alarm_fires", sql("SELECT group_id, binary_label, p >= 0.5 AS fires, CASE WHEN p >= 0.5 THEN 'mining' ELSE 'benign' END AS run_prediction FROM runs5", "v5", "runs5"))
def _(spark, d):
    return M.alarm_fires(runs(spark, d), 0.5).select("group_id", "binary_label", "fires", "run_prediction")


@query("predictions_by_condition", sql("SELECT family || ':' || opt_level AS condition, prediction, count(*) AS n FROM v5 GROUP BY ALL", "v5"))
def _(spark, d):
    rows = views.examples(spark, d)
    return rows.groupBy(F.concat_ws(":", "family", "opt_level").alias("condition"), F.col("prediction").cast("long").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


SQL["roll"] = """
roll AS (SELECT *, mean >= 0.3 AND max >= 0.5 AS suspicious FROM (SELECT session_id, vec_id, row_number() OVER w - 1 AS nth, avg(p1) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS mean,
  max(p1) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS max, count(*) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS observed FROM prob2 WHERE vec_id % 6 <> 5
  WINDOW w AS (PARTITION BY session_id ORDER BY vec_id)))"""


def rolling(spark, d) -> DataFrame:
    """Rolling policy with every sixth window failed, so it has no score."""
    score = F.when(F.col("vec_id") % 6 != 5, F.col("probabilities")[1])
    return M.rolling_policy(chunks(spark, d, 2).select("session_id", "vec_id", score.alias("score")), "session_id", "vec_id")


@query("rolling_mean_max_policy", sql("SELECT session_id, vec_id, nth, observed, round(mean, 6) AS rolling_mean, round(max, 6) AS rolling_max, suspicious FROM roll", "v6", "roll"))
def _(spark, d):
    return rounded(rolling(spark, d).select("session_id", "vec_id", "nth", "observed", "rolling_mean", "rolling_max", "suspicious"))


TERMINAL = """
, f AS (SELECT session_id, min(nth) FILTER (suspicious) AS first FROM roll GROUP BY ALL)
SELECT session_id, vec_id, nth, suspicious, CASE WHEN suspicious THEN 'terminate' ELSE 'log' END AS action{} FROM roll JOIN f USING (session_id) WHERE first IS NULL OR nth <= first"""


@query("terminal_verdict", sql(TERMINAL.format(""), "v6", "roll"))
def terminal(spark, d):
    return M.terminal_verdicts(rolling(spark, d), "session_id").select("session_id", "vec_id", "nth", "suspicious", "action")


@query("verdict_sink", sql(TERMINAL.format(", CASE WHEN suspicious THEN 'terminate' ELSE 'logged' END AS delivery"), "v6", "roll"))
def _(spark, d):
    rows = terminal(spark, d)
    path = runner.stage(rows, "verdict-feed", files=3)
    out = scratch_dir(spark, "verdict-sink")
    verdicts = M.verdict_sink_rows(runner.stream_table(spark, path, rows.schema, files_per_trigger=1))
    runner.write_batches(verdicts, out).awaitTermination()
    return runner.read_batches(spark, out, verdicts.schema).drop("batch")
