"""Pooling, verdict policies, evaluation reports and alarm tuning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchlake.operators import ordered

# Defaults of the suspicious rule and the rolling policy.
MAX_THRESHOLD = 0.90
TOPK_THRESHOLD = 0.75
TOP_K = 3
ROLLING_WINDOWS = 8
ROLLING_MEAN = 0.30
ROLLING_MAX = 0.50
# Alarm thresholds that are always tried.
ALARM_GRID = [0.0, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95]


def softmax(logits: Column | str) -> Column:
    """Max-shifted softmax of an array."""
    xs = F.col(logits) if isinstance(logits, str) else logits
    exps = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda e: e / total)


def long_probabilities(chunks: DataFrame, column: str = "probabilities") -> DataFrame:
    rest = [c for c in chunks.columns if c != column]
    return chunks.select(*rest, F.posexplode(column).alias("class_id", "p"))


def topk_mean(rows: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Mean of the k largest values; the rank filter runs before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value)))
    return rows.withColumn("_r", rank).where(F.col("_r") <= max(1, k)).groupBy(*keys).agg(F.avg(value).alias("topk_mean"))


def pool_chunks(chunks: DataFrame, k: int = TOP_K) -> DataFrame:
    """(workload, class_id, mean, max, topk_mean, num_chunks, pred_id)."""
    rows = long_probabilities(chunks.select("workload", "probabilities"))
    keys = ["workload", "class_id"]
    base = rows.groupBy(*keys).agg(F.avg("p").alias("mean"), F.max("p").alias("max"), F.count(F.lit(1)).alias("num_chunks"))
    pooled = base.join(topk_mean(rows, keys, "p", k), keys)
    best = pooled.groupBy("workload").agg((-F.max(F.struct("mean", (-F.col("class_id")).alias("c")))["c"]).alias("pred_id"))
    return pooled.join(best, "workload")


def no_window_defaults(records: DataFrame, pooled: DataFrame, n_labels: int, benign_id: int) -> DataFrame:
    """One-hot benign pooling rows for workloads without any chunk."""
    bare = records.select("workload").join(pooled.select("workload").distinct(), "workload", "left_anti")
    one = (F.col("class_id") == benign_id).cast("double")
    return bare.withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(n_labels - 1)))).select(
        "workload", "class_id", one.alias("mean"), one.alias("max"), F.lit(0).cast("long").alias("num_chunks"), one.alias("topk_mean"),
        F.lit(benign_id).alias("pred_id"))


def suspicious_rule(pooled: DataFrame, mining_id: int, top_k: int = TOP_K, max_threshold: float = MAX_THRESHOLD,
                    topk_threshold: float = TOPK_THRESHOLD) -> DataFrame:
    """Verdict per workload from the mining row of its pooling table."""
    rows = pooled.where(F.col("class_id") == mining_id)
    k = F.least(F.lit(max(1, top_k)), F.greatest(F.lit(1), F.col("num_chunks")))
    by_mean, by_max, by_top = F.col("pred_id") == mining_id, F.col("max") >= max_threshold, F.col("topk_mean") >= topk_threshold
    reason = (F.when(by_mean, "mean_pooling_decision").when(by_max, f"max_p_mining>={max_threshold:g}")
              .when(by_top, F.concat(F.lit("top"), k.cast("string"), F.lit(f"_mean_p_mining>={topk_threshold:g}"))).otherwise("below_threshold"))
    return rows.select(
        "workload", "pred_id", "num_chunks", F.col("mean").alias("mining_mean"), F.col("max").alias("mining_max"),
        F.col("topk_mean").alias("mining_topk"), (by_mean | by_max | by_top).alias("suspicious"), reason.alias("suspicious_reason"))


def group_predictions(windows: DataFrame, n_labels: int, mining_id: int, policy: str = "any_window_suspicious",
                      threshold: float = ROLLING_MEAN) -> DataFrame:
    """Window predictions rolled up per group.

    ``windows`` has group_id, workload, mean probabilities ``probabilities``,
    ``suspicious`` and ``mining_max``. Window lists are not collected; join
    back on ``group_id`` where they are wanted.
    """
    if policy not in ("any_window_suspicious", "mean_mining_probability"):
        raise ValueError(f"unsupported group policy: {policy}")
    out = windows.groupBy("group_id").agg(
        *[F.avg(F.col("probabilities")[i]).alias(f"p{i}") for i in range(n_labels)], F.max("mining_max").alias("mining_max"),
        F.bool_or("suspicious").alias("any_suspicious"), F.count(F.lit(1)).alias("num_windows"))
    mean = F.col(f"p{mining_id}")
    suspicious = (mean >= threshold) if policy == "mean_mining_probability" else F.col("any_suspicious")
    others = [i for i in range(n_labels) if i != mining_id] or [mining_id]
    best = -F.greatest(*[F.struct(F.col(f"p{i}").alias("p"), F.lit(-i).alias("c")) for i in others])["c"] if len(others) > 1 else F.lit(others[0])
    texts = (f"mean_mining_probability>={threshold:g}", f"mean_mining_probability<{threshold:g}") if policy == "mean_mining_probability" else (
        "any_window_suspicious", "all_windows_benign")
    return out.select(
        "group_id", *[f"p{i}" for i in range(n_labels)], "mining_max", "num_windows", suspicious.alias("suspicious"),
        F.when(suspicious, F.lit(mining_id)).otherwise(best).alias("pred_id"), F.when(suspicious, texts[0]).otherwise(texts[1]).alias("suspicious_reason"))


def mean_and_max_policy(scores: DataFrame, key: str, score: str, mean_threshold: float = ROLLING_MEAN, max_threshold: float = ROLLING_MAX) -> DataFrame:
    out = scores.groupBy(key).agg(F.avg(score).alias("mean"), F.max(score).alias("max"))
    return out.withColumn("suspicious", (F.col("mean") >= mean_threshold) & (F.col("max") >= max_threshold))


def rolling_policy(windows: DataFrame, key: str, order: str, score: str = "score", count: int = ROLLING_WINDOWS,
                   mean_threshold: float = ROLLING_MEAN, max_threshold: float = ROLLING_MAX, width: int = 4096) -> DataFrame:
    """Mean and max over the last ``count`` scores of a session, in window order.

    Windows without a score are skipped. Long sessions run in slices that
    repeat the last ``count - 1`` rows of the slice before.
    """
    rows = ordered.ordinal(windows.where(F.col(score).isNotNull()), [key], [order], [ordered.bucket_of(order)], "nth")
    width = max(width, count)  # a slice must cover the rows it passes on
    own = ordered.bucket_of("nth", width)
    late = F.col("nth") % width > width - count
    rows = rows.withColumn("_own", own).withColumn("_b", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    last = Window.partitionBy(key, "_b").orderBy("nth").rowsBetween(-(count - 1), 0)
    rows = rows.withColumns({"observed": F.count(score).over(last), "rolling_mean": F.avg(score).over(last), "rolling_max": F.max(score).over(last)})
    rows = rows.where(F.col("_own") == F.col("_b")).drop("_own", "_b")
    suspicious = (F.col("rolling_mean") >= mean_threshold) & (F.col("rolling_max") >= max_threshold)
    return rows.withColumns({"suspicious": suspicious, "reason": F.when(suspicious, "rolling_mean_and_max").otherwise("below_rolling_mean_or_max_threshold"),
                             "action": F.when(suspicious, "terminate").otherwise("log")})


def terminal_verdicts(verdicts: DataFrame, key: str) -> DataFrame:
    """Verdicts up to and including the first suspicious one of each session."""
    first = verdicts.where("suspicious").groupBy(key).agg(F.min("nth").alias("_first"))
    rows = verdicts.join(first, key, "left")
    return rows.where(F.col("_first").isNull() | (F.col("nth") <= F.col("_first"))).drop("_first")


def verdict_sink_rows(verdicts: DataFrame, enforce: bool = True) -> DataFrame:
    """Add ``delivery``: only enforced, suspicious verdicts leave the log."""
    send = F.col("suspicious") if enforce else F.lit(False)
    return verdicts.withColumn("delivery", F.when(send, "terminate").otherwise("logged"))


# ---- evaluation ------------------------------------------------------------

def confusion(rows: DataFrame, truth: str, prediction: str, labels: Sequence[int]) -> DataFrame:
    """(truth, prediction, n) for every pair of labels, zeros included."""
    ids = F.array(*[F.lit(x) for x in labels]).cast("array<bigint>")
    counts = rows.groupBy(F.col(truth).cast("long").alias("truth"), F.col(prediction).cast("long").alias("prediction")).agg(F.count(F.lit(1)).alias("c"))
    zero = rows.sparkSession.range(1).select(F.explode(ids).alias("truth")).select("truth", F.explode(ids).alias("prediction"))
    return zero.join(counts, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("c", F.lit(0)).alias("n"))


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class of a confusion table."""
    sides = matrix.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label_id"), F.lit(0).alias("role"), "n"), F.struct(F.col("prediction").alias("label_id"), F.lit(1).alias("role"), "n"),
        F.struct(F.when(F.col("truth") == F.col("prediction"), F.col("truth")).alias("label_id"), F.lit(2).alias("role"), "n"))).alias("s")).select("s.*")
    total = lambda r: F.sum(F.when(F.col("role") == r, F.col("n")).otherwise(0))
    per = sides.where(F.col("label_id").isNotNull()).groupBy("label_id").agg(
        total(0).alias("support"), total(1).alias("predicted"), total(2).alias("hits"))
    p, r = _safe(F.col("hits"), F.col("predicted")), _safe(F.col("hits"), F.col("support"))
    per = per.withColumns({"precision": p, "recall": r})
    return per.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_report(matrix: DataFrame) -> DataFrame:
    """(metric, label_id, value) with accuracy and macro, micro, weighted F1.

    The macro mean covers the labels present in truth or prediction.
    """
    per = class_scores(matrix)
    long = per.select("label_id", F.explode(F.create_map(*[x for m in ("precision", "recall", "f1", "support") for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    total = per.agg((F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"),
                    (F.sum("hits") / F.sum("support")).alias("micro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    summary = total.select(F.explode(F.create_map(*[x for m in ("accuracy", "macro_f1", "micro_f1", "weighted_f1") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    return long.select("metric", "label_id", "value").unionByName(summary.withColumn("label_id", F.lit(None).cast("long")).select("metric", "label_id", "value"))


def balanced_accuracy(matrix: DataFrame) -> DataFrame:
    return class_scores(matrix).where(F.col("support") > 0).agg(F.avg("recall").alias("balanced_accuracy"))


def roc_auc_ovr(scores: DataFrame) -> DataFrame:
    """One-vs-rest area per class from (class_id, p, positive) rows.

    Scores are counted per distinct value, and the negatives below each value
    come from a bucketed running total, so a class is never one sort.
    """
    counts = scores.groupBy("class_id", "p").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    run = ordered.running_totals(counts, ["class_id"], ["p"], [F.floor(F.col("p") * 4096).cast("long")], {"neg_upto": F.col("neg")})
    area = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    out = run.groupBy("class_id").agg(area.alias("area"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return out.select("class_id", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("area") / (F.col("pos") * F.col("neg"))).alias("auc"))


def per_family(rows: DataFrame) -> DataFrame:
    """Examples, accuracy, and label and prediction counts per family."""
    counts = rows.groupBy("family", "truth", "prediction").agg(F.count(F.lit(1)).alias("n"))
    base = counts.groupBy("family").agg(F.sum("n").alias("examples"), F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)).alias("_ok"))

    def spread(column: str, name: str) -> DataFrame:
        per = counts.groupBy("family", column).agg(F.sum("n").alias("n"))
        text = F.transform(F.array_sort(F.collect_list(F.struct(column, "n"))), lambda x: F.concat_ws("=", x[column].cast("string"), x["n"]))
        return per.groupBy("family").agg(F.array_join(text, ",").alias(name))

    out = base.join(spread("truth", "labels"), "family").join(spread("prediction", "predictions"), "family")
    return out.withColumn("accuracy", F.col("_ok") / F.col("examples")).drop("_ok")


def threshold_table(runs: DataFrame, truth: str = "binary_label", score: str = "mean_mining_probability") -> DataFrame:
    """Outcome of every candidate threshold over all runs.

    Runs are counted per distinct score and candidates enter as empty counts;
    one bucketed running total from the top gives what fires at each.
    """
    p = F.coalesce(F.col(score), F.lit(0.0))
    hist = runs.select(p.alias("v"), (F.col(truth) == "mining").cast("int").alias("m"), (F.col(truth) == "benign").cast("int").alias("b"))
    hist = hist.groupBy("v").agg(F.sum("m").alias("m"), F.sum("b").alias("b"))
    # the grid is small and rounded scores have at most four decimals
    tried = hist.select(F.round("v", 4).alias("v")).union(
        runs.sparkSession.createDataFrame([(x,) for x in ALARM_GRID], "v double")).distinct()
    tried = tried.select("v", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("b"), F.lit(1).alias("t"))
    rows = hist.withColumn("t", F.lit(0)).unionByName(tried).groupBy("v").agg(F.sum("m").alias("m"), F.sum("b").alias("b"), F.max("t").alias("t"))
    rows = ordered.running_totals(rows, [], [F.desc("v")], [-F.floor(F.col("v") * 1024).cast("long")], {"mining_fired": F.col("m"), "benign_fired": F.col("b")})
    total = hist.agg(F.sum("m").alias("mining"), F.sum("b").alias("benign"))
    rows = rows.where(F.col("t") == 1).crossJoin(F.broadcast(total))  # one row
    c = F.col
    recall, fpr = _safe(c("mining_fired"), c("mining")), _safe(c("benign_fired"), c("benign"))
    both = (c("mining") > 0).cast("int") + (c("benign") > 0).cast("int")
    specificity = F.when(c("benign") > 0, (c("benign") - c("benign_fired")) / c("benign")).otherwise(0.0)
    return rows.select(
        c("v").alias("threshold"), (c("mining_fired") + c("benign_fired")).alias("alarms"), (c("mining") + c("benign")).alias("runs"),
        ((c("mining_fired") + c("benign") - c("benign_fired")) / (c("mining") + c("benign"))).alias("accuracy"),
        ((recall + specificity) / both).alias("balanced_accuracy"), recall.alias("recall"), fpr.alias("fpr"))


def tune_alarm(runs: DataFrame, max_fpr: float | None = 0.01, **columns: str) -> DataFrame:
    """Best threshold under the false-alarm limit, else the least false alarms."""
    table = threshold_table(runs, **columns)
    ok = F.lit(True) if max_fpr is None else F.col("fpr") <= max_fpr + 1e-12
    minus = -F.col("fpr")
    rank = F.struct(
        ok.alias("ok"), F.when(ok, F.col("balanced_accuracy")).otherwise(minus).alias("a"), F.when(ok, F.col("accuracy")).otherwise(F.col("balanced_accuracy")).alias("b"),
        F.when(ok, F.col("recall")).otherwise(F.col("accuracy")).alias("c"), F.when(ok, minus).otherwise(F.col("recall")).alias("d"), F.col("threshold"))
    best = table.agg(F.max_by(F.struct(*[F.col(c) for c in table.columns], ok.alias("ok")), rank).alias("t")).select("t.*")
    metric = F.when(F.col("ok"), "balanced_accuracy_with_fpr_constraint").otherwise("fallback_lowest_fpr_then_balanced_accuracy")
    return best.withColumn("selection_metric", metric).drop("ok")


def alarm_fires(runs: DataFrame, threshold: float, score: str = "mean_mining_probability") -> DataFrame:
    fires = F.coalesce(F.col(score), F.lit(0.0)) >= threshold
    return runs.withColumns({"fires": fires, "run_prediction": F.when(fires, "mining").otherwise("benign")})
