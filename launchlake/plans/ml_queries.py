"""Model training and scoring queries. Trees depend on the engine: rows only."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlake.operators import counters as N
from launchlake.operators import dataset as D
from launchlake.operators import ml
from launchlake.plans import views
from launchlake.plans.counter_queries import SPEC
from launchlake.plans.dataset_queries import split_examples
from launchlake.plans.registry import query
from launchlake.session import materialize, scratch_dir

# The labels of this view have nothing to do with its features, so trees without a limit would only grow to one leaf per sample.
DEPTH = 10

WINDOW_FEATURES = [f"{m}_{s}" for m in N.DEVICE_METRICS for s in ("mean", "std", "min", "max", "median", "p95")]


def with_split(rows: DataFrame) -> DataFrame:
    labelled = rows.withColumns({"binary_label": F.when(F.col("run_id") % 3 == 0, "mining").otherwise("benign"), "group_id": F.col("run_id")})
    # training passes over its input many times: compute the features once
    return materialize(D.grouped_split_simple(labelled), "features")


def confusion(scored: DataFrame) -> DataFrame:
    return scored.groupBy("split", F.col("binary_label").alias("truth"), "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("train_window_forest")
def _(spark, d):
    windows = N.device_windows(views.device_samples(spark, d), SPEC)
    _, scored = ml.train_window_forest(with_split(windows), WINDOW_FEATURES, depth=DEPTH)
    return confusion(scored)


@query("train_point_forest")
def _(spark, d):
    points = with_split(N.device_points(views.device_samples(spark, d)))
    _, _, runs = ml.train_point_forest(points, N.DEVICE_METRICS, depth=DEPTH)
    return runs.select("split", "run_id", "binary_label", "sample_count", "mean_mining_probability", "run_prediction")


@query("score_points")
def _(spark, d):
    points = with_split(N.device_points(views.device_samples(spark, d)))
    model, threshold, _ = ml.train_point_forest(points, N.DEVICE_METRICS, depth=DEPTH)
    path = scratch_dir(spark, "point-model")
    model.write().overwrite().save(path)
    features = model.stages[0].getInputCols()
    return ml.score_points(PipelineModel.load(path), points, features, threshold).select(
        "run_id", "sample_count", "mean_mining_probability", "run_prediction")


def text_examples(spark, d) -> DataFrame:
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("workload"), "text")
    rows = docs.join(split_examples(spark, d).select("workload", "split", "binary_label", "family"), "workload")
    return materialize(rows.withColumn("label_id", ml.label_id()), "examples")


@query("train_sequence_classifier")
def _(spark, d):
    rows = text_examples(spark, d)
    model = ml.fit_ngrams(rows.where(F.col("split") == "train"))
    return confusion(ml.apply_model(model, rows))


@query("score_windows")
def _(spark, d):
    rows = text_examples(spark, d)
    model = ml.fit_ngrams(rows.where(F.col("split") == "train"))
    return ml.apply_model(model, rows).select("workload", "split", F.col("probabilities")[0].alias("p0"), F.col("probabilities")[1].alias("p1"), "prediction")
