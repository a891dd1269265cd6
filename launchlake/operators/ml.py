"""Forests on counter features and n-gram classifiers on rendered text."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlake.operators import counters as N
from launchlake.operators import forest
from launchlake.operators import metrics as M
from launchlake.session import materialize, scratch_dir

SEED = 1337
# Training looks at a count per cell of rows and tree; at so many of them in a round, the other trees follow in rounds of their own.
# None of them is kept, so this only bounds the length of a round's jobs.
COUNTS_AT_ONCE = 50_000_000_000
MAX_DEPTH = 30  # the deepest tree the engine can hold


def balanced_weights(rows: DataFrame, label: str = "label_id") -> DataFrame:
    """Add ``weight`` = rows / (classes * rows of the class)."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, pick = sum(counts.values()), F.lit(None).cast("double")
    for value, n in counts.items():
        pick = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(pick)
    return rows.withColumn("weight", pick)


def fit_forest(train: DataFrame, features: Sequence[str], trees: int = 200, depth: int = MAX_DEPTH, seed: int = SEED,
               counts_at_once: int = COUNTS_AT_ONCE) -> PipelineModel:
    """Class-balanced random forest over complete feature rows; trees grow until they are pure or as deep as the engine allows.

    Trees grow on counts of binned rows (``forest``), level by level. With more than ``counts_at_once`` counts they do so in
    several rounds over all rows. The trees of all rounds are one forest: ``apply_model`` adds up their votes.
    """
    spark = train.sparkSession
    seen = {int(r["label_id"]): r["n"] for r in train.groupBy("label_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    count, classes = sum(seen.values()), max(2, max(seen, default=0) + 1)
    weight = np.array([count / (len(seen) * seen[i]) if i in seen else 0.0 for i in range(classes)])
    edges = forest.bin_edges(train, features)
    cells = forest.counted_cells(train, features, "label_id", edges, count, classes)
    drawn = len(features) if trees == 1 else math.ceil(math.sqrt(len(features)))  # features a node may split at
    each = min(trees, max(1, counts_at_once // max(1, cells.count())))
    sizes = [min(each, trees - at) for at in range(0, trees, each)]
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    blank = spark.createDataFrame([(Vectors.dense([float(i)] * len(features)), float(i), 1.0) for i in range(classes)], ["features", "label_id", "weight"]).coalesce(1)
    forests = []
    for i, size in enumerate(sizes):
        end = f"_{i}" if len(sizes) > 1 else ""
        # the engine writes a forest of stumps with these settings, its nodes are replaced by those grown, and it reads the forest
        stumps = RandomForestClassifier(
            featuresCol="features", labelCol="label_id", weightCol="weight", numTrees=size, maxDepth=depth, seed=seed + i,
            rawPredictionCol=f"rawPrediction{end}", probabilityCol=f"probability{end}", predictionCol=f"prediction{end}").fit(blank)
        path = scratch_dir(spark, "forest")
        stumps.write().save(path)
        nodes = forest.grow(cells, range(i * each, i * each + size), drawn, edges, weight, depth, seed)
        spark.createDataFrame(nodes).repartition("treeID").write.mode("overwrite").parquet(f"{path}/data")
        forests.append(RandomForestClassificationModel.load(path))
    return PipelineModel(stages=[assembler, *forests])


def fit_ngrams(train: DataFrame, text: str = "text", n: int = 2, buckets: int = 1 << 20, rounds: int = 200, tolerance: float = 1e-6) -> PipelineModel:
    """Class-weighted linear model on hashed token n-grams.

    A round shuffles one sum of ``buckets`` numbers per partition, so there are no more partitions than cores, however large the table.
    """
    stages = [
        SQLTransformer(statement=f"SELECT *, filter(split(replace({text}, ',', ' , '), '\\\\s+'), t -> t <> '') AS tokens FROM __THIS__"),
        NGram(n=n, inputCol="tokens", outputCol="grams"),
        HashingTF(inputCol="grams", outputCol="features", numFeatures=buckets),
        LogisticRegression(featuresCol="features", labelCol="label_id", weightCol="weight", maxIter=rounds, tol=tolerance)]
    return Pipeline(stages=stages).fit(balanced_weights(train).coalesce(train.sparkSession.sparkContext.defaultParallelism))


def _walk(model: PipelineModel, forests: Sequence[RandomForestClassificationModel], spark: SparkSession) -> forest.Walk:
    tables, depth = [], 0
    for part in forests:
        path = scratch_dir(spark, "forest")
        part.write().save(path)
        tables.append(spark.read.parquet(f"{path}/data").toArrow())
        depth = max(depth, part.getMaxDepth())
    return forest.walk_of(tables, len(model.stages[0].getInputCols()), depth)


def apply_model(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``probabilities``, ``prediction`` and ``mining_probability``."""
    forests = [s for s in model.stages if isinstance(s, RandomForestClassificationModel)]
    if forests:
        # a forest's votes are the sum over the trees of all its parts
        out = forest.score(rows, _walk(model, forests, rows.sparkSession), model.stages[0].getInputCols())
    else:
        out = model.transform(rows).withColumn("probabilities", vector_to_array("probability"))
    drop = [c for c in ("features", "rawPrediction", "probability", "tokens", "grams") if c in out.columns]
    return out.drop(*drop).withColumns({
        "mining_probability": F.col("probabilities")[1],
        "prediction": F.when(F.col("prediction") == 1, "mining").otherwise("benign")})


def label_id(binary: Column | str = "binary_label") -> Column:
    return (F.col(binary) if isinstance(binary, str) else binary).eqNullSafe("mining").cast("double")


def _fit(windows: DataFrame, candidates: Sequence[str], trees: int, depth: int) -> tuple[PipelineModel, DataFrame]:
    """A forest of the train split, and the complete rows of every split."""
    rows = windows.where(F.col("binary_label").isin("benign", "mining"))
    features = N.usable_features(rows, candidates)
    rows = N.complete_rows(rows, features).withColumn("label_id", label_id())
    return fit_forest(rows.where(F.col("split") == "train"), features, trees, depth), rows


def train_window_forest(windows: DataFrame, candidates: Sequence[str], trees: int = 200, depth: int = MAX_DEPTH) -> tuple[PipelineModel, DataFrame]:
    """Fit on the train split of window features; predictions for every split."""
    model, rows = _fit(windows, candidates, trees, depth)
    return model, apply_model(model, rows)


def _run_alarms(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows are put in order before they are scored, so a row is scored once; a run is one row of a written table."""
    return materialize(N.run_alarms(apply_model(model, N.in_run_order(rows))), "runs")


def train_point_forest(points: DataFrame, candidates: Sequence[str], max_fpr: float = 0.01, trees: int = 200,
                       depth: int = MAX_DEPTH) -> tuple[PipelineModel, float, DataFrame]:
    """Forest on raw samples, run roll-up, alarm threshold tuned on validation runs."""
    model, rows = _fit(points, candidates, trees, depth)
    runs = _run_alarms(model, rows).join(rows.select("run_id", "split").distinct(), "run_id")
    tuned = M.tune_alarm(runs.where(F.col("split") == "val"), max_fpr).first()
    if tuned is None or tuned["runs"] is None:
        tuned = M.tune_alarm(runs.where(F.col("split") == "train"), max_fpr).first()
    threshold = float(tuned["threshold"])
    return model, threshold, M.alarm_fires(runs, threshold)


def score_points(model: PipelineModel, points: DataFrame, features: Sequence[str], threshold: float) -> DataFrame:
    """Apply a saved model to complete rows and raise run alarms."""
    return M.alarm_fires(_run_alarms(model, N.complete_rows(points, features)), threshold)


__all__ = ["apply_model", "balanced_weights", "fit_forest", "fit_ngrams", "label_id", "score_points", "train_point_forest", "train_window_forest"]
