"""Forests grow on counted cells: the whole table counts, draws are a bootstrap's, and scores are those of the engine's trees."""

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from launchlake.operators import counters as N
from launchlake.operators import forest, ml


def sample(spark, n):
    rows = spark.range(n).select("id", (F.rand(3) * 9).cast("int").cast("double").alias("a"), (F.rand(4) * 7).cast("int").cast("double").alias("b"), F.rand(5).alias("c"))
    return rows.withColumn("label_id", (((F.col("a") > 4) != (F.col("b") > 2)) != (F.rand(6) < 0.1)).cast("double"))


def test_equal_rows_are_one_cell_and_none_is_lost(spark):
    rows = sample(spark, 4000)
    edges = forest.bin_edges(rows, ["a", "b"])
    assert [list(e) for e in edges] == [[i + 0.5 for i in range(8)], [i + 0.5 for i in range(6)]]
    cells = forest.counted_cells(rows, ["a", "b"], "label_id", edges, 4000, 2).toPandas()
    assert len(cells) <= 9 * 7 * 2 and cells["n"].sum() == 4000
    assert not cells.duplicated(["f0", "f1", "label"]).any()
    fine = forest.bin_edges(rows, ["a", "b", "c"])
    assert len(fine[2]) == forest.MAX_BINS - 1
    assert forest.counted_cells(rows, ["a", "b", "c"], "label_id", fine, 4000, 2).count() == 4000


def test_draws_of_a_cell_are_poisson_and_come_again():
    key = np.arange(200_000, dtype=np.uint32) * np.uint32(2654435761)
    for n in (1, 3, 16, 40, 900):
        count = np.full(len(key), n)
        drawn = forest.draws(count, key, 7)
        assert abs(drawn.mean() / n - 1) < 0.01 and abs(drawn.var() / n - 1) < 0.03
        assert (drawn == forest.draws(count, key, 7)).all()
        assert abs(np.corrcoef(drawn, forest.draws(count, key, 8))[0, 1]) < 0.01


def test_forest_is_as_good_as_the_engines_and_grown_without_its_fit(spark):
    rows = sample(spark, 4000)
    model = ml.fit_forest(rows, ["a", "b", "c"], trees=12, depth=6)
    root = model.stages[1].trees[0]
    # the trees have seen the whole table: a bootstrap of n rows has about n
    assert 3700 < root._call_java("rootNode").impurityStats().count() < 4300
    right = lambda scored: scored.where((F.col("prediction") == "mining") == (F.col("label_id") == 1)).count() / 4000
    old = RandomForestClassifier(labelCol="label_id", numTrees=12, maxDepth=6, seed=5).fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows))
    theirs = old.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)).where(F.col("prediction") == F.col("label_id")).count() / 4000
    assert right(ml.apply_model(model, rows)) > theirs - 0.02


def test_a_split_has_the_largest_gain():
    rnd = np.random.default_rng(1)
    total = rnd.integers(0, 5, (2, 6, 4, 2))
    total[1] = total[0][:, ::-1]  # both drawn features count the same rows
    weight = np.array([0.7, 1.6])
    j, b, gain, left, whole = forest.best_splits(total, weight)
    gini = lambda c: 1 - ((c * weight / max((c * weight).sum(), 1e-9)) ** 2).sum()
    for node in range(6):
        every = total[0, node].sum(axis=0)
        tried = {}
        for f in range(2):
            for cut in range(4):
                one = total[f, node, :cut + 1].sum(axis=0)
                other = every - one
                if one.sum() and other.sum():
                    size = (every * weight).sum()
                    tried[f, cut] = gini(every) - (one * weight).sum() / size * gini(one) - (other * weight).sum() / size * gini(other)
        assert abs(gain[node] - max(tried.values())) < 1e-9 and abs(tried[j[node], b[node]] - gain[node]) < 1e-9
        assert (whole[node] == every).all() and (left[node] == total[j[node], node, :b[node] + 1].sum(axis=0)).all()


def test_points_are_scored_once(spark):
    rows = sample(spark, 300).withColumns({"run_id": F.col("id") % 3, "timestamp_ns": F.col("id") * 1_000_000_000, "binary_label": F.lit("mining")})
    model = ml.fit_forest(rows, ["a", "b"], trees=3, depth=2)
    plan = N.run_alarms(ml.apply_model(model, N.in_run_order(rows)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
