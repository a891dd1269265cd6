"""A forest grown in several fits is one forest, and a fit writes no node ids."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from launchlake.operators import ml


def test_trees_of_several_fits_vote_together(spark, tmp_path):
    rows = spark.range(600).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("label_id", (F.col("a") + F.col("b") > 1).cast("double"))
    model = ml.fit_forest(rows, ["a", "b"], trees=10, depth=4, counts_at_once=600 * 3)
    forests = model.stages[1:]
    assert [f.getNumTrees for f in forests] == [3, 3, 3, 1]
    assert not any(f.getCacheNodeIds() for f in forests)
    model.write().save(str(tmp_path / "forest"))
    scored = ml.apply_model(PipelineModel.load(str(tmp_path / "forest")), rows)
    assert set(scored.columns) == {
        "id", "a", "b", "label_id", "prediction", "probabilities", "mining_probability"}
    features = model.stages[0].transform(rows).orderBy("id").limit(20).collect()
    got = {r.id: r for r in scored.collect()}
    for r in features:
        votes = sum((f.predictRaw(r.features).toArray() for f in forests), 0)
        assert abs(votes.sum() - 10) < 1e-9
        assert abs(got[r.id].mining_probability - votes[1] / 10) < 1e-9
        assert got[r.id].prediction == ("mining" if votes[1] > votes[0] else "benign")
    assert len(ml.fit_forest(rows, ["a", "b"], trees=10, depth=4).stages) == 2
