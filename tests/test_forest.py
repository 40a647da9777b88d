"""The forest in a pipeline, saved and loaded."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

from framewatch.operators import ml
from framewatch.operators.forest import IsolationForest, IsolationForestModel


def table(spark, n=600):
    rng = random.Random(4)
    rows = [("b", i, rng.gauss(0, 1), rng.gauss(5, 2), rng.gauss(0, 1), "kept") for i in range(n)]
    rows[7] = ("b", 7, 40.0, -60.0, 30.0, "kept")
    return spark.createDataFrame(rows, "bus string, seq long, x double, y double, z double, label string")


def test_pipeline_gives_the_same_after_a_reload(spark, tmp_path):
    df = table(spark)
    forest = IsolationForest(featuresCol="pc", scoreCol="s", predictionCol="odd", numTrees=10, sampleSize=40, contamination=0.02)
    stages = [VectorAssembler(inputCols=["x", "y", "z"], outputCol="v"), StandardScaler(inputCol="v", outputCol="sv", withMean=True), PCA(k=2, inputCol="sv", outputCol="pc"), forest]
    fitted = Pipeline(stages=stages).fit(df)
    fitted.write().save(str(tmp_path / "m"))
    Pipeline(stages=stages).write().save(str(tmp_path / "p"))
    rows = lambda model: [(r.seq, r.s, r.odd, r.label) for r in model.transform(df).orderBy("seq").collect()]
    want = rows(fitted)
    other = spark.newSession()
    again = PipelineModel.read().session(other).load(str(tmp_path / "m"))
    assert isinstance(again.stages[-1], IsolationForestModel) and again.stages[-1].uid == fitted.stages[-1].uid
    assert rows(again) == want
    assert rows(Pipeline.load(str(tmp_path / "p")).fit(df)) == want
    assert 1 <= sum(r[2] for r in want) <= 30 and len({r[1] for r in want}) > 300 and want[0][3] == "kept"


def test_stage_is_the_function(spark):
    df = table(spark)
    v = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(df)
    staged = IsolationForest(numTrees=40, sampleSize=256).fit(v).transform(v).select("seq", "score").orderBy("seq").collect()
    plain = ml.isolation_forest_score(df, ml.isolation_forest_fit(df, ["x", "y", "z"], 40, 256)).select("seq", "score").orderBy("seq").collect()
    assert staged == plain
    assert min(staged, key=lambda r: r.score).seq == 7


def test_no_rows(spark):
    v = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(table(spark).filter("false"))
    assert IsolationForest(numTrees=3).fit(v).transform(v).count() == 0
