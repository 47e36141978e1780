"""Signature, coverage and Jaccard helpers; classifier metrics."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import explore, metrics, report
from lodestar.operators import rules as rl


def test_signature(spark):
    o = {"education": "HS-grad", "hours_per_week": 40, "age": 30, "n": 9}
    c = {"education": "Bachelors", "hours_per_week": 45, "age": 30, "n": 9.0}
    df = spark.createDataFrame([(json.dumps(o), json.dumps(c))], "original_features string, counterfactual_features string")
    assert df.select(explore.signature(df).alias("s")).first()["s"] == ["education", "hours_per_week"]


def test_coverage(spark):
    cfs = spark.createDataFrame([("m", "r", i % 96) for i in range(399)], "model_name string, run_id string, instance_id long")
    shap = spark.createDataFrame([("m", "r", i) for i in range(100)], "model_name string, run_id string, instance_id long")
    row = report.coverage(cfs, shap).first()
    assert row["coverage"] == pytest.approx(0.96)
    assert row["cfs_per_covered"] == pytest.approx(399 / 96)
    none = report.coverage(cfs.limit(0), shap.limit(0).union(spark.createDataFrame([], shap.schema)))
    assert none.count() == 0


def test_coverage_zero_attempts(spark):
    cfs = spark.createDataFrame([("m", "r", 1)], "model_name string, run_id string, instance_id long")
    shap = spark.createDataFrame([], "model_name string, run_id string, instance_id long")
    row = report.coverage(cfs, shap).first()
    assert row["coverage"] is None


@pytest.mark.parametrize("a,b,expected", [
    (["capital_gain tends to increase (avg normalized delta +0.857)"],
     ["capital_gain tends to increase (avg normalized delta +0.100)"], 1.0),
    (["a changes (90% of cluster)", "b changes (80% of cluster)"], ["a changes (100% of cluster)", "c x"], 1 / 3),
    (["a"], ["b"], 0.0),
    ([], [], 0.0),
])
def test_jaccard(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    got = df.select(rl.jaccard(rl.condition_tokens(F.col("a")), rl.condition_tokens(F.col("b"))).alias("j")).first()["j"]
    assert got == pytest.approx(expected)


def test_quality_weights():
    with pytest.raises(ValueError):
        rl.check_weights(0.5, 0.5, 0.5)


def test_perfect_classifier(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.8), (1, 1, 0.9), (0, 0, 0.2)], "target int, prediction int, p1 double")
    af = metrics.accuracy_f1(df).first()
    assert (af["accuracy"], af["f1"]) == (1.0, 1.0)
    assert metrics.roc_auc(df).first()["roc_auc"] == 1.0


def test_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from lodestar.plans import context as ctx
    scored = ctx.scored_cases(spark, "/root/testdata/sf0.001")
    ours = metrics.roc_auc(scored).first()["roc_auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="p1", labelCol="target", metricName="areaUnderROC", numBins=0)
    theirs = ev.evaluate(scored.withColumn("target", F.col("target").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_best_trial(spark):
    t = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7), (3, None)], "trial int, metric_value double")
    row = metrics.best_trial(t).first()
    assert (row["best_trial"], row["best_value"], row["completed_trials"]) == (1, 0.7, 3)
    low = metrics.best_trial(t, direction="minimize").first()
    assert low["best_trial"] == 0
    with pytest.raises(ValueError):
        metrics.best_trial(t, direction="sideways")
