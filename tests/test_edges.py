"""Adversarial inputs: exact formatting, JSON equality, ids, missing
stores, saturated scores, errors of the report and of the explainers."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions.columns import clean_category, signed3, wide_id
from lodestar.operators import attribution as attr
from lodestar.operators import encode as enc
from lodestar.operators import explore, metrics, report
from lodestar.operators import model as mdl
from lodestar.operators import prepare as prep
from lodestar.operators import search as S
from lodestar.plans import context as ctx
from lodestar.sources import files, store

SMALL = "/root/testdata/sf0.001"


def test_signed3_is_python_formatting(spark):
    rnd = random.Random(3)
    xs = [0.0025, 0.1235, -0.0025, 0.0005, 0.0015, 0.5, 1.0005, 2.5e-4, -1e-5, 12.3456, 0.0, 1 / 3, 1234.5675]
    xs += [i / 2000 for i in range(-300, 300)] + [rnd.uniform(-2, 2) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", signed3("x").alias("s"))
    assert [(r.x, r.s) for r in df.collect()] == [
        (x, f"{x:+.3f}" if not (x < 0 and f"{x:+.3f}" == "-0.000") else "-0.000") for x in xs]


def test_all_white_space_is_stripped(spark):
    df = spark.createDataFrame([("\t a b\n\x0b ",), ("  ",)], "x string")
    assert [r[0] for r in df.select(clean_category("x")).collect()] == ["a b", ""]


@pytest.mark.parametrize("a,b,changed", [
    ("01", "1", True), ("1d", "1", True), (9, 9.0, False), ("9", 9, True), (None, None, False), ("x", None, True),
    (True, True, False), ("a\"b", "a\"b", False), ("007", "007", False)])
def test_json_values_compare_by_type(spark, a, b, changed):
    df = spark.createDataFrame([(1, "r", "m", 1, json.dumps({"f": a, "k": 1}), json.dumps({"f": b, "k": 1}))],
                               "id long, run_id string, model_name string, instance_id long, original_features string, "
                               "counterfactual_features string")
    assert df.select(explore.signature(df).alias("s")).first()["s"] == (["f"] if changed else [])
    assert explore.changed_features(df).count() == int(changed)


def test_key_union_and_original_keys(spark):
    df = spark.createDataFrame([(1, "r", "m", 1, '{"a": 1, "b": "007"}', '{"a": 2, "c": "x"}')],
                               "id long, run_id string, model_name string, instance_id long, original_features string, "
                               "counterfactual_features string")
    key = lambda d: [(r.feature, r.original_value, r.counterfactual_value) for r in d.collect()]
    assert key(explore.changed_features(df)) == [("a", "1.000000", "2.000000"), ("b", "007", "None"), ("c", "None", "x")]
    assert key(explore.changed_features(df, union_keys=False)) == [("a", "1.000000", "2.000000"), ("b", "007", "None")]


def test_json_lists_and_objects(spark):
    df = spark.createDataFrame([(1, '["a", "b"]'), (2, "[]"), (3, None)], "id long, x string")
    assert [r.value for r in explore.parse_json_list(df, "x", ["id"]).orderBy("id").collect()] == [["a", "b"], [], None]
    with pytest.raises(Exception, match="JSON array"):
        explore.parse_json_list(spark.createDataFrame([(1, '{"a": 1}')], "id long, x string"), "x", ["id"]).collect()
    with pytest.raises(Exception, match="JSON object"):
        explore.parse_json(spark.createDataFrame([(1, "[1]")], "id long, x string"), "x", ["id"]).collect()


def test_ids_of_many_runs_and_ranks_differ(spark):
    rows = [("m", f"r{i}", c, k) for i in range(15) for c in range(40) for k in range(25)]
    df = spark.createDataFrame(rows, "m string, r string, c long, k int")
    assert df.select(wide_id("m", "r", "c", "k").alias("i")).distinct().count() == len(rows)


def test_surrogate_ids_and_missing_table(spark):
    df = spark.range(1000).repartition(7)
    ids = sorted(r.n for r in store.with_surrogate_ids(df.withColumnRenamed("id", "x"), 10, "n").collect())
    assert ids == list(range(11, 1011))
    root = files.scratch_path(spark, "none")
    assert store.next_id(spark, root, "t") == 0
    assert files.parquet_cache(spark, root + "/c", lambda: spark.range(3)).count() == 3
    assert files.parquet_cache(spark, root + "/c", lambda: 1 / 0).count() == 3


def test_vocabulary_of_many_tokens(spark):
    df = spark.range(120_000).select(F.lit("r").alias("run_id"), F.struct(F.lit("a").alias("f")).alias("o_map"),
                                     F.struct(F.col("id").cast("string").alias("f")).alias("c_map"))
    out = enc.vocabulary_table(df, ["f"], ["run_id"])
    assert out.count() == 120_000 and out.agg(F.max("position")).first()[0] == 119_999


def test_auc_of_saturated_scores(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([0.0, 1e-9, 2e-9, 0.5, 1 - 1e-9, 1.0]), rnd.randint(0, 1)) for _ in range(400)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "p1 double, target int")
    assert metrics.roc_auc(df).first()[0] == pytest.approx(want, abs=1e-12)


def test_split_of_many_classes(spark):
    df = spark.range(6000).select("id", (F.col("id") % 30).cast("string").alias("y"))
    split = prep.stratified_split(df, "id", "y", 0.25, 7).cache()
    assert split.where("is_test").count() == math.ceil(6000 * 0.25)
    per = split.groupBy("y").agg(F.count_if("is_test").alias("t")).collect()
    assert all(abs(r.t - 50) <= 1 for r in per)


def test_unknown_instances(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    ids = spark.createDataFrame([(1,), (9,)], "k long")
    chosen, unknown = prep.select_instances(df, "k", ids)
    assert chosen.count() == 1 and [r.k for r in unknown.collect()] == [9]
    with pytest.raises(ValueError, match="9"):
        prep.select_instances(df, "k", ids, strict=True)


def test_report_errors(spark):
    cfs = spark.createDataFrame([], "id long, run_id string, model_name string, instance_id long, distance double, "
                                    "original_features string, counterfactual_features string, created_at timestamp")
    rules = spark.createDataFrame([], "run_id string, model_name string")
    with pytest.raises(ValueError):
        report.resolve_run(cfs, rules)
    with pytest.raises(ValueError):
        report.resolve_run(cfs, rules, "r", "m")
    with pytest.raises(ValueError):
        report.corpus_metrics(cfs)
    m = spark.createDataFrame([("m", "r", "accuracy", 0.5, 1)], "model_name string, run_id string, metric_name string, "
                                                               "metric_value double, id long") \
        .withColumn("created_at", F.current_timestamp())
    facts = spark.createDataFrame([("r", "model_class", "other"), ("r", "stage", "x")], "run_id string, key string, value string")
    with pytest.raises(Exception, match="belongs to model other"):
        report.model_metrics(m, facts=facts).collect()


def test_boosted_tree_shap_explains_the_margin(spark):
    cases = ctx.clean_cases(spark, SMALL)
    fm, model, scorer = mdl.fit(cases, ctx.SPEC, "boosted_depthwise", {"maxIter": 5, "maxDepth": 3})
    leaves = attr.leaf_paths(mdl.forest_trees(spark, model))
    base = attr.tree_base(leaves)
    phi = attr.tree_shap(fm.transform(cases, output="features").limit(40), leaves, fm.names)
    sums = phi.groupBy("instance_id").agg(F.sum("shap_value").alias("s"))
    p1 = scorer.score(cases).select(F.col("case_id").alias("instance_id"), "p1")
    rows = sums.join(p1, "instance_id").collect()
    assert len(rows) == 40
    for r in rows:
        assert 1 / (1 + math.exp(-2 * (base + r.s))) == pytest.approx(r.p1, abs=1e-9)
    with pytest.raises(TypeError):
        mdl.forest_trees(spark, object())


def test_class_output(spark):
    df = spark.createDataFrame([(1, "f", 0.0, 0.5)], attr.SHAP_SCHEMA)
    assert attr.class_output(df, 0).first().shap_value == -0.5
    assert attr.class_output(df, 1).first().shap_value == 0.5
    for bad in ((2, 2), (0, 3)):
        with pytest.raises(ValueError):
            attr.class_output(df, *bad)


@pytest.mark.parametrize("scale", [False, True])
def test_search_with_a_fitted_model(spark, scale):
    cases = ctx.materialise(ctx.clean_cases(spark, SMALL))
    _, _, scorer = mdl.fit(cases, ctx.SPEC, "random_forest", {"numTrees": 5, "maxDepth": 4}, scale=scale)
    sctx = S.fit_context(cases, ctx.SPEC)
    found = S.search(cases.limit(60), ctx.SPEC, sctx, scorer, n_candidates=32, seed=42, strict=True).cache()
    assert found.count() > 0
    assert found.where(~S.feasible(ctx.SPEC, sctx)).count() == 0
    again = scorer.score(found.drop("orig"))
    assert again.where(F.col("prediction") != F.col("target_class")).count() == 0


def test_search_spaces():
    for p in mdl.draw_params("random_forest", 5):
        assert 0.3 <= float(p["featureSubsetStrategy"]) <= 1.0 and "subsamplingRate" not in p
    for p in mdl.draw_params("boosted_leafwise", 5):
        assert 4 <= p["maxDepth"] <= 7 and 0.6 <= p["subsamplingRate"] <= 1.0
