"""Six-row two-pattern distillation corpus (encode -> cluster -> rules)."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import cluster as clu
from lodestar.operators import encode as enc
from lodestar.operators import rules as rl

NUM = ["capital_gain", "capital_loss", "hours_per_week"]
CAT = ["workclass", "education", "occupation"]
BASE = {"capital_gain": 0, "capital_loss": 0, "hours_per_week": 40, "education": "HS-grad",
        "workclass": "Private", "occupation": "Sales"}
CHANGES = [(1, 101, 0.05, {"capital_gain": 5000}), (2, 102, 0.06, {"capital_gain": 6000}),
           (3, 103, 0.07, {"capital_gain": 7000}),
           (4, 104, 0.08, {"hours_per_week": 50, "education": "Bachelors"}),
           (5, 105, 0.09, {"hours_per_week": 55, "education": "Bachelors"}),
           (6, 106, 0.10, {"hours_per_week": 60, "education": "Bachelors"})]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "test-run", inst, "m", dist, json.dumps(BASE), json.dumps({**BASE, **ch}))
            for i, inst, dist, ch in CHANGES]
    return spark.createDataFrame(rows, "id long, run_id string, instance_id long, model_name string, "
                                       "distance double, original_features string, counterfactual_features string")


@pytest.fixture(scope="module")
def encoded(corpus):
    parsed = enc.parse_pairs(corpus)
    encoder = enc.fit_encoder(parsed, NUM, CAT)
    return encoder, encoder.transform(parsed).orderBy("id").cache()


def test_vocabulary_and_ranges(encoded):
    encoder, _ = encoded
    assert encoder.vocabulary == ["education__transition__HS-grad__to__Bachelors"]
    assert encoder.ranges == {"capital_gain": 7000.0, "capital_loss": 1.0, "hours_per_week": 20.0}
    assert encoder.width == 3 + 3 + 3 + 1


def test_flags_and_deltas(encoded):
    _, df = encoded
    rows = df.collect()
    r1, r4 = rows[0], rows[3]
    assert (r1["capital_gain__changed"], r1["hours_per_week__changed"], r1["education__changed"]) == (1, 0, 0)
    assert (r4["capital_gain__changed"], r4["hours_per_week__changed"], r4["education__changed"]) == (0, 1, 1)
    assert r4["vector"][-1] == 1.0
    gains = [r["capital_gain__delta"] for r in rows[:3]]
    hours = [r["hours_per_week__delta"] for r in rows[3:]]
    assert gains == pytest.approx([5 / 7, 6 / 7, 1.0])
    assert hours == pytest.approx([0.5, 0.75, 1.0])
    assert all(len(r["vector"]) == 10 for r in rows)


def _cluster(df):
    centres = clu.initial_centres(df, 2, seed=42)
    fit = clu.lloyd(df, centres, steps=5)
    return clu.assign(df, fit.centres)


def test_two_clusters(encoded):
    _, df = encoded
    lab = _cluster(df)
    sizes = sorted(r["count"] for r in lab.groupBy("cluster_id").count().collect())
    assert sizes == [3, 3]
    assert clu.inertia(lab).first()["inertia"] == pytest.approx(0.165816, abs=1e-6)
    assert clu.silhouette(lab).first()["silhouette"] == pytest.approx(0.984481, abs=1e-6)
    shares = rl.cluster_sizes(lab).agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(1.0)


def test_rules_text_and_quality(encoded):
    _, df = encoded
    lab = _cluster(df)
    sizes = rl.cluster_sizes(lab)
    rules = rl.rule_quality(rl.extract_rules(sizes, rl.feature_profile(lab, NUM, CAT), rl.transition_profile(lab), NUM))
    got = {tuple(r["conditions"]): (r["support"], round(r["quality_score"], 3), r["avg_distance"])
           for r in rules.collect()}
    a = ("capital_gain tends to increase (avg normalized delta +0.857)",)
    b = ("hours_per_week tends to increase (avg normalized delta +0.750)", "education changes (100% of cluster)",
         "education: HS-grad -> Bachelors (100%)")
    assert got[a][:2] == (3, 0.782) and got[a][2] == pytest.approx(0.06)
    assert got[b][:2] == (3, 0.573) and got[b][2] == pytest.approx(0.09)
    pairs = rl.rule_pairs(rules).collect()
    assert len(pairs) == 1 and pairs[0]["similarity"] == 0.0
    sentence = rules.select(rl.rule_sentence(F.col("conditions")).alias("s")).collect()
    assert any(r["s"].startswith("IF capital_gain tends to increase") for r in sentence)


def test_errors(spark, corpus, encoded):
    empty = enc.parse_pairs(corpus.limit(0))
    with pytest.raises(ValueError):
        enc.fit_encoder(empty, NUM, CAT)
    with pytest.raises(ValueError):
        enc.parse_pairs(corpus.drop("original_features"))
    with pytest.raises(RuntimeError):
        enc.clustering_matrix(encoded[1], None)
    _, df = encoded
    with pytest.raises(ValueError):
        clu.initial_centres(df, 7)
