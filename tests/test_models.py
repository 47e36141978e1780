"""MLlib-backed operators: tree SHAP local accuracy, importances, search space."""

import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import attribution as attr
from lodestar.operators import model as mdl
from lodestar.plans import context as ctx

SMALL = "/root/testdata/sf0.001"


def test_tree_shap_local_accuracy(spark):
    cases = ctx.clean_cases(spark, SMALL)
    fm, model, scorer = mdl.fit(cases, ctx.SPEC, "random_forest", {"numTrees": 5, "maxDepth": 4})
    leaves = attr.leaf_paths(mdl.forest_trees(spark, model))
    base = attr.tree_base(leaves)
    enc = fm.transform(cases, output="features").limit(40)
    phi = attr.tree_shap(enc, leaves, fm.names).groupBy("instance_id").agg(F.sum("shap_value").alias("s"))
    p1 = scorer.score(cases).select(F.col("case_id").alias("instance_id"), "p1")
    rows = phi.join(p1, "instance_id").collect()
    assert len(rows) == 40
    for r in rows:
        assert base + r["s"] == pytest.approx(r["p1"], abs=1e-9)


def test_search_space_and_errors():
    draws = mdl.draw_params("boosted_depthwise", 5, seed=1)
    for p in draws:
        assert 100 <= p["maxIter"] <= 500 and (p["maxIter"] - 100) % 50 == 0
        assert 0.01 <= p["stepSize"] <= 0.3
    assert draws == mdl.draw_params("boosted_depthwise", 5, seed=1)
    with pytest.raises(ValueError):
        mdl.draw_params("unknown", 1)
    with pytest.raises(ValueError):
        mdl.estimator("unknown")


def test_tree_shap_tables_are_the_polynomial():
    """Looked-up values of a leaf are those of the polynomial, for shares
    of zero, values on a threshold, NaN and infinities, too."""
    import numpy as np
    rng = np.random.default_rng(3)
    grid = np.array([-math.inf, 0.1, 0.3, 0.5, 0.9, math.inf])
    for d in (1, 2, 5, 9, 12):
        n, width = 7, 14
        feats = np.array([rng.permutation(width)[:d] for _ in range(n)])
        at = np.sort(np.array([[rng.choice(6, 2, replace=False) for _ in range(d)] for _ in range(n)]), axis=2)
        z = rng.choice([0.0, 0.2, 0.5, 1.0], size=(n, d))
        group = (feats, grid[at[:, :, 0]], grid[at[:, :, 1]], z, rng.normal(size=n))
        x = rng.choice([0.0, 0.1, 0.3, 0.4, 0.9, 1.0, math.nan, math.inf, -math.inf], size=(50, width))
        wanted = np.zeros(x.shape)
        attr._add_phi(wanted, x, *group)
        cuts, short = attr._ranked([group], width)
        found = np.zeros(x.T.shape)
        attr._add_tabulated(found, attr._value_ranks(x, cuts), *short[0])
        assert np.abs(found.T - wanted).max() < 1e-9
