"""Kernel SHAP against exact Shapley values; thinned and spread counterfactuals."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import diverse as D
from lodestar.operators import kernel_shap as K
from lodestar.operators import model as mdl
from lodestar.operators import search as S
from lodestar.plans import context as ctx

SMALL = "/root/testdata/sf0.001"


class Formula:
    """A scorer that is not additive."""

    def score(self, df):
        return df.withColumn("p1", F.col("a") * F.col("b") + F.when(F.col("c") == "x", F.col("d")).otherwise(0.5) - F.col("e") ** 2)


def formula(r):
    return r["a"] * r["b"] + (r["d"] if r["c"] == "x" else 0.5) - r["e"] ** 2


def shapley(case, background, features):
    def worth(s):
        return sum(formula({f: (case if f in s else b)[f] for f in features}) for b in background) / len(background)
    out = {}
    for f in features:
        rest = [g for g in features if g != f]
        out[f] = sum(math.factorial(n) * math.factorial(len(rest) - n) / math.factorial(len(features))
                     * (worth({*s, f}) - worth(set(s))) for n in range(len(rest) + 1) for s in itertools.combinations(rest, n))
    return out


FEATURES = ["a", "b", "c", "d", "e"]
SCHEMA = "case_id long, a double, b double, c string, d double, e double"
ROWS = [(i, i * 0.5 - 1, (i * 7) % 4 - 1.5, "xy"[i % 2], i * 0.1, (i * 3) % 5 * 0.2) for i in range(12)]


def test_all_coalitions_give_exact_shapley_values(spark):
    cases, background = spark.createDataFrame(ROWS[:5], SCHEMA), spark.createDataFrame(ROWS[5:] + ROWS[6:7], SCHEMA)
    rows = [dict(zip(["case_id", *FEATURES], r)) for r in ROWS]
    got = {(r.instance_id, r.feature_name): r for r in K.kernel_shap(cases, background, Formula(), FEATURES).collect()}
    assert len(got) == 25
    for case in rows[:5]:
        for f, v in shapley(case, rows[5:] + rows[6:7], FEATURES).items():
            r = got[case["case_id"], f]
            assert r.shap_value == pytest.approx(v, abs=1e-9)
            assert r.feature_value == (None if f == "c" else case[f])


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_features(spark, n):
    some = FEATURES[:n]

    class Product:
        def score(self, df):
            return df.withColumn("p1", F.col("a") * (F.col("b") if n > 1 else 1.0) + (F.length("c") if n > 2 else 0.0))

    cases = spark.createDataFrame(ROWS, SCHEMA)
    got = K.kernel_shap(cases, cases.limit(3), Product(), some)
    base = Product().score(cases.limit(3)).agg(F.avg("p1")).first()[0]
    sums = {r.instance_id: r.s for r in got.groupBy("instance_id").agg(F.sum("shap_value").alias("s")).collect()}
    for r in Product().score(cases).collect():
        assert base + sums[r.case_id] == pytest.approx(r.p1, abs=1e-9)


def test_sampled_coalitions_add_up_and_come_with_their_complements(spark):
    chosen = K.coalitions(11, 200, seed=3)
    members = {m for m, _ in chosen}
    assert len(chosen) >= 200 and all(2 ** 11 - 1 - m in members for m in members) and not members & {0, 2 ** 11 - 1}
    assert K.coalitions(11, 200, seed=3) == chosen != K.coalitions(11, 200, seed=4)
    cases = ctx.materialise(ctx.clean_cases(spark, SMALL))
    fm, model, scorer = mdl.fit(cases, ctx.SPEC, "random_forest", {"numTrees": 5, "maxDepth": 4})
    some, background = cases.limit(10), ctx.materialise(cases.orderBy("case_id").limit(8))
    got = K.kernel_shap(ctx.materialise(some), background, scorer, list(ctx.SPEC.features), max_coalitions=100)
    base = scorer.score(background).agg(F.avg("p1")).first()[0]
    sums = {r.instance_id: r.s for r in got.groupBy("instance_id").agg(F.sum("shap_value").alias("s")).collect()}
    rows = scorer.score(cases).where(F.col("case_id").isin(list(sums))).collect()
    assert len(rows) == 10
    for r in rows:
        assert base + sums[r.case_id] == pytest.approx(r.p1, abs=1e-9)


def test_errors(spark):
    cases = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError, match="background"):
        K.kernel_shap(cases, cases.limit(0), Formula(), FEATURES)
    with pytest.raises(ValueError, match="too few"):
        K.solution([(1, 1.0)], 4)
    assert K.kernel_shap(cases.limit(0), cases, Formula(), FEATURES).count() == 0


@pytest.fixture(scope="module")
def searched(spark):
    cases = ctx.materialise(ctx.clean_cases(spark, SMALL).where("case_id % 8 < 2"))
    sctx = ctx.search_context(ctx.clean_cases(spark, SMALL))
    pool = ctx.materialise(S.search(cases, ctx.SPEC, sctx, ctx.SCORECARD, n_candidates=32, total_cfs=32, strict=True))
    return cases, sctx, pool


def test_thinned_rows_flip_are_feasible_and_cannot_lose_a_change(spark, searched):
    cases, sctx, pool = searched
    thin = ctx.materialise(D.thin(pool, ctx.SPEC, sctx, ctx.SCORECARD, 2))
    assert thin.count() == pool.count() > 0
    assert thin.where(~S.feasible(ctx.SPEC, sctx)).count() == 0
    again = ctx.SCORECARD.score(thin)
    assert again.where("prediction <> target_class OR target_class <> 1 - original_class").count() == 0
    vary = [c for c in ctx.SPEC.actionable if c not in ctx.SPEC.dependent]
    n = D.changed(ctx.SPEC, vary)
    before, after = (df.agg(F.avg(n)).first()[0] for df in (pool, thin))
    assert after < before and thin.where(n == 0).count() == 0
    # by brute force: no single change can go back any more
    for c in vary:
        back = thin.where(~F.col(c).eqNullSafe(F.col(f"orig.{c}"))).withColumn(c, F.col(f"orig.{c}"))
        scored = ctx.SCORECARD.score(S.reconcile_candidates(back, ctx.SPEC))
        assert scored.where((F.col("prediction") == F.col("target_class")) & S.feasible(ctx.SPEC, sctx)).count() == 0


def plain_spread(rows, k, apart):
    picked = []
    rows = sorted(rows, key=lambda r: (r["distance"], r["cand"]))
    while rows and len(picked) < k:
        near = [min((apart(r, p) for p in picked), default=math.inf) for r in rows]
        best = min(range(len(rows)), key=lambda i: (-near[i], rows[i]["distance"], rows[i]["cand"]))
        if near[best] <= 0:
            break
        picked.append(rows[best])
    return [r["cand"] for r in picked]


def test_spread_is_the_greedy_choice(spark, searched):
    cases, sctx, pool = searched
    spec = ctx.SPEC
    thin = ctx.materialise(D.thin(pool, spec, sctx, ctx.SCORECARD, 2))
    got = {}
    for r in D.spread(thin, spec, sctx, 4).collect():
        got.setdefault(r.case_id, {})[r.cf_rank] = r.cand

    def apart(a, b):
        terms = [abs(a[c] - b[c]) / sctx.ranges.get(c, 1.0) for c in spec.distance_numeric]
        terms += [float(a[c] != b[c]) for c in spec.categorical]
        return sum(terms) / len(terms)

    by_case = {}
    for r in thin.collect():
        by_case.setdefault(r.case_id, []).append(r.asDict())
    assert got.keys() == by_case.keys()
    for case, rows in by_case.items():
        assert [got[case][i] for i in sorted(got[case])] == plain_spread(rows, 4, apart)


def test_fewer_changes_than_the_nearest(spark, searched):
    cases, sctx, _ = searched
    nearest = S.search(cases, ctx.SPEC, sctx, ctx.SCORECARD, n_candidates=32, strict=True)
    spread = D.search(cases, ctx.SPEC, sctx, ctx.SCORECARD, n_candidates=32)
    n = D.changed(ctx.SPEC, ctx.SPEC.features)
    assert spread.agg(F.avg("n_changed")).first()[0] < nearest.agg(F.avg(n)).first()[0]
    assert spread.groupBy("case_id").count().agg(F.max("count")).first()[0] <= 5
