"""The search on arrays against the search on rows; stored artifacts."""

import glob
import math
import os

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import cluster as clu
from lodestar.operators import search as S
from lodestar.plans import context as ctx
from lodestar.session import shared_dir

SEGMENTS = ["BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE"]
LEVELS = list(ctx.SPEC.ordinal["priority"].items())


@pytest.fixture(scope="module")
def cases(spark):
    rows = []
    for i in range(160):
        name, level = LEVELS[i % 5]
        # keys 0 to 9 come twice, one key is null, one number is NaN
        key = None if i == 159 else i % 150
        rows.append((key, 1000.0 + 2500.0 * i, -900.0 + 57.0 * i, float(i % 7 + 1), float(3 * i % 301),
                     math.nan if i == 77 else (i % 11) / 100, level, SEGMENTS[i % 4], name, "OFP"[i % 3], f"N{i % 6}", f"R{i % 2}"))
    numbers = "total_price double, acct_bal double, line_count double, sum_qty double, avg_discount double, priority_num double"
    return spark.createDataFrame(rows, f"case_id long, {numbers}, segment string, priority string, status string, "
                                       "nation string, region string").cache()


def plain(df, *but):
    return sorted((repr(r) for r in df.drop(*but).collect()))


@pytest.mark.parametrize("options", [{}, {"strict": True}, {"total_cfs": 40}, {"desired": 1},
                                     {"features_to_vary": ["sum_qty", "nation", "segment"], "max_varied": 2},
                                     {"permitted_range": {"total_price": (0.0, 9e5)}}])
def test_same_counterfactuals_as_row_by_row(cases, options):
    sctx, facts = S.fit_context(cases, ctx.SPEC), S.case_facts(cases, ctx.SPEC)
    assert facts == S.CaseFacts(160, True, False)
    by_rows = S.CaseFacts(160, True, True)
    got, want = (S.search(cases, ctx.SPEC, sctx, ctx.SCORECARD, n_candidates=40, seed=5, facts=f, **options) for f in (facts, by_rows))
    assert got.dtypes == want.dtypes
    assert plain(got, "cf_rank") == plain(want, "cf_rank") and got.count() > 0


def test_ranks_without_repeated_keys(cases):
    cases = cases.where("case_id >= 10")
    sctx = S.fit_context(cases, ctx.SPEC)
    facts = S.case_facts(cases, ctx.SPEC)
    got = S.search(cases, ctx.SPEC, sctx, ctx.SCORECARD, n_candidates=40, facts=facts)
    want = S.search(cases, ctx.SPEC, sctx, ctx.SCORECARD, n_candidates=40, facts=S.CaseFacts(facts.rows, False, True))
    assert not facts.repeated and plain(got) == plain(want)


def test_candidates_of_a_scorecard_are_no_rows(cases):
    sctx = S.fit_context(cases, ctx.SPEC)
    plan = S.search(cases, ctx.SPEC, sctx, ctx.SCORECARD)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode(sequence" not in plan


def test_counts_of_checks(cases):
    sctx, facts = S.fit_context(cases, ctx.SPEC), S.case_facts(cases, ctx.SPEC)
    got = S.count_checks(cases, ctx.SPEC, sctx, ctx.SCORECARD, 40, 5, facts)
    want = S.count_checks(cases, ctx.SPEC, sctx, ctx.SCORECARD, 40, 5, S.CaseFacts(160, True, True))
    assert plain(got) == plain(want)


def test_stored_records_hold_no_text(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    before = set(glob.glob(os.path.join(shared_dir(spark), "counterfactuals-*")))
    cfs = ctx.counterfactual_table(spark, sf, ctx.RUNS[:1], store=True)
    new = set(glob.glob(os.path.join(shared_dir(spark), "counterfactuals-*"))) - before
    assert len(new) == 1 and "original_features" not in spark.read.parquet(new.pop()).columns
    one = cfs.first()
    assert one["original_features"].startswith('{"acct_bal":') and one["counterfactual_features"].startswith('{"acct_bal":')


def test_first_centres_without_a_dedupe_of_all_points(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i % 300), -0.0 if i % 2 else 0.0]) for i in range(3000)], "id long, vector array<double>")
    want = points.groupBy("vector").agg(F.min(F.struct(clu.uniform_draw(["id", 42]).alias("u"), "id")).alias("f")).orderBy("f").limit(5).collect()
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "groupBy", lambda *a, **k: pytest.fail("all points are grouped"))
        got = clu.initial_centres(points, 5)
    assert got == [r["vector"] for r in want]
    copies = spark.range(5000).select("id", F.when(F.col("id") == 17, F.array(F.lit(2.0))).otherwise(F.array(F.lit(1.0))).alias("vector"))
    assert sorted(clu.initial_centres(copies, 2)) == [[1.0], [2.0]]
    with pytest.raises(ValueError, match="cannot form 3"):
        clu.initial_centres(copies, 3)


def test_silhouette_of_equal_points(spark):
    same = spark.createDataFrame([([1.0, 2.0], i % 2) for i in range(6)], "vector array<double>, cluster_id int")
    assert clu.silhouette(same).first()[0] == 0.0


def test_driver_gets_a_handful_of_partial_sums(spark, monkeypatch):
    got, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: got.append(collect(self)) or got[-1])
    parts = spark.range(0, 24, 1, 24).rdd.map(lambda r: (bytearray(np.full(3, float(r.id)).tobytes()),)).toDF("a binary")
    got.clear()
    assert clu._added(parts, (3,)).tolist() == [276.0] * 3
    assert max(len(g) for g in got) <= 6
