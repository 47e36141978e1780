"""Thinning and spreading on arrays against the same on rows."""

import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import diverse as D
from lodestar.operators import search as S
from lodestar.plans import context as ctx

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


def plain(df):
    return sorted(repr(r) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"total_cfs": 2, "seed": 7}, {"max_varied": 4, "total_cfs": 12}])
def test_same_picks_as_row_by_row(cases, options):
    once = cases.where("case_id >= 10 OR case_id IS NULL")
    sctx, facts = S.fit_context(cases, ctx.SPEC), S.case_facts(once, ctx.SPEC)
    assert not facts.repeated
    by_rows = S.CaseFacts(facts.rows, False, True)
    got, want = (D.search(once, ctx.SPEC, sctx, ctx.SCORECARD, n_candidates=40, facts=f, **options) for f in (facts, by_rows))
    assert got.dtypes == want.dtypes
    assert plain(got) == plain(want) and got.count() > 100
    assert got.where("n_changed > 1").count() > 0


def test_cases_of_a_repeated_key_compete(cases):
    """Keys 0 to 9 have two different rows: their candidates are one pool."""
    sctx, facts = S.fit_context(cases, ctx.SPEC), S.case_facts(cases, ctx.SPEC)
    got = D.search(cases, ctx.SPEC, sctx, ctx.SCORECARD, n_candidates=40, facts=facts)
    want = D.search(cases, ctx.SPEC, sctx, ctx.SCORECARD, n_candidates=40, facts=S.CaseFacts(160, True, True))
    assert facts.repeated and plain(got.where("case_id >= 10")) == plain(want.where("case_id >= 10"))
    assert got.groupBy("case_id").count().agg(F.max("count")).first()[0] <= 5
    assert got.where("case_id < 10").count() == want.where("case_id < 10").count() > 0


def test_variants_of_a_scorecard_are_no_rows(cases):
    once = cases.where("case_id >= 10")
    got = D.search(once, ctx.SPEC, S.fit_context(once, ctx.SPEC), ctx.SCORECARD, n_candidates=40)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and plan.count("Generate explode") == 1
