"""Converged clusters, by what must hold of them."""

import pytest

from lodestar.operators import cluster as clu
from lodestar.plans import context as ctx

SMALL = "/root/testdata/sf0.001"


def test_converged_clusters_are_a_fixed_point(spark):
    run = ctx.RUNS[:1]
    short, long = (ctx.distilled(spark, SMALL, run, steps=s)["labelled"] for s in (ctx.LLOYD_STEPS, None))
    costs = [clu.inertia(df).first()[0] for df in (short, long)]
    assert costs[1] <= costs[0] * (1 + 1e-9)
    width = clu.vector_width(long)
    means = clu.group_means(long, "cluster_id", "vector", width)
    again = clu.assign(long.withColumnRenamed("cluster_id", "was"), [means[j] for j in sorted(means)])
    assert again.where("was <> cluster_id").count() == 0
    assert clu.inertia(again).first()[0] == pytest.approx(costs[1])
