"""What the distillation stores and how often it makes a value."""

import glob
import os

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import candidates as cand
from lodestar.operators import cluster as clu
from lodestar.operators import encode as enc
from lodestar.plans import context as ctx
from lodestar.session import shared_dir


def new_folders(spark, before, name):
    return set(glob.glob(os.path.join(shared_dir(spark), f"{name}-*"))) - before


def pairs(spark):
    rows = [(i, (float(i % 3), ["A", " A b", None][i % 3]), (float(i % 5), ["A", "B"][i % 2])) for i in range(12)]
    return spark.createDataFrame(rows, "id long, original struct<x:double,c:string>, counterfactual struct<x:double,c:string>")


def test_only_records_and_narrow_labelled_rows_are_stored(spark):
    names = ("encoded", "labelled", "counterfactuals")
    before = {n: set(glob.glob(os.path.join(shared_dir(spark), f"{n}-*"))) for n in names}
    d = ctx.distilled(spark, "/root/testdata/sf0.001", ctx.RUNS[:1])
    assert not new_folders(spark, before["encoded"], "encoded")
    for name in names[1:]:
        (path,) = new_folders(spark, before[name], name)
        assert not {"id", "vector"} & set(spark.read.parquet(path).columns)
        assert all(f.endswith(".zstd.parquet") for f in glob.glob(path + "/*.parquet"))
    # the vectors and ids made again are those of the records
    _, encoded = ctx.encoded_run(d["counterfactuals"], "run-a")
    both = d["labelled"].select("id", F.col("vector").alias("v")).join(encoded.select("id", "vector"), "id", "full")
    assert both.where(~F.col("v").eqNullSafe(F.col("vector"))).count() == 0 and both.count() == encoded.count() > 0


def test_indicators_do_not_make_the_tokens_again_for_each_entry(spark, monkeypatch):
    parsed = enc.typed_pairs(pairs(spark))
    encoder = enc.fit_encoder(parsed, ["x"], ["c"])
    assert encoder.vocabulary == sorted({r["t"] for r in parsed.select(F.explode(encoder.tokens()).alias("t")).collect()})
    short = encoder.transform(parsed).select("id", "vector")
    want = sorted(short.collect())
    assert any(sum(r["vector"][3:]) for r in want)
    monkeypatch.setattr(enc, "COMPARED_TOKENS", 0)
    long = encoder.transform(parsed).select("id", "vector")
    for df in (short, long):
        top = df._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
        assert "vector" in top and "replace(" not in top
    assert sorted(long.collect()) == want


def test_token_text_is_made_of_distinct_changes(spark):
    plan = enc.vocabulary_table(enc.typed_pairs(pairs(spark).withColumn("run_id", F.lit("r"))), ["c"], ["run_id"])
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    text = max(i for i, line in enumerate(lines) if "replace(" in line)
    assert any("Aggregate" in line for line in lines[text + 1:])


def test_points_of_restarts_are_blocks(spark):
    x = np.array([[0.0, 1.0, 0.25], [1.0, 1.0, -3.0], [0.0, 0.0, 7.5], [1.0, 0.0, 0.0]])
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>").coalesce(1)
    packed = clu.Restarts(points, [(2, 1)]).points
    assert packed.columns == ["h", "flags", "bits", "x"] and packed.count() == 1
    import pyarrow as pa
    (h, back), = clu._slices([pa.RecordBatch.from_pylist([r.asDict() for r in packed.collect()], packed.toArrow().schema)], 1)
    assert (back == x).all() and len(h) == 4
    assert sorted(clu.kmeans(points, 2, n_init=2).centres) == sorted(clu.kmeans(points.repartition(3), 2, n_init=2).centres)


def test_values_are_drawn_where_a_feature_varies(monkeypatch):
    sizes, mod = [], cand._mod
    monkeypatch.setattr(cand, "_mod", lambda x: sizes.append(x.size) or mod(x))
    plan = cand.Candidates(ctx.SPEC, {}, {}, {}, {}, ctx.SCORECARD, list(ctx.SPEC.features), list(ctx.SPEC.numeric), 60, 42, 3)
    own = cand.Slice({c: np.ones((10, 1)) for c in ctx.SPEC.numeric}, {}, {})
    plan.drawn(np.arange(10), np.ones(10, dtype=bool), own)
    # all selection draws, and two values a candidate on average; two rounds each
    assert sum(sizes) == 2 * 600 * (len(ctx.SPEC.numeric) + 2)
