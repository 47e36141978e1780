import math

from pyspark.sql import functions as F

from lodestar.llm import blocks, negatives
from lodestar.llm.catalog import op11_negatives

SMALL = "/root/testdata/sf0.001"


def brute(rows, positives=5, wanted=3, low=50, high=95):
    kept = [(i, label, [math.floor(256 * float(x)) for x in e]) for i, e, label in rows
            if i is not None and label is not None and e is not None
            and all(x is not None and math.isfinite(x) for x in e)]
    anchors = {}
    for i, label, v in kept:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        pairs = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in kept if i != a)
        best = [(-s, i) for s, i, other in pairs if other == label][:positives]
        for p, i in best:
            inside = [(-s, j) for s, j, other in pairs if other != label and low * p <= -100 * s <= high * p][:wanted]
            out += [(a, i, r, j, p, s) for r, (s, j) in enumerate(inside, 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select(
        "*", F.lit(1).alias("id"), F.lit("x").alias("score"), F.lit(0).alias("asked"), F.lit(2).alias("anchor_id"))
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, F.col("label"), **more).collect())


def table(spark):
    return [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]


def test_table(spark):
    moved = [(i, e, (label + 1) % 10 if i % 7 == 0 else label) for i, e, label in table(spark)]
    assert sorted(tuple(r) for r in op11_negatives(spark, SMALL).collect()) == brute(moved)


def test_small_blocks_and_other_bounds(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(negatives, "CANDIDATE_BLOCK", 20)
    rows = table(spark)
    assert run(spark, rows) == brute(rows)
    other = {"positives": 3, "low": 10, "high": 100}
    assert run(spark, rows, negatives=40, **other) == brute(rows, wanted=40, **other)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (4, None, 2),
            (5, [0.5, None], 2), (6, [nan, 0.0], 1), (7, [inf, 0.0], 2), (8, [0.4, 0.1], None), (None, [1.0, 1.0], 1),
            (50, [0.0, 0.0], 3), (9, [], 3), (10, [-1.0, -1.0], 1), (11, [0.7, 0.4, 9.0], 2), (1, [1.0, 0.5], 1),
            (2, [0.5, 0.5], 2), (0, [2.0, 0.0], 1), (100, [1.0, 1.0], 9), (12, [0.7, 0.1], 2), (150, [-1.0, 0.0], 4),
            (13, [1.0, 0.0], 4)]
    assert run(spark, rows) == brute(rows)


def test_zero_scores_and_ties(spark):
    # positives and negatives of score 0: the window of a positive holds negatives of smaller ids
    rows = [(0, [1.0], 1), (9, [0.0], 1), (5, [0.0], 2), (4, [0.0], 2), (3, [0.0], 2), (2, [0.0], 2), (8, [-0.5], 2)]
    assert run(spark, rows) == brute(rows) == [(0, 9, 1, 2, 0, 0), (0, 9, 2, 3, 0, 0), (0, 9, 3, 4, 0, 0)]


def test_hot_label_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATE_BLOCK", 64)
    rows = [(1 + 50 * (i % 7) + i % 3, [1.0, 0.5], 1) for i in range(900)] + [(50, [1.0, 1.0], 1), (100, [1.0, 0.0], 2)] + [
        (1000 + i, [0.8, 0.3], 2) for i in range(1, 300) if i % 50]
    assert run(spark, rows) == brute(rows)


def test_large_values(spark):
    rows = [(0, [3e6, -2e6], 1), (1, [3e6, 1e6], 1), (2, [1e6, -1e6], 2), (3, [2e6, 1.0], 2)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_alone(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(1, [1.0], 1), (2, [0.6], 2)]) == []


def test_blocks_hold_each_vector_once_in_bounded_blocks(spark):
    rows = [(1, [1.0, 2.0])] * 3009 + [(i, [float(i), 0.0]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    cut = blocks.cut(df, 64, "c")
    sizes = [len(r.c_id) for r in cut.collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 64
    assert cut.select("c_block").distinct().count() == len(sizes)


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8000)
    df = spark.range(100, numPartitions=1).select("id", F.transform(F.sequence(F.lit(1), F.lit(100)), lambda x: x.cast(
        "double")).alias("v"))
    sizes = [len(r.c_id) for r in blocks.cut(df, 64, "c").collect()]
    assert sum(sizes) == 100 and max(sizes) <= 11
