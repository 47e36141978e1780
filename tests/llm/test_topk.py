import math

from pyspark.sql import functions as F

from lodestar.llm import topk
from lodestar.llm.catalog import op3_topk

SMALL = "/root/testdata/sf0.001"


def brute(rows, k):
    v = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows
         if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in {i: a for i, a in v if i % 50 == 0}.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, k).collect())


def test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op3_topk(spark, SMALL).collect()) == brute(rows, 5)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (50, [1.0, 1.0]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (4, [0.5, None]),
            (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [0.0, 0.0]), (8, []), (9, [-1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
            (100, [nan, 1.0]), (10, [0.5, -0.25]), (11, [0.001, -0.001])]
    assert run(spark, rows) == brute(rows, 5)


def test_ties_beyond_k_and_large_values(spark):
    rows = [(i, [1.0, 0.5]) for i in range(200)] + [(300, [3e6, -2e6]), (301, [-3e6, 1e6])]
    assert run(spark, rows) == brute(rows, 5)


def test_fewer_candidates_and_empty(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, []) == []


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 20)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert run(spark, rows, 7) == brute(rows, 7)
