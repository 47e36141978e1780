import re

import pytest

from lodestar.llm import mixing
from tests.llm.brute import WORD, documents, rows_of

SMALL = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share out, cap, share the excess out again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def check(df, spark):
    docs = [(r.doc_id, r.text, r.source) for r in df.collect()]
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    target = brute_targets(sizes)
    got = mixing.shares(df).collect()
    assert len(got) == len(docs)
    by_id = {}
    for i, t, s in docs:
        by_id.setdefault(i, []).append((len(WORD.findall(t or "")), s))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        match = [x for x in by_id[r.doc_id] if x[0] == r["size"] and sizes[x[1]] == r.source_size]
        assert match and abs(r.target - target[match[0][1]]) < 1e-6 * max(1, r.target)
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[match[0][1]] += r.taken
    return sizes, target, taken


def test_awkward_table(spark):
    check(documents(spark), spark)


def test_targets_are_met(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, target, taken = check(docs, spark)
    largest = max(len(WORD.findall(r.text or "")) for r in docs.collect())
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows_of(mixing.shares(docs)) == rows_of(mixing.shares(docs.repartition(7)))


def test_mix_repeats_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r.doc_id: r.taken // r["size"] for r in mixing.shares(docs).collect() if r["size"]}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if k in want}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, "d": 20}, {"a": 1}, {"a": 0, "b": 0}, {"a": 0, None: 7}])
def test_water_level(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    for s, t in brute_targets(sizes).items():
        assert abs(got[s] - t) < 1e-6


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.shares(empty).count() == 0 and mixing.mix(empty).count() == 0
    df = spark.createDataFrame([(1, "a b", "s", 9, 8, 7)],
                               "doc_id long, text string, source string, copies int, threshold int, place int")
    out = mixing.mix(df)
    assert out.columns == df.columns and tuple(out.first()) == (1, "a b", "s", 9, 8, 7)


def test_no_python_in_the_plan(spark):
    assert not re.search("Python|Arrow|Pandas", mixing.shares(documents(spark))._jdf.queryExecution().toString())
