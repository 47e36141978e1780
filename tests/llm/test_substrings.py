import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import substrings
from lodestar.llm.catalog import op8_substrings
from tests.llm.brute import documents, removed

SMALL = "/root/testdata/sf0.001"


def check(docs, **options):
    window = options.get("window", 13)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for (i, _), (w, gone) in zip(rows, removed(rows, window)):
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [tuple(r) for r in substrings.dedup(docs, **options).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return sum(x[2] for x in want)


def shared(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    extra = [(100 + i, f"own{i} start {passage if i % 3 else passage[:120]} end{i} " + "tail common words " * (i % 5), "s")
             for i in range(40)]
    extra += [(60, "a a a a a a a a a a a a a a a a a a", "s"), (61, "a " * 30, "s"), (150, passage, "s"),
              (150, passage + " more", "s"), (20, "q " + passage, "s")]
    return documents(spark, extra)


@pytest.mark.parametrize("options", [{}, {"group_limit": 3}, {"window": 8, "short": 3}, {"window": 50, "short": 10}])
def test_shared_passages(spark, options):
    assert check(shared(spark), **options) > 0


def test_query_over_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {}
    for (i, _), (w, gone) in zip(rows, removed(rows)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op8_substrings(spark, SMALL).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_no_survivors_and_empty(spark):
    assert check(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")) == 0
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        substrings.dedup(shared(spark), window=13, short=14)


def test_windows_are_told_apart_by_64_bits(spark, monkeypatch):
    """Full windows whose hashes agree in the upper 32 bits only."""
    longer = substrings._longer

    def upper_equal(h, short, window):
        out = longer(h, short, window)
        return out & np.uint64(0xFFFFFFFF) if window == 13 else out

    monkeypatch.setattr(substrings, "_longer", upper_equal)
    docs = spark.createDataFrame([(i, f"left{i} " + "a b c d e f g h i j k l" + f" right{i}") for i in range(3)],
                                 "doc_id long, text string")
    marked = docs.selectExpr("doc_id AS id", "text")
    marks = [r.h for r in substrings.anchors(marked, 13, 5).select("h").distinct().collect()]
    rows = substrings.full_windows(marked.withColumn("marks", F.array(*[F.lit(h) for h in marks])), 13, 5)
    assert rows.count() >= 3
    assert substrings._compare(rows).count() == substrings._aggregate(rows).count() == 0
