"""Exact top-k search by inner product with distributed histograms.

Everything is scored, block of candidates by block of queries. Each pass
sums, per query, a global histogram of the scores in the interval that
holds the kth best; the bucket in which the running count from the top
reaches k is the next interval, until it is one integer wide and the kth
value is known. The last pass keeps scores over it and, of the ties, the
smallest ids.

The queries are a stated set, so every (query block, candidate block)
pair is scored once per pass; candidate blocks are stored once, in lots
that the query blocks are copied to, and scores never leave the task. A
pair sends only the buckets that hold its own k best, since the kth best
of all is no smaller than its own.

Defined cases: vectors that are null, hold a null or a non-finite
component, or have no id take no part; shorter vectors count as padded
with zeros; a query's own row is left out by id; a query id on several
rows is one query (the least vector); other rows that repeat an id or a
vector are candidates of their own; extra columns are ignored; a query with fewer
candidates gets all of them; an empty table gives an empty table; scores
beyond 64 bits are clipped to them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lodestar.llm.blocks import best_of, cut, lots_for, meet, quantised, scored
from lodestar.llm.common import materialise

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 2048
BUCKETS = 1024
_LOW = -(1 << 63)


def _arrays(columns) -> list[np.ndarray]:
    return [x.to_numpy(zero_copy_only=False) for x in columns]


def _histogram(k: int):
    def pick(scores, queries, candidates):
        (qi, low, width), (ci,) = _arrays(queries), _arrays(candidates)
        n = len(qi)
        bucket = np.clip((scores - low[:, None]) // width[:, None], -1, BUCKETS)
        own = ci[None, :] == qi[:, None]
        bucket[own | (scores < low[:, None])] = -1
        counts = np.bincount((np.arange(n)[:, None] * (BUCKETS + 2) + bucket + 1).ravel(),
                             minlength=n * (BUCKETS + 2)).reshape(n, BUCKETS + 2)[:, 1:]
        over = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        row, at = np.nonzero((counts > 0) & (over < k))
        return qi[row], at.astype(np.int64), counts[row, at].astype(np.int64)
    return pick


def _survivors(k: int):
    def pick(scores, queries, candidates):
        (qi, low, _), (ci,) = _arrays(queries), _arrays(candidates)
        rows, cols = best_of(scores, (scores >= low[:, None]) & (ci[None, :] != qi[:, None]), ci, k)
        return qi[rows], ci[cols], scores[rows, cols]
    return pick


def search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
           scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of each query
    row, ties to the smaller id."""
    spark = df.sparkSession
    tagged = df.select(id_col, vector, is_query.alias("__query"))
    rows = materialise(quantised(tagged, id_col, vector, scale), "vectors")
    asked = materialise(quantised(tagged.where("__query"), id_col, vector, scale).groupBy("id").agg(
        F.min("v").alias("v")), "queries")
    n_queries, n_rows = asked.count(), rows.count()
    schema = StructType([StructField("query_id", LongType()), StructField("rank", IntegerType()),
                         StructField("id", LongType()), StructField("score", LongType())])
    if not n_queries or not n_rows:
        return spark.createDataFrame([], schema)
    # no score exceeds the product of the norms
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = rows.agg(F.max(norm)).first()[0] or 0.0
    limit = F.least(F.lit(float(1 << 62)), F.ceil(norm * F.lit(longest) * 1.0000001) + 1).cast("long")
    state = asked.select("id", (-limit).alias("low"), F.ceil((2 * limit + 1) / F.lit(BUCKETS)).cast("long")
                         .alias("width"))
    state = materialise(state, "interval")
    candidates = materialise(cut(rows, CANDIDATE_BLOCK, "c"), "blocks")
    lots = lots_for(candidates)

    def passed(schema, pick):
        now = asked.join(state, "id").select("id", "v", "low", "width")
        return scored(meet(cut(now, QUERY_BLOCK, "q"), candidates, lots), ["id", "low", "width"], [], schema, pick)

    counted = StructType([StructField("id", LongType()), StructField("bucket", LongType()),
                          StructField("n", LongType())])
    while True:
        sums = passed(counted, _histogram(k)).groupBy("id", "bucket").agg(F.sum("n").alias("n"))
        running = F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("bucket")))
        # scores over the interval fall in its last bucket + 1 and were counted in earlier passes
        kth = sums.withColumn("upto", running).where(F.col("upto") >= k).groupBy("id") \
            .agg(F.max(F.struct("bucket", "upto", "n")).alias("e"))
        moved = state.join(kth, "id", "left")
        at = F.col("low") + F.col("e.bucket") * F.col("width")
        state = materialise(moved.select(
            "id", F.when(F.col("e").isNull(), F.lit(_LOW)).otherwise(at).alias("low"),
            F.when(F.col("e").isNull(), 1).otherwise(F.ceil(F.col("width") / BUCKETS)).cast("long").alias("width"),
            (F.col("e").isNull() | (F.col("width") == 1)).alias("known")), "interval")
        if state.where("NOT known").isEmpty():
            break
        state = state.select("id", "low", "width")
    found = StructType([StructField("query_id", LongType()), StructField("id", LongType()),
                        StructField("score", LongType())])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return passed(found, _survivors(k)).withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
