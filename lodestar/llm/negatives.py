"""Hard-negative mining by a secondary-sort shuffle.

The pairs of an anchor are keyed (anchor, descending score, positives
first, id), dealt out by anchor and sorted inside each partition, so an
iterator reads an anchor's pairs best first. A positive opens a window of
admissible scores; negatives that follow fill the open windows until each
has its number or the scores fall below it. The iterator holds the open
windows of one anchor and nothing else.

Every anchor is scored against every row, block by block, twice: the
first time for its positives, which fix the windows; the second time each
block hands on the negatives that are first in one of the windows within
the block, since the first of all blocks are among the first of their
own. So no pair that can be returned is left out and the shuffle holds at
most (positives + positives * negatives) rows per anchor and block.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component, take no part; shorter vectors count as padded with
zeros; an anchor id on several rows is one anchor (least label, then
least vector); rows with the anchor's id are no partners of it, other
rows that repeat an id or vector are partners of their own; an anchor
without positives, or a positive without negatives, gives no row; a
negative positive score has an empty window; scores beyond 64 bits are
clipped to them; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lodestar.llm.blocks import best_of, cut, lots_for, meet, quantised, scored
from lodestar.llm.common import arrow_map, materialise

ANCHOR_BLOCK = 1024
CANDIDATE_BLOCK = 2048

_PAIR = StructType([StructField("anchor_id", LongType()), StructField("score", LongType()),
                    StructField("id", LongType())])
_MINED = StructType([StructField("anchor_id", LongType()), StructField("positive_id", LongType()),
                     StructField("rank", IntegerType()), StructField("negative_id", LongType()),
                     StructField("positive_score", LongType()), StructField("negative_score", LongType())])


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole score s with
    low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _positives(k: int):
    def pick(scores, anchors, candidates):
        (a_id, a_label), (c_id, c_label) = ([x.to_numpy(zero_copy_only=False) for x in y] for y in (anchors, candidates))
        allowed = (a_label[:, None] == c_label[None, :]) & (a_id[:, None] != c_id[None, :])
        rows, cols = best_of(scores, allowed, c_id, k)
        return a_id[rows], scores[rows, cols], c_id[cols]
    return pick


def _negatives(k: int, low: int, high: int):
    def pick(scores, anchors, candidates):
        a_id, a_label = (x.to_numpy(zero_copy_only=False) for x in anchors[:2])
        c_id, c_label = (x.to_numpy(zero_copy_only=False) for x in candidates)
        windows = [[window(s, low, high) for s in x] for x in anchors[2].to_pylist()]
        wanted = np.zeros(scores.shape, dtype=bool)
        other = (a_label[:, None] != c_label[None, :]) & (a_id[:, None] != c_id[None, :])
        for place in range(max(map(len, windows), default=0)):
            at = np.array([i for i, w in enumerate(windows) if len(w) > place and w[place][0] <= w[place][1]], dtype=int)
            least, most = (np.array([windows[i][place][side] for i in at], dtype=np.int64)[:, None] for side in (0, 1))
            inside = other[at] & (scores[at] >= least) & (scores[at] <= most)
            held = np.where(inside, scores[at], np.iinfo(np.int64).min)
            lines = np.arange(len(at))
            for _ in range(min(k, scores.shape[1])):
                # the first of equal scores has the smallest id
                first = held.argmax(axis=1)
                found = inside[lines, first]
                wanted[at[found], first[found]] = True
                inside[lines, first] = False
                held[lines, first] = np.iinfo(np.int64).min
        rows, cols = np.nonzero(wanted)
        return a_id[rows], scores[rows, cols], c_id[cols]
    return pick


def _emit(ordered: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The streaming pass over sorted pairs."""
    names = _MINED.names
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        anchor, windows = None, []
        for batch in batches:
            out = []
            for a, score, negative, other in zip(*[c.to_pylist() for c in batch.columns]):
                if a != anchor:
                    anchor, windows = a, []
                if not negative:
                    windows.append([other, score, *window(score, low, high), 0])
                    continue
                for w in windows:
                    if w[2] <= score <= w[3] and w[4] < k:
                        w[4] += 1
                        out.append((a, w[0], w[4], other, w[1], score))
                if any(w[4] == k or w[2] > score for w in windows):
                    windows = [w for w in windows if w[4] < k and w[2] <= score]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return arrow_map(ordered, run, _MINED)


def mine(df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50,
         high: int = 95, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor and each of its best ``positives``
    rows of the same label, the first ``negatives`` rows of another label
    with low% to high% of the positive's score."""
    spark = df.sparkSession
    rows = quantised(df.where(label.isNotNull()), id_col, vector, scale, label=label.cast("long"), asked=is_anchor)
    rows = materialise(rows, "vectors")
    anchors = materialise(rows.where("asked").groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select(
        "id", "a.label", "a.v"), "anchors")
    candidates = materialise(cut(rows.select("id", "v", "label"), CANDIDATE_BLOCK, "c"), "blocks")
    if candidates.isEmpty() or anchors.isEmpty():
        return spark.createDataFrame([], _MINED)
    lots = lots_for(candidates)

    def best(asked, extra, pick):
        pairs = meet(cut(asked, ANCHOR_BLOCK, "q"), candidates, lots)
        return scored(pairs, ["id", "label", *extra], ["label"], _PAIR, pick)

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = materialise(best(anchors, [], _positives(positives)).withColumn("place", F.row_number().over(first)).where(
        F.col("place") <= positives).drop("place"), "positives")
    scores = found.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("score").alias("scores"))
    near = best(anchors.join(scores, "id").select("id", "v", "label", "scores"), ["scores"],
                _negatives(negatives, low, high))
    pairs = found.withColumn("negative", F.lit(0)).unionByName(near.withColumn("negative", F.lit(1)))
    ordered = pairs.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "negative", "id")
    return _emit(ordered.select("anchor_id", "score", "negative", "id"), negatives, low, high)
