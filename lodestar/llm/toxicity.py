"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence that holds evidence words
gets a probability from a logistic model of them; the sentence
probabilities and a small leak are combined by noisy-or into the
document's probability. Only document labels train the model, yet the
fitted sentence probabilities locate the offending sentences.

The classifier is fitted on a bounded sample of labelled rows
(``max_train``); evidence words are those whose document frequencies in
the sample differ by label (log-likelihood ratio), at most
``max_words``. Scoring covers every row and every whole text, map only.

Defined cases: null, empty or evidence-free texts score the leak (the
sample's rate of toxic documents without evidence); null labels are
ignored; a doc_id labelled more than once is toxic if any label says so,
and trains with one of its texts;
without usable labels all score 0; repeated rows score alike; extra
columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType)

from lodestar.llm.common import add_columns, emit_rows, materialise

_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"[^.!?\n]+")
# Words counted per task before the counts are handed to the shuffle.
COUNT_WORDS = 300_000
SAMPLE_SLOTS = 1 << 62


@dataclass(frozen=True)
class Model:
    weights: dict
    bias: float
    leak: float


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that never train: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0)) == 0


def training_sample(docs: DataFrame, marks: DataFrame, label: str, id_col: str, text: str,
                    max_train: int) -> DataFrame:
    """(text, label) of about ``max_train`` labelled rows at most, chosen
    by a hash of the id; only their ids and labels are broadcast. Of rows
    that share an id the one whose text has the least hash is taken."""
    ids = marks.where(F.col(label).isNotNull()).where(~held_out(id_col)) \
        .groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("label"))
    share = min(1.0, max_train / max(1, ids.count()))
    chosen = ids.where(F.pmod(F.xxhash64(id_col, F.lit("train")), F.lit(SAMPLE_SLOTS)) < int(share * SAMPLE_SLOTS))
    rows = docs.select(id_col, F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), id_col)
    return rows.groupBy(id_col).agg(F.min(F.struct(F.xxhash64("text").alias("at"), "text", "label")).alias("row")) \
        .select("row.text", "row.label")


def _evidence(sample: DataFrame, max_words: int, min_ratio: float) -> list[str]:
    """Words that toxic documents hold significantly more often."""
    out = StructType([StructField("word", StringType()), StructField("toxic", LongType()),
                      StructField("clean", LongType())])

    def start():
        counts = (Counter(), Counter())

        def flush():
            keys = list(counts[0].keys() | counts[1].keys())
            cols = [keys, [counts[1][k] for k in keys], [counts[0][k] for k in keys]]
            counts[0].clear()
            counts[1].clear()
            return cols

        def step(texts, marks):
            for t, mark in zip(texts, marks):
                counts[mark].update(set(_WORDS.findall(t.lower())))
            return flush() if len(counts[0]) + len(counts[1]) > COUNT_WORDS else None
        return step, flush

    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return []
    words = emit_rows(sample.select("text", "label"), out, start).groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("c"))
    n = F.col("a") + F.col("c")

    def part(k, total):
        return F.when(k > 0, k * F.log(k / (n * F.lit(total / (pos + neg))))).otherwise(0.0)
    ratio = 2 * (part(F.col("a"), pos) + part(F.col("c"), neg))
    best = words.where((F.col("a") >= 3) & (F.col("a") * neg > F.col("c") * pos)).withColumn("ratio", ratio) \
        .where(F.col("ratio") >= min_ratio).orderBy(F.desc("ratio"), "word").limit(max_words)
    return [r.word for r in best.collect()]


def _bags(sample: DataFrame, words: list[str]) -> list[tuple[int, list[list[int]]]]:
    """Per sampled document its label and, per sentence with evidence,
    the numbers of the evidence words in it."""
    number = {w: i for i, w in enumerate(words)}
    schema = [StructField("bag", ArrayType(ArrayType(IntegerType())))]

    def start():
        def bag(t):
            if not number.keys() & set(_WORDS.findall(t.lower())):
                return []
            found = [sorted({number[w] for w in _WORDS.findall(s.lower()) if w in number})
                     for s in _SENTENCES.findall(t)]
            return [f for f in found if f]
        return lambda texts: [[bag(t) for t in texts]]

    return [(r.label, r.bag) for r in add_columns(sample, "text", schema, start).select("label", "bag").collect()]


def _fit(bags, width: int, rounds: int, penalty: float) -> tuple[np.ndarray, float, float]:
    """Gradient ascent on the noisy-or likelihood of the bag labels."""
    label = np.array([y for y, _ in bags], dtype=float)
    doc = np.array([i for i, (_, b) in enumerate(bags) for _ in b], dtype=np.int64)
    sentences = [s for _, b in bags for s in b]
    row = np.array([i for i, s in enumerate(sentences) for _ in s], dtype=np.int64)
    col = np.array([w for s in sentences for w in s], dtype=np.int64)
    bare = np.array([not b for _, b in bags])
    leak = float((label[bare].sum() + 0.05) / (bare.sum() + 1)) if bare.any() else 0.01
    leak = min(leak, 0.49)
    # a sentence's evidence starts near certainty only as the labels say so
    w, b = np.ones(width), -1.0
    first, second, k = np.zeros(width + 1), np.zeros(width + 1), 0
    for k in range(1, rounds + 1):
        z = b + np.bincount(row, weights=w[col], minlength=len(sentences))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.log1p(-leak) + np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(bags))
        some = -np.expm1(log_none)
        # d logL / d z_s = p_s * (y / P - 1)
        g = p * (label / np.maximum(some, 1e-9) - 1)[doc]
        grad = np.append(np.bincount(col, weights=g[row], minlength=width) - penalty * w, g.sum() - penalty * b)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = 0.1 * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.999 ** k)) + 1e-8)
        w, b = w + move[:-1], b + float(move[-1])
    return w, b, leak


def fit(docs: DataFrame, marks: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text",
        max_train: int = 20_000, max_words: int = 4096, min_ratio: float = 15.0, rounds: int = 400,
        penalty: float = 0.05) -> Model:
    sample = materialise(training_sample(docs, marks, label, id_col, text, max_train), "toxic-train")
    words = _evidence(sample, max_words, min_ratio)
    bags = _bags(sample, words)
    if not bags:
        return Model({}, 0.0, 0.0)
    w, b, leak = _fit(bags, len(words), rounds, penalty)
    return Model(dict(zip(words, w.tolist())), b, leak)


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with score, predicted and offending: spans (code points,
    end exclusive) and probability of the sentences at or above
    ``threshold``. The model is bounded by ``max_words`` words."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.leak))
    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType()),
              StructField("offending", ArrayType(StructType([
                  StructField("start", LongType()), StructField("end", LongType()),
                  StructField("probability", DoubleType())])))]

    def start():
        weights, bias, leak = shared.value

        def judge(t):
            if not t or not weights.keys() & set(_WORDS.findall(t.lower())):
                return leak, []
            none, spans = 1 - leak, []
            for s in _SENTENCES.finditer(t):
                held = weights.keys() & set(_WORDS.findall(s.group().lower()))
                if held:
                    p = float(1 / (1 + np.exp(-np.clip(bias + sum(weights[w] for w in sorted(held)), -30, 30))))
                    none *= 1 - p
                    if p >= threshold:
                        spans.append({"start": s.start(), "end": s.end(), "probability": p})
            return 1 - none, spans

        def work(texts):
            out = [judge(t) for t in texts]
            return [[s for s, _ in out], [int(s >= threshold) for s, _ in out], [o for _, o in out]]
        return work

    return add_columns(df, text, fields, start)
