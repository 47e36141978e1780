"""Kernel SHAP for any scorer (H3).

A coalition takes some features from the case and the rest from a
background row; its worth v(S) is the score averaged over the background.
The contributions are the weighted least-squares fit of v(S) by sums over
the members of S, under the constraint that all of them add up to
f(x) - base. With all coalitions that is the exact Shapley value; where
there are too many, coalitions are drawn by the kernel's weight of their
size, each with its complement.

All cases share the coalitions, so the normal matrix is factored once, on
the driver, and its solution is linear in v(S): each coalition comes with
one coefficient per feature, and a case's right-hand side accumulates as
plain sums over its scored rows. Cases are exploded in place by
coalitions and background rows, scored in one batch and summed; nothing
but (case, sums) is shuffled.

Defined cases: a background row takes part as often as it occurs; one
feature gets the whole difference; an empty background is an error; no
cases give no rows; text features have a null feature value.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lodestar.operators.features import collect_bounded

MAX_BACKGROUND = 1_000
# Rows a task should hold after the explosion.
ROWS_PER_PARTITION = 1_000_000


def coalitions(d: int, most: int, seed: int = 42) -> list[tuple[int, float]]:
    """(members as bits, weight), without the empty and the full one."""
    if 2 ** d - 2 <= most:
        size = [bin(m).count("1") for m in range(2 ** d)]
        return [(m, (d - 1) / (math.comb(d, size[m]) * size[m] * (d - size[m]))) for m in range(1, 2 ** d - 1)]
    rng = random.Random(seed)
    sizes = range(1, d)
    mass = [(d - 1) / (s * (d - s)) for s in sizes]
    drawn: dict[int, float] = {}
    full = 2 ** d - 1
    while len(drawn) < most:
        members = sum(1 << i for i in rng.sample(range(d), rng.choices(sizes, mass)[0]))
        for m in (members, full - members):
            drawn[m] = drawn.get(m, 0.0) + 1.0
    return sorted(drawn.items())


def solution(chosen: list[tuple[int, float]], d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P, p, q): the contributions are P v - p base + q (f(x) - base)."""
    if d == 1:
        return np.zeros((1, 0)), np.zeros(1), np.ones(1)
    z = np.array([[m >> i & 1 for i in range(d)] for m, _ in chosen], dtype=float)
    w = np.array([x for _, x in chosen])
    # the last feature is what the others leave of the whole difference
    x = z[:, :-1] - z[:, -1:]
    normal = (x * w[:, None]).T @ x
    if np.linalg.matrix_rank(normal) < d - 1:
        raise ValueError("too few coalitions for so many features")
    fit = np.linalg.solve(normal, (x * w[:, None]).T)
    last = fit @ z[:, -1]
    P = np.concatenate([fit, -fit.sum(axis=0, keepdims=True)])
    return P, P.sum(axis=1), np.concatenate([-last, [1.0 + last.sum()]])


def kernel_shap(cases: DataFrame, background: DataFrame, scorer, features: list[str], key: str = "case_id",
                output: str = "p1", max_coalitions: int = 2048, seed: int = 42) -> DataFrame:
    """(instance_id, feature_name, feature_value, shap_value) of every
    case. The background is bounded (MAX_BACKGROUND rows)."""
    spark, d = cases.sparkSession, len(features)
    types = {f.name: f.dataType for f in cases.schema.fields}
    seen = collect_bounded(background.select(*features), MAX_BACKGROUND, "background")
    if not seen:
        raise ValueError("empty background")
    chosen = coalitions(d, max_coalitions, seed)
    P, p, q = solution(chosen, d)
    base = scorer.score(background.select(*[c for c in background.columns])).agg(F.avg(output)).first()[0]
    # two one-row tables, bounded by max_coalitions (or 2^d - 2) and MAX_BACKGROUND
    drawn = spark.createDataFrame([(m, [float(x) for x in P[:, j]]) for j, (m, _) in enumerate(chosen)],
                                  "m bigint, c array<double>").agg(F.collect_list(F.struct("m", "c")).alias("__coalitions"))
    table = spark.createDataFrame(seen, background.select(*features).schema).agg(F.collect_list(F.struct(
        *[F.col(c).alias(f"b{i}") for i, c in enumerate(features)])).alias("__background"))
    per_case = max(1, len(chosen)) * len(seen)
    n_parts = max(spark.sparkContext.defaultParallelism, -(-cases.count() * per_case // ROWS_PER_PARTITION))
    own = scorer.score(cases).select(key, *features, F.col(output).alias("__f")).repartition(n_parts, key)
    rows = own.join(F.broadcast(drawn)).withColumn("__g", F.explode("__coalitions")).drop("__coalitions").join(
        F.broadcast(table)).withColumn("__ref", F.explode("__background")).drop("__background")
    mixed = rows.select(key, "__f", *[F.col(c).alias(f"__x{i}") for i, c in enumerate(features)],
                        F.col("__g.c").alias("__c"),
                        *[F.when(F.col("__g.m").bitwiseAND(F.lit(1 << i).cast("long")) > 0, F.col(c)).otherwise(
                            F.col(f"__ref.b{i}")).alias(c) for i, c in enumerate(features)])
    value = F.col(output)
    found = scorer.score(mixed).groupBy(key).agg(
        F.first("__f").alias("__f"), *[F.first(f"__x{i}").alias(f"__x{i}") for i in range(d)],
        *[(F.sum(value * F.col("__c")[i]) / len(seen)).alias(f"__s{i}") for i in range(d)]) if chosen else \
        own.select(key, "__f", *[F.col(c).alias(f"__x{i}") for i, c in enumerate(features)],
                   *[F.lit(0.0).alias(f"__s{i}") for i in range(d)])
    whole = F.col("__f") - F.lit(base)
    each = [F.struct(F.lit(c).alias("feature_name"),
                     (F.col(f"__x{i}").cast("double") if isinstance(types[c], NumericType) else F.lit(None).cast(
                         "double")).alias("feature_value"),
                     (F.col(f"__s{i}") - F.lit(float(p[i]) * base) + whole * F.lit(float(q[i]))).alias("shap_value"))
            for i, c in enumerate(features)]
    return found.select(F.col(key).alias("instance_id"), F.explode(F.array(*each)).alias("e")).select("instance_id", "e.*")
