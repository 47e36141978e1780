"""Cluster profiles, distilled rules and rule quality.

All per-cluster work is one grouped pass over the labelled rows (no
per-cluster loop); everything after the profiles is k rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.columns import (clamp01, condition_key, percent0, readable_transition,
                                        signed3)

# Rule wording and default thresholds.
NO_PATTERN = "No dominant intervention pattern"
THEN_TEXT = "THEN model prediction reaches the counterfactual target class"
MIN_CHANGE_RATE = 0.80
MIN_TRANSITION_RATE = 0.10
MIN_ABS_DELTA = 0.05
TOP_TRANSITIONS = 10
COVERAGE_WEIGHT, COMPACTNESS_WEIGHT, DISTANCE_WEIGHT = 0.40, 0.30, 0.30


def cluster_sizes(labelled: DataFrame, run_keys=()) -> DataFrame:
    """Size, share and mean distance per cluster (NaN without distance)."""
    keys = list(run_keys)
    per = labelled.groupBy(*keys, "cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        (F.avg("distance") if "distance" in labelled.columns else F.lit(float("nan"))).alias("avg_distance"))
    totals = labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")) if keys else \
        labelled.agg(F.count(F.lit(1)).alias("total"))
    joined = per.join(totals, keys, "inner") if keys else per.join(totals.withColumn("__k", F.lit(1)),
                                                                   F.lit(1) == F.col("__k")).drop("__k")
    return joined.withColumn("share", F.col("size") / F.col("total")).drop("total")


def feature_profile(labelled: DataFrame, numeric: list[str], categorical: list[str], run_keys=()) -> DataFrame:
    """R2 + R3 long: (cluster, feature, ord, change_rate, avg_delta)."""
    keys = list(run_keys)
    feats = list(numeric) + list(categorical)
    # one row per cluster first, the features as rows of that
    flag = lambda f: F.col(f"{f}__changed").cast("int")
    wide = labelled.groupBy(*keys, "cluster_id").agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(flag(f)).alias(f"__f{i}") for i, f in enumerate(feats)],
        *[F.avg(f"{f}__delta").alias(f"__d{i}") for i, f in enumerate(numeric)])
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("ord"),
                                 (F.col(f"__f{i}") / F.col("__n")).alias("change_rate"),
                                 (F.col(f"__d{i}") if i < len(numeric) else F.lit(None).cast("double")).alias("avg_delta"))
                        for i, f in enumerate(feats)])
    return wide.select(*keys, "cluster_id", F.explode(entries).alias("e")).select(*keys, "cluster_id", "e.*")


def transition_profile(labelled: DataFrame, run_keys=(), top_n: int = TOP_TRANSITIONS) -> DataFrame:
    """Top-n transitions per cluster by rate (rate > 0), ties by token."""
    from pyspark.sql.window import Window
    keys = list(run_keys)
    size = cluster_sizes(labelled, keys).select(*keys, "cluster_id", "size")
    counts = (labelled.select(*keys, "cluster_id", F.explode("tokens").alias("token"))
              .groupBy(*keys, "cluster_id", "token").agg(F.count(F.lit(1)).alias("n")))
    rated = counts.join(size, keys + ["cluster_id"]).withColumn("rate", F.col("n") / F.col("size"))
    w = Window.partitionBy(*keys, "cluster_id").orderBy(F.col("rate").desc(), "token")
    return (rated.filter(F.col("rate") > 0).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= top_n).select(*keys, "cluster_id", "token", "rate", "rank"))


def extract_rules(sizes: DataFrame, features: DataFrame, transitions: DataFrame, numeric: list[str],
                  run_keys=(), min_change_rate: float = MIN_CHANGE_RATE,
                  min_transition_rate: float = MIN_TRANSITION_RATE, min_abs_delta: float = MIN_ABS_DELTA) -> DataFrame:
    """Ordered condition list per cluster.

    Features by change rate desc (ties: declared order) with rate >=
    min_change_rate; a numeric with |avg delta| >= min_abs_delta reads
    'f tends to increase|decrease (avg normalized delta +0.123)', any
    other 'f changes (NN% of cluster)'; then transitions with rate >=
    min_transition_rate as 'f: A -> B (NN%)'; no condition -> the
    no-pattern text."""
    keys = list(run_keys)
    is_num = F.col("feature").isin(list(numeric)) if numeric else F.lit(False)
    directional = is_num & F.col("avg_delta").isNotNull() & (F.abs("avg_delta") >= F.lit(min_abs_delta))
    ftext = F.when(directional, F.concat(
        F.col("feature"), F.lit(" tends to "),
        F.when(F.col("avg_delta") > 0, F.lit("increase")).otherwise(F.lit("decrease")),
        F.lit(" (avg normalized delta "), signed3("avg_delta"), F.lit(")"))
    ).otherwise(F.concat(F.col("feature"), F.lit(" changes ("), percent0("change_rate"), F.lit(" of cluster)")))
    fconds = features.filter(F.col("change_rate") >= F.lit(min_change_rate)).select(
        *keys, "cluster_id", F.struct(F.lit(0).alias("section"), (-F.col("change_rate")).alias("neg"),
                                      F.col("ord").cast("int").alias("ord"), ftext.alias("text")).alias("c"))
    tconds = transitions.filter(F.col("rate") >= F.lit(min_transition_rate)).select(
        *keys, "cluster_id", F.struct(F.lit(1).alias("section"), F.lit(0.0).alias("neg"),
                                      F.col("rank").cast("int").alias("ord"),
                                      F.concat(readable_transition("token"), F.lit(" ("), percent0("rate"),
                                               F.lit(")")).alias("text")).alias("c"))
    conds = (fconds.unionByName(tconds).groupBy(*keys, "cluster_id")
             .agg(F.array_sort(F.collect_list("c")).alias("cs"))
             .select(*keys, "cluster_id", F.transform("cs", lambda s: s["text"]).alias("conditions")))
    out = sizes.join(conds, keys + ["cluster_id"], "left")
    return out.withColumn("conditions", F.coalesce(F.col("conditions"), F.array(F.lit(NO_PATTERN)))) \
        .withColumn("support", F.col("size").cast("int"))


def check_weights(coverage: float = COVERAGE_WEIGHT, compactness: float = COMPACTNESS_WEIGHT,
                  distance: float = DISTANCE_WEIGHT):
    total = coverage + compactness + distance
    if not 0.99 <= total <= 1.01:
        raise ValueError("rule quality weights must sum to 1.0")


def rule_quality(rules: DataFrame, coverage_weight: float = COVERAGE_WEIGHT,
                 compactness_weight: float = COMPACTNESS_WEIGHT, distance_weight: float = DISTANCE_WEIGHT) -> DataFrame:
    """Compactness 1/n (0 if none), proximity clamp(1 - d) (a null
    or NaN distance scores 1.0, G4), quality = weighted sum."""
    check_weights(coverage_weight, compactness_weight, distance_weight)
    n = F.size("conditions")
    compact = F.when(n > 0, F.lit(1.0) / n).otherwise(F.lit(0.0))
    d = F.coalesce(F.col("avg_distance"), F.lit(float("nan")))
    prox = clamp01(F.lit(1.0) - d)
    q = (F.lit(coverage_weight) * F.col("share") + F.lit(compactness_weight) * compact
         + F.lit(distance_weight) * prox)
    return rules.withColumns({"condition_count": n, "coverage": F.col("share"), "compactness": compact,
                              "distance_score": prox, "quality_score": q})


def condition_tokens(conditions) -> "F.Column":
    """Set of normalised condition keys."""
    return F.array_distinct(F.transform(conditions, lambda c: condition_key(c)))


def jaccard(a, b) -> "F.Column":
    """|A & B| / |A | B|, 0 when both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


def rule_pairs(rules: DataFrame, run_keys=()) -> DataFrame:
    """All unordered pairs of rules of the same run (k rows a side)."""
    keys = list(run_keys)
    a = rules.select(*keys, F.col("cluster_id").alias("cluster_a"), condition_tokens("conditions").alias("ta"))
    b = rules.select(*keys, F.col("cluster_id").alias("cluster_b"), condition_tokens("conditions").alias("tb"))
    cond = [a[k] == b[k] for k in keys] + [F.col("cluster_a") < F.col("cluster_b")]
    joined = a.join(b, cond[0] if len(cond) == 1 else __import__("functools").reduce(lambda x, y: x & y, cond))
    return joined.select(*[a[k] for k in keys], "cluster_a", "cluster_b", jaccard("ta", "tb").alias("similarity"))


def rule_sentence(conditions) -> "F.Column":
    """R16: 'IF c1 AND c2 ... THEN ...'."""
    lines = F.transform(conditions, lambda c, i: F.concat(F.when(i == 0, F.lit("IF ")).otherwise(F.lit("AND ")), c))
    return F.concat(F.array_join(lines, " "), F.lit(" " + THEN_TEXT))
