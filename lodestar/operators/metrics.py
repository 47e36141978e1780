"""Classifier metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.sources.files import stored


def accuracy_f1(df: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    """M7 + M8 in one pass: accuracy and F1 of the positive class."""
    y, p = F.col(label), F.col(prediction)
    tp = F.count_if((y == 1) & (p == 1))
    fp = F.count_if((y == 0) & (p == 1))
    fn = F.count_if((y == 1) & (p == 0))
    return df.agg(F.avg((y == p).cast("double")).alias("accuracy"),
                  F.when(F.lit(2) * tp + fp + fn > 0,
                         (F.lit(2.0) * tp) / (F.lit(2) * tp + fp + fn)).otherwise(F.lit(0.0)).alias("f1"))


def roc_auc(df: DataFrame, label: str = "target", score: str = "p1") -> DataFrame:
    """M9: tie-aware Mann-Whitney AUC without a global window.

    Rows collapse to distinct scores first (so a hot score is one row),
    which are dealt to range partitions of equal size and stored; the
    negatives per partition (one row each) give offsets, and the running
    sum runs inside a partition, however the scores are spread.
    AUC = sum_s pos(s) * (neg_below(s) + neg(s) / 2) / (P * N); null
    when a class is absent."""
    y = F.col(label)
    per = df.groupBy(F.col(score).alias("s")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    per = stored(per.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "auc")
    totals = per.groupBy("part").agg(F.sum("neg").alias("bneg"))
    offs = totals.withColumn("offset", F.coalesce(F.sum("bneg").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "offset")
    w = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (per.join(offs, "part")
              .withColumn("below", F.col("offset") + F.coalesce(F.sum("neg").over(w), F.lit(0))))
    return ranked.agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / F.lit(2.0))).alias("U")
    ).select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("U") / (F.col("P") * F.col("N"))).alias("roc_auc"))


def class_report(df: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    """Per-class precision/recall/f1/support plus macro and weighted
    averages, flattened to long (metric_name, metric_value) rows."""
    conf = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    classes = conf.select(F.col("y").alias("c")).union(conf.select(F.col("p").alias("c"))).distinct()
    tp = conf.filter(F.col("y") == F.col("p")).select(F.col("y").alias("c"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"))
    pp = conf.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    per = (classes.join(tp, "c", "left").join(sup, "c", "left").join(pp, "c", "left").fillna(0, ["tp", "support", "predicted"])
           .withColumn("precision", F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0))
           .withColumn("recall", F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0))
           .withColumn("f1-score", F.when(F.col("precision") + F.col("recall") > 0,
                                    F.lit(2.0) * F.col("precision") * F.col("recall") /
                                    (F.col("precision") + F.col("recall"))).otherwise(0.0)))
    long = per.select(F.explode(F.array(*[
        F.struct(F.concat(F.col("c").cast("string"), F.lit(f"_{m}")).alias("metric_name"),
                 F.col(f"`{m}`").cast("double").alias("metric_value")) for m in ("precision", "recall", "f1-score", "support")]))
        .alias("e")).select("e.*")
    avgs = per.agg(*[F.avg(F.col(f"`{m}`")).alias(f"macro avg_{m}") for m in ("precision", "recall", "f1-score")],
                   *[(F.sum(F.col(f"`{m}`") * F.col("support")) / F.sum("support")).alias(f"weighted avg_{m}")
                     for m in ("precision", "recall", "f1-score")])
    avg_long = avgs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric_name"), F.col(f"`{c}`").alias("metric_value"))
                                               for c in avgs.columns])).alias("e")).select("e.*")
    return long.unionByName(avg_long)


def best_trial(trials: DataFrame, metric: str = "metric_value", direction: str = "maximize") -> DataFrame:
    """Best trial by metric and direction, plus completed count."""
    if direction not in ("maximize", "minimize"):
        raise ValueError("direction must be maximize or minimize")
    key = F.struct(F.col(metric) if direction == "maximize" else -F.col(metric), -F.col("trial"))
    done = trials.filter(F.col(metric).isNotNull())
    return done.agg(F.max_by("trial", key).alias("best_trial"), F.max_by(F.col(metric), key).alias("best_value"),
                    F.count(F.lit(1)).alias("completed_trials"))


def run_facts(run_id: str, facts: dict, spark) -> DataFrame:
    """Long (run_id, key, value) rows of run facts."""
    return spark.createDataFrame([(run_id, str(k), str(v)) for k, v in facts.items()],
                                 "run_id string, key string, value string")
