"""Artifact store: partitioned parquet tables.

Each artifact table is a folder partitioned by (model_name, run_id), so
a run's rows are pruned at scan time and a re-run replaces exactly its
own partitions (dynamic partition overwrite) instead of deleting rows.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lodestar.sources.files import is_missing, stored

PARTITIONS = ["model_name", "run_id"]
# The records' JSON text is a fraction of what Spark's default makes of it.
COMPRESSION = "zstd"
CLUSTER_REQUIRED = {"id", "instance_id", "cluster_id"}


def _path(root: str, table: str) -> str:
    return os.path.join(root, table)


def append(df: DataFrame, root: str, table: str, run_id: str | None = None, model_name: str | None = None,
           created_at=None) -> int:
    """S3/S4 generic append with provenance; an empty frame is a no-op
    (checked with a one-row probe, not a count)."""
    if not df.take(1):
        return 0
    prov = {}
    if run_id is not None:
        prov["run_id"] = F.lit(run_id)
    if model_name is not None:
        prov["model_name"] = F.lit(model_name)
    if created_at is not None:
        prov["created_at"] = F.lit(created_at).cast("timestamp")
    out = df.withColumns(prov) if prov else df
    out.write.mode("append").option("compression", COMPRESSION).partitionBy(*PARTITIONS).parquet(_path(root, table))
    return 1


def append_metrics(metrics: dict | DataFrame, root: str, run_id: str, model_name: str, created_at, spark=None) -> int:
    """Keep only numeric metric values, cast to double, long form."""
    if isinstance(metrics, dict):
        rows = [(k, float(v)) for k, v in metrics.items()
                if isinstance(v, (int, float)) and not isinstance(v, bool)]
        df = spark.createDataFrame(rows, "metric_name string, metric_value double")
    else:
        nums = [f.name for f in metrics.schema.fields if isinstance(f.dataType, NumericType)]
        df = metrics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric_name"),
                                                         F.col(c).cast("double").alias("metric_value"))
                                                for c in nums])).alias("m")).select("m.*")
    return append(df, root, "metrics", run_id, model_name, created_at)


def append_clusters(df: DataFrame, root: str, run_id: str, model_name: str, created_at) -> int:
    """Requires id, instance_id, cluster_id; id -> counterfactual_id."""
    missing = CLUSTER_REQUIRED - set(df.columns)
    if missing:
        raise ValueError(f"cluster assignments need columns {sorted(missing)}")
    out = df.select(F.col("id").alias("counterfactual_id"), "instance_id", F.col("cluster_id").cast("int"))
    return append(out, root, "counterfactual_clusters", run_id, model_name, created_at)


def rules_json(rules: DataFrame) -> DataFrame:
    """S7 export: ``conditions`` as a JSON array of strings."""
    return rules.withColumn("conditions", F.to_json("conditions"))


def append_rules(df: DataFrame, root: str, run_id: str, model_name: str, created_at) -> int:
    """Rules keep ``conditions`` as array<string> (``rules_json`` on export)."""
    return append(df, root, "global_rules", run_id, model_name, created_at)


def replace_run(df: DataFrame, root: str, table: str) -> None:
    """Idempotent re-run: overwrite only the (model, run) partitions
    present in ``df`` (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", COMPRESSION)
     .partitionBy(*PARTITIONS).parquet(_path(root, table)))


def read(spark: SparkSession, root: str, table: str, run_id: str | None = None,
         model_name: str | None = None) -> DataFrame:
    """Scan with partition pruning on the run keys."""
    df = spark.read.parquet(_path(root, table))
    if run_id is not None:
        df = df.filter(F.col("run_id") == run_id)
    if model_name is not None:
        df = df.filter(F.col("model_name") == model_name)
    return df


def with_surrogate_ids(df: DataFrame, start_after: int = 0, id_col: str = "id") -> DataFrame:
    """Consecutive ids start_after+1 .. start_after+n without a global
    window: pass 1 counts rows per partition (one small row each), the
    prefix offsets are computed on the driver over #partitions values,
    pass 2 adds the offset to the row's position inside its partition."""
    spark = df.sparkSession
    tagged = df.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    # stored, so that both passes see the same partitions and positions
    tagged = stored(tagged, "tagged")
    # monotonically_increasing_id = (partition << 33) + position in partition
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, acc = [], start_after
    for r in sorted(counts, key=lambda r: r["__pid"]):
        offsets.append((r["__pid"], acc))
        acc += r["n"]
    # one row per partition of the stored frame
    off = spark.createDataFrame(offsets or [(0, start_after)], "__pid int, __off bigint")
    pos = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    return (tagged.join(off, "__pid")
            .withColumn(id_col, F.col("__off") + pos + F.lit(1))
            .drop("__pid", "__mid", "__off"))


def next_id(spark: SparkSession, root: str, table: str, id_col: str = "id") -> int:
    """Max existing id of a stored table (0 when empty or absent)."""
    try:
        row = spark.read.parquet(_path(root, table)).agg(F.max(id_col)).first()
        return int(row[0] or 0)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return 0
