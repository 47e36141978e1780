"""Streaming use of the row-wise operators.

The reference has no streaming operators; what carries over is that
cleaning (P10/P11/P20), reconciliation (P19), binning (P12) and scoring
(M4/M5) are plain Column expressions, so they run unchanged on a
streaming DataFrame. New orders arrive as a stream and are joined to the
static dimension tables and the per-order line aggregate (stream-static
joins), then cleaned and scored micro-batch by micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import features as feat
from lodestar.operators.scoring import ORDER_SCORECARD
from lodestar.sources.tables import PRIORITY_LEVELS, level_map, read_table
from lodestar.sources.files import stored
from lodestar.spec import ORDER_CASES


def order_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """Orders as a file stream (explicit schema, no inference)."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", "orders*.parquet").parquet(sf_dir))


def scored_order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming case rows with margin, p1 and prediction."""
    orders = order_stream(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"])
    # static side: aggregated once, not again by every micro-batch
    per_order = stored(li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("l_quantity").alias("sum_qty"),
        F.avg("l_discount").alias("avg_discount"),
        F.sum(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("revenue")), "per-order")
    geo = (read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
           .join(read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"]),
                 F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]) \
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    joined = (orders.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
              .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    cases = joined.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("total_price"),
        F.col("c_acctbal").alias("acct_bal"), "line_count", "sum_qty", "avg_discount",
        level_map(PRIORITY_LEVELS)[F.col("o_orderpriority")].alias("priority_num"),
        F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
        (F.coalesce(F.col("revenue"), F.lit(0.0)) > F.lit(200000.0)).cast("int").alias("target"))
    prepared = feat.reconcile(feat.derive(cases, ORDER_CASES), ORDER_CASES)
    return ORDER_SCORECARD.score(prepared)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain everything available (availableNow) into a parquet sink."""
    q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).outputMode("append").start())
    q.awaitTermination()
