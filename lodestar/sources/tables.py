"""Scans of the input tables and the case tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.spec import PRIORITY_LEVELS


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def level_map(mapping: dict) -> "F.Column":
    """A literal map<string,double> column from a fixed lookup."""
    args = []
    for k, v in mapping.items():
        args += [F.lit(k), F.lit(float(v))]
    return F.create_map(*args)


def order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per order.

    lineitem is aggregated per order first (map-side partial aggregation
    before the shuffle), customer joins on its key, nation/region join
    by the planner's size estimate (AQE broadcasts small sides at run
    time). The last join is on the order
    key, so the result stays hash-partitioned by ``case_id`` and the
    per-case window of the search needs no further shuffle.
    """
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"])
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum("l_quantity").alias("sum_qty"),
        F.avg("l_discount").alias("avg_discount"),
        F.sum(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("revenue"),
    )
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    geo = (read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
           .join(read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"]),
                 F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    cust = customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    base = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
    joined = base.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_totalprice").alias("total_price"),
        F.col("c_acctbal").alias("acct_bal"),
        F.col("line_count"),
        F.col("sum_qty"),
        F.col("avg_discount"),
        level_map(PRIORITY_LEVELS)[F.col("o_orderpriority")].alias("priority_num"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
        (F.coalesce(F.col("revenue"), F.lit(0.0)) > F.lit(200000.0)).cast("int").alias("target"),
    )


def document_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second case table: labelled documents, target = quality."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    return (docs.join(labels, "doc_id", "inner")
            .select(F.col("doc_id").alias("case_id"), "n_chars", "lang", "source",
                    F.col("quality").cast("int").alias("target")))
