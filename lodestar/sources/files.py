"""File sources and sinks (S1, S2, S10) and the raw text case table."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestar.session import shared_dir

# Null tokens of the raw text format.
NULL_TOKENS = (" ?", "?")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_missing(error: AnalysisException) -> bool:
    """The read failed because there is no such path, not otherwise."""
    return error.getCondition() == "PATH_NOT_FOUND"


def read_headerless_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Headerless CSV with fixed names; every cell read as text
    (explicit schema, no inference); a malformed cell becomes null
    (PERMISSIVE), null tokens become null."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", "false").option("mode", "PERMISSIVE") \
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return df.withColumns({c: F.when(F.col(c).isin(list(NULL_TOKENS)), F.lit(None).cast("string")).otherwise(F.col(c))
                           for c in columns})


def write_headerless_csv(df: DataFrame, path: str) -> str:
    (df.write.mode("overwrite").option("header", "false").option("nullValue", NULL_TOKENS[0])
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    return path


def parquet_cache(spark: SparkSession, path: str, build) -> DataFrame:
    """Read the parquet cache if present, else build, write and read it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def write_report_json(report: DataFrame, path: str) -> DataFrame:
    """The long report written as JSON lines and read back."""
    report.write.mode("overwrite").json(path)
    return report.sparkSession.read.schema(report.schema).json(path)


RAW_COLUMNS = ["case_id", "total_price", "acct_bal", "line_count", "sum_qty", "avg_discount",
               "segment", "priority", "status", "nation", "region", "label"]


def raw_order_text(cases: DataFrame) -> DataFrame:
    """The order cases in the raw census-like text form: every value as
    text with a leading space, missing values as the ' ?' token, the
    label as ' >200K' / ' <=200K' ('.' appended for pending orders)."""
    def txt(c):
        return F.when(F.col(c).isNull(), F.lit(" ?")).otherwise(F.concat(F.lit(" "), F.col(c).cast("string")))
    label = F.concat(F.lit(" "), F.when(F.col("target") == 1, F.lit(">200K")).otherwise(F.lit("<=200K")),
                     F.when(F.col("status") == "P", F.lit(".")).otherwise(F.lit("")))
    return cases.select(F.col("case_id").cast("string").alias("case_id"),
                        *[txt(c).alias(c) for c in RAW_COLUMNS[1:-1]], label.alias("label"))
