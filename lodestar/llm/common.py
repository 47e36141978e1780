"""Helpers the operators of this package share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from lodestar.sources.files import scratch_path

# Fixed value: a word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Rows handed to Python code at once; bounds the memory of a task.
SLICE_ROWS = 256
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it
    back: computed once, cut lineage, survives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less its columns of these names (any case): an operator's
    own output columns replace clashing extra ones."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where
    the body refers to it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def arrow_map(df: DataFrame, run, schema: StructType) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes, not only by rows:
    texts are long, and a batch is held by the JVM and by the worker.
    A size that the user has set is kept."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, source: str, fields: list[StructField], start) -> DataFrame:
    """``df`` with the columns ``fields`` computed from column ``source``
    in Arrow batches, without a shuffle. ``start()`` runs once per task
    and returns a function from a list of values to a list of columns."""
    df = without(df, *[f.name for f in fields])
    schema = StructType([*df.schema.fields, *fields])
    names = schema.names
    at = [c.lower() for c in df.columns].index(source.lower())
    types = [to_arrow_type(f.dataType) for f in fields]
    rows = SLICE_ROWS

    def run(batches):
        work = start()
        for batch in batches:
            for offset in range(0, batch.num_rows, rows):
                part = batch.slice(offset, rows)
                new = work(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(v, t) for v, t in zip(new, types)]], names=names)

    return arrow_map(df, run, schema)


def emit_rows(df: DataFrame, schema: StructType, start) -> DataFrame:
    """Rows of ``schema`` made from Arrow batches of ``df``. ``start()``
    runs once per task and returns ``(step, finish)``: ``step(columns)``
    gets the batch as lists by column and returns output columns (or
    None), ``finish()`` what is left at the task's end."""
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    names = schema.names
    columns = df.columns
    rows = SLICE_ROWS

    def build(out):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    def run(batches):
        step, finish = start()
        for batch in batches:
            for offset in range(0, batch.num_rows, rows):
                part = batch.slice(offset, rows)
                out = step(*[part.column(i).to_pylist() for i in range(len(columns))])
                if out is not None and len(out[0]):
                    yield build(out)
        out = finish()
        if out is not None and len(out[0]):
            yield build(out)

    return arrow_map(df, run, schema)
