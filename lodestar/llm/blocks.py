"""Blocks of vectors, scored block against block.

A task cuts the rows it reads into blocks, so no key decides where a row
goes: rows that repeat an id or a vector spread like any others. Blocks
of the candidates are stored once, in lots of a bounded number; a block
of queries is copied to each lot and met there by the lot's blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lodestar.llm.common import arrow_map

# Bounds of a block, and of a lot (candidate blocks that meet in one task).
BLOCK_BYTES = 8 << 20
LOT_BLOCKS = 64
_EXACT = float(1 << 53)
_LOW = -(1 << 63)


def quantised(df: DataFrame, id_col: str, vector: str, scale: float = 256.0, **extra: Column) -> DataFrame:
    """(id, v, extra columns): vectors with all components finite, as
    floor(scale * x)."""
    usable = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    # floor() of a double would be clipped to 64 bits; the remainder keeps it a double
    def down(x):
        y = x.cast("double") * scale
        r = y % 1.0
        return F.when(r < 0, y - r - 1.0).otherwise(y - r)
    return df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, down).alias("v"),
                                   *[c.alias(n) for n, c in extra.items()])


def cut(df: DataFrame, size: int, name: str) -> DataFrame:
    """One row per block of at most ``size`` rows and about BLOCK_BYTES:
    its number, and an array of each column of ``df``."""
    schema = StructType([StructField(f"{name}_block", LongType()),
                         *[StructField(f"{name}_{f.name}", ArrayType(f.dataType)) for f in df.schema.fields]])
    inner, names, most = to_arrow_schema(df.schema), schema.names, BLOCK_BYTES

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held = []

        def block():
            whole = pa.Table.from_batches(held, inner)
            ends = pa.array([0, whole.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, c.combine_chunks()) for c in whole.columns]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], names=names)

        n = bytes_held = 0
        for batch in batches:
            batch = batch.cast(inner)
            offset = 0
            while offset < batch.num_rows:
                each = max(1, batch.nbytes // batch.num_rows)
                part = batch.slice(offset, max(1, min(size - n, (most - bytes_held) // each)))
                held.append(part)
                offset, n, bytes_held = offset + part.num_rows, n + part.num_rows, bytes_held + each * part.num_rows
                if n >= size or bytes_held >= most:
                    yield block()
                    number, n, bytes_held = number + 1, 0, 0
                    held.clear()
        if held:
            yield block()

    return arrow_map(df, run, schema)


def lots_for(candidates: DataFrame) -> int:
    """Lots for stored candidate blocks: of LOT_BLOCKS blocks, or fewer
    where there would be less lots than cores."""
    n = candidates.count()
    return max(1, min(n, max(candidates.sparkSession.sparkContext.defaultParallelism, -(-n // LOT_BLOCKS))))


def meet(queries: DataFrame, candidates: DataFrame, lots: int) -> DataFrame:
    """Every block of queries beside every block of candidates."""
    copies = queries.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    lot = F.pmod(F.xxhash64("c_block"), F.lit(lots)).cast("int")
    return copies.join(candidates.withColumn("lot", lot), "lot")


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros."""
    ends = vectors.offsets.to_numpy()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, clipped to 64 bits."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    top = max(1, width) * np.abs(q).max(initial=0) * np.abs(c).max(initial=0)
    if top < _EXACT:
        return (q @ c.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in c.tolist()]
    return np.array([[min(max(sum(int(a) * b for a, b in zip(row, other)), _LOW), -_LOW - 1) for other in whole]
                     for row in q.tolist()], dtype=np.int64).reshape(len(q), len(c))


def scored(pairs: DataFrame, queries: list[str], candidates: list[str], schema: StructType, pick,
           rows: int = 256) -> DataFrame:
    """Rows that ``pick(scores, query columns, candidate columns)`` makes
    of each pair of blocks, ``rows`` queries at a time. Columns come as
    Arrow arrays, candidates in the order of their ids."""
    names, n_q = schema.names, len(queries) + 1

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                q_v, *q_cols = [batch.column(i)[r].values for i in range(n_q)]
                c_v, c_id, *c_cols = [batch.column(i)[r].values for i in range(n_q, batch.num_columns)]
                order = np.argsort(c_id.to_numpy(zero_copy_only=False), kind="stable")
                q, c, take = matrix(q_v), matrix(c_v)[order], pa.array(order)
                c_cols = [x.take(take) for x in (c_id, *c_cols)]
                for o in range(0, len(q), rows):
                    out = pick(products(q[o:o + rows], c), [x.slice(o, rows) for x in q_cols], c_cols)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    chosen = ["q_v", *[f"q_{x}" for x in queries], "c_v", "c_id", *[f"c_{x}" for x in candidates]]
    return arrow_map(pairs.select(*chosen), run, schema)


def best_of(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest allowed scores of each row, ties
    to the smaller id; in order within a row."""
    rows, cols = np.nonzero(allowed)
    order = np.lexsort((ids[cols], ~scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[best], cols[best]
