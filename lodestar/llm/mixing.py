"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash. A source takes all its documents
as often as its target fits whole, and once more those whose hash lies
below the source's threshold, so larger budgets take supersets. The
threshold comes from sums of tokens by (source, hash bucket): the running
sum finds the bucket where the budget ends, and only the documents of
that boundary bucket are summed again by the next hash bits, until it
holds one document. Nothing is sorted but bucket sums.

Defined cases: a null text has size 0; a null source is a source of its
own, last in order; an empty table gives an empty table; rows that repeat
doc_id and text share a hash and are taken alike; extra columns are kept
by ``mix``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, materialise

HASH_BITS = 60
LEVEL_BITS = 12


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def place(*columns: str) -> Column:
    """The row's place on the hash line, 0 to 2^60 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - HASH_BITS)


def targets(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size): sources in code
    point order, null last, weigh ``weights`` repeating and share all
    sizes; a target stops at ``cap`` times its source's size and the
    excess is reshared by weight. Water level in closed form: by rising
    cap / weight, a source is capped if the level without the capped ones
    before it exceeds its cap / weight. One row per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                  ((order - 1) % len(weights) + 1).cast("int"))) \
        .withColumn("full", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    open_ = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    marked = weighed.withColumn("capped", F.col("full") / F.col("w") < left / open_)
    level = (F.sum("source_size").over(everything) - F.sum(F.when(F.col("capped"), F.col("full")).otherwise(0.0))
             .over(everything)) / F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("capped"), F.col("full")).otherwise(F.least(F.col("w") * level, F.col("full")))
    return marked.withColumn("target", target).select("source", "source_size", "target")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with copies, how often all documents of the source are
    taken, and threshold: those placed below it are taken once more.
    ``sized``: source, size, place."""
    size = F.col("source_size")
    copies = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = plan.withColumn("copies", copies).withColumn(
        "rest", F.when(size > 0, F.col("target") - F.col("copies") * size).otherwise(0.0)) \
        .withColumn("prefix", F.lit(0).cast("long"))
    # resolved: the threshold where it is known, else null
    state = materialise(state.withColumn("threshold", F.when(F.col("rest") <= 0, F.lit(0).cast("long"))), "mix")
    for level in range(HASH_BITS // LEVEL_BITS):
        above, low = HASH_BITS - LEVEL_BITS * level, HASH_BITS - LEVEL_BITS * (level + 1)
        open_ = state.where("threshold IS NULL")
        inside = sized.join(open_, _same(sized, open_)).where(F.shiftright("place", above) == F.col("prefix")) \
            .select(sized["source"], "size", F.shiftright("place", low).alias("bucket"))
        sums = inside.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
        running = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        edge = sums.withColumn("upto", running)
        edge = edge.join(open_.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))) \
            .where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "n", "docs", "upto"))
                                                                        .alias("e"))
        near = state.join(edge, _same(state, edge), "left").select(state["*"], "e.bucket", "e.n", "e.docs", "e.upto")
        left = F.col("rest") - (F.col("upto") - F.col("n"))
        last = (F.col("docs") == 1) | F.lit(low == 0)
        # the boundary document itself is taken if that comes nearer
        end = F.shiftleft(F.col("bucket") + F.when(F.col("n") <= 2 * left, 1).otherwise(0), low)
        known = F.when(F.col("threshold").isNotNull(), F.col("threshold")) \
            .when(F.col("bucket").isNull(), F.shiftleft(F.col("prefix") + 1, above)) \
            .when(last, end)
        state = materialise(near.select("source", "source_size", "target", "copies",
                                        F.coalesce(left, F.col("rest")).alias("rest"),
                                        F.coalesce("bucket", "prefix").alias("prefix"), known.alias("threshold")), "mix")
        if state.where("threshold IS NULL").isEmpty():
            break
    return state.select("source", "source_size", "target", "copies", "threshold")


def sized_rows(df: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    return df.select(F.col(id_col).alias(id_col), F.col(source).alias("source"), word_count(text).alias("size"),
                     place(id_col, text).alias("place"))


def shares(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
           weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """One row per row of ``df``: id_col, size, source_size, target and
    taken (words the mix takes of it, repeats counted)."""
    sized = materialise(sized_rows(df, id_col, text, source), "sizes")
    plan = thresholds(sized, targets(sized, weights, cap))
    return sized.join(plan, _same(sized, plan)).select(
        id_col, "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def _times() -> Column:
    return F.col("copies") + (F.col("place") < F.col("threshold")).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them."""
    columns = df.columns
    sized = materialise(sized_rows(df, id_col, text, source), "sizes")
    plan = thresholds(sized, targets(sized, weights, cap)).select(
        F.col("source").alias("__source"), "copies", "threshold")
    here = reduce(lambda d, c: d.withColumnRenamed(c, f"__x_{c}") if c in ("copies", "threshold", "place") else d,
                  columns, df)
    taken = here.withColumn("place", place(id_col, text)).join(plan, F.col(source).eqNullSafe(F.col("__source"))) \
        .withColumn("__copy", F.explode(F.expr("array_repeat(0, cast(copies + int(place < threshold) as int))")))
    return taken.select(*[F.col(f"`__x_{c}`" if c in ("copies", "threshold", "place") else f"`{c}`").alias(c)
                          for c in columns])
