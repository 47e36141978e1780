"""Raw-table preparation, splits and samples.

Splits and samples rank rows by a hash draw of (key, seed), so they are
reproducible, partition independent and never need a global window:
per-class quotas are resolved from (class, hash bucket) counts, refined
until a bucket is small, and a row_number runs only inside that one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.columns import strip, uniform_draw
from lodestar.sources.files import stored

# Buckets per level; draws are multiples of 1 / (2^31 - 1), so that three
# levels leave rows of equal draws alone.
N_BUCKETS = 2048
SPLIT_LEVELS = 2
DRAW_STEP = 2.0 ** -32
# Fixed hash salts: train/test split, nested tune split, sample.
SPLIT_SALT, TUNE_SALT, SAMPLE_SALT = 1, 2, 3


def trim_categoricals(df: DataFrame, categorical) -> DataFrame:
    """Trim every categorical column that is present, one projection."""
    exprs = {c: strip(F.col(c)) for c in categorical if c in df.columns}
    return df.withColumns(exprs) if exprs else df


def _drop_first(c, s: str):
    """Remove the first occurrence of ``s`` (a literal), if any."""
    pos = F.instr(c, s)
    head = c.substr(F.lit(1), pos - F.lit(1))
    tail = c.substr(pos + F.lit(len(s)), F.length(c) + F.lit(1))
    return F.when(pos > 0, F.concat(head, tail)).otherwise(c)


def normalise_label(c):
    """Trim, then remove the first ',' and the first ' ' (not all)."""
    t = strip(c)
    t = _drop_first(t, ",")
    return _drop_first(t, " ")


def valid_labels(df: DataFrame, label: str, valid) -> DataFrame:
    """Keep rows whose normalised label is in the valid set."""
    return df.filter(F.col(label).isin(list(valid)))


def binary_target(df: DataFrame, label: str, positive: str, target: str = "target") -> DataFrame:
    """target = (label == positive) as int; label dropped; null target dropped."""
    return (df.withColumn(target, (F.col(label) == F.lit(positive)).cast("int")).drop(label)
            .dropna(subset=[target]))


def features_target(df: DataFrame, target: str = "target"):
    """P5: (features, target) projections of one table."""
    return df.drop(target), df.select(target)


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42,
                     salt: int = 1, buckets: int = N_BUCKETS) -> DataFrame:
    """Adds ``is_test``. Test count = ceil(n * test_size) split
    over classes by largest remainder; inside a class the rows with the
    smallest (hash draw, key) go to test.

    The last such row of each class is found from counts of draws by
    bucket, the boundary bucket split again until it is small; the flag is
    then a comparison with it. Only (key, label, draw) is read for that,
    from a stored copy, and only one row per class is joined to the rows."""
    u = uniform_draw([key, seed, salt])
    thin = stored(df.select(F.col(key).alias("k"), F.col(label).alias("c"), u.alias("u")), "split")
    per = thin.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    share = F.col("n") * F.lit(test_size)
    # one row per class: largest remainders take what the floors leave over
    order = F.row_number().over(Window.orderBy((share - F.floor(share)).desc(), F.col("c").cast("string")))
    extra = F.ceil(F.sum("n").over(everything) * F.lit(test_size)) - F.sum(F.floor(share)).over(everything)
    state = per.select(F.col("c").alias("cls"), (F.floor(share) + (order <= extra).cast("int")).cast("bigint").alias("need"),
                       F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    for _ in range(SPLIT_LEVELS):
        inside = thin.join(state, F.col("c").eqNullSafe(F.col("cls"))).where("u >= lo AND u < hi AND need > 0")
        step = (F.col("hi") - F.col("lo")) / buckets
        sums = inside.groupBy("cls", "need", "lo", "hi", F.least(F.floor((F.col("u") - F.col("lo")) / step),
                              F.lit(buckets - 1)).cast("int").alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("u").alias("first"), F.max("u").alias("last"))
        upto = F.sum("n").over(Window.partitionBy("cls").orderBy("b"))
        edge = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("need")).groupBy(F.col("cls").alias("edge_cls")).agg(
            F.min(F.struct("b", "n", "upto", "first", "last")).alias("e"))
        state = state.join(edge, F.col("cls").eqNullSafe(F.col("edge_cls")), "left").select(
            "cls", (F.col("need") - F.coalesce(F.col("e.upto") - F.col("e.n"), F.lit(0))).alias("need"),
            # the bucket's own smallest and largest draw bound it without rounding
            F.coalesce("e.first", "lo").alias("lo"),
            F.when(F.col("e").isNull(), F.col("hi")).otherwise(F.col("e.last") + F.lit(DRAW_STEP)).alias("hi"))
    rest = thin.join(state, F.col("c").eqNullSafe(F.col("cls"))).where("u >= lo AND u < hi AND need > 0")
    nth = F.row_number().over(Window.partitionBy("cls").orderBy("u", "k"))
    last = rest.withColumn("__n", nth).where(F.col("__n") == F.col("need")).select(
        F.col("cls").alias("__c"), F.col("u").alias("__u"), F.col("k").alias("__k"))
    bounds = stored(last, "split-last")
    joined = df.join(bounds, F.col(label).eqNullSafe(F.col("__c")), "left")
    below = (u < F.col("__u")) | ((u == F.col("__u")) & (F.col(key) <= F.col("__k")))
    return joined.withColumn("is_test", F.coalesce(below, F.lit(False))).drop("__c", "__u", "__k")


def sample_cases(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Seeded sample of n rows without replacement, sorted by key;
    all rows when n >= height (a distributed top-n by hash)."""
    u = uniform_draw([key, seed, SAMPLE_SALT])
    return df.withColumn("__u", u).orderBy("__u", key).limit(n).drop("__u").orderBy(key)


def select_instances(df: DataFrame, key: str, ids: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Explicit selection by key (left semi) plus the ids that do not
    exist (left anti); ``strict`` makes such ids an error."""
    ids = ids.select(F.col(ids.columns[0]).alias(key))
    unknown = ids.join(df.select(key), key, "left_anti")
    if strict and (first := unknown.first()) is not None:
        raise ValueError(f"{key} {first[0]!r} is not in the table")
    return df.join(ids, key, "left_semi"), unknown
