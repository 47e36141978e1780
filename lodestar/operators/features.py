"""Train-only feature state: clean -> bin -> ratio -> scale -> one-hot.

Fitting follows the MLlib estimator pattern: one distributed aggregate
pass learns small state (means, sample stds, category domains), which is
brought to the driver with a size check and frozen into Column
expressions. ``transform`` is then a pure projection that stays inside
whole-stage codegen and needs no join or shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lodestar.functions.columns import (clean_category, lenient_double, net_ratio,
                                        right_closed_bin)
from lodestar.sources.tables import level_map
from lodestar.spec import CaseSpec

# Fitted state larger than this is refused rather than collected.
MAX_DOMAIN_VALUES = 100_000


def collect_bounded(df: DataFrame, limit: int = MAX_DOMAIN_VALUES, what: str = "state"):
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} entries; refusing to collect it")
    return rows


def clean(df: DataFrame, spec: CaseSpec) -> DataFrame:
    """P10 + P11 (= P20): lenient numerics (null -> 0.0), trimmed
    categoricals (null -> 'Unknown'); only columns that are present."""
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = {}
    for c in spec.numeric:
        if c in types:
            exprs[c] = lenient_double(c, types[c])
    for c in spec.categorical:
        if c in types:
            exprs[c] = clean_category(c, types[c])
    return df.withColumns(exprs) if exprs else df


def add_bins(df: DataFrame, spec: CaseSpec) -> DataFrame:
    """Every declared right-closed bin, one projection."""
    exprs = {b.name: right_closed_bin(b.source, b.cuts, b.labels) for b in spec.bins if b.source in df.columns}
    return df.withColumns(exprs) if exprs else df


def add_ratios(df: DataFrame, spec: CaseSpec) -> DataFrame:
    """(plus - minus) / (base + 1) with NaN/null -> 0."""
    exprs = {r.name: net_ratio(r.plus, r.minus, r.base) for r in spec.ratios
             if {r.plus, r.minus, r.base} <= set(df.columns)}
    return df.withColumns(exprs) if exprs else df


def reconcile(df: DataFrame, spec: CaseSpec) -> DataFrame:
    """Dependent := lookup[source], keeping the old value when unmapped."""
    exprs = {}
    for dep, (src, mapping) in spec.dependent.items():
        if dep in df.columns and src in df.columns:
            exprs[dep] = F.coalesce(level_map(mapping)[F.col(src)], F.col(dep).cast("double"))
    return df.withColumns(exprs) if exprs else df


def derive(df: DataFrame, spec: CaseSpec) -> DataFrame:
    """Clean + bins + ratios (the part of preparation that needs no state)."""
    return add_ratios(add_bins(clean(df, spec), spec), spec)


@dataclass
class FeatureModel:
    """Frozen output schema of the encoder (P15) plus scaling stats."""

    spec: CaseSpec
    numeric: list[str]
    scale_stats: dict  # name -> (mean, std)
    domains: dict  # categorical -> sorted list of training values

    @property
    def names(self) -> list[str]:
        out = [f"{c}_scaled" if c in self.scale_stats else c for c in self.numeric]
        for c, values in self.domains.items():
            out += [f"{c}_{v}" for v in values]
        return out

    @property
    def width(self) -> int:
        return len(self.names)

    def schema_frame(self, spark: SparkSession) -> DataFrame:
        """feature_schema(ord, name): the learned, ordered output columns."""
        rows = [(i, n) for i, n in enumerate(self.names)]
        return spark.createDataFrame(rows, StructType([StructField("ord", LongType()),
                                                        StructField("name", StringType())]))

    def scaled(self, df: DataFrame, keep_raw: bool = False) -> DataFrame:
        """(x - mean) / std with NaN/null -> 0, renamed ``_scaled``, raw
        dropped (unless a later step still needs the raw columns)."""
        exprs = {}
        for c, (mean, std) in self.scale_stats.items():
            if c in df.columns:
                z = (F.col(c) - F.lit(mean)) / F.lit(std)
                exprs[f"{c}_scaled"] = F.coalesce(F.nanvl(z, F.lit(None).cast("double")), F.lit(0.0))
        gone = [] if keep_raw else [c for c in self.scale_stats if c in df.columns]
        return df.withColumns(exprs).drop(*gone) if exprs else df

    def numeric_columns(self) -> list:
        return [F.col(f"{c}_scaled") if c in self.scale_stats else F.col(c).cast("double") for c in self.numeric]

    def dummy_columns(self) -> list:
        """One 0/1 per training value; unseen values -> all zeros."""
        out = []
        for c, values in self.domains.items():
            out += [(F.col(c) == F.lit(v)).cast("double") for v in values]
        return out

    def transform(self, df: DataFrame, output: str = "features", keep: bool = True) -> DataFrame:
        """Prepared rows -> ``output`` array<double> aligned to the fitted schema."""
        prepared = self.scaled(derive(df, self.spec), keep_raw=True)
        vec = F.array(*(self.numeric_columns() + self.dummy_columns()))
        return prepared.withColumn(output, vec) if keep else prepared.select(self.spec.key, vec.alias(output))

    def wide(self, df: DataFrame) -> DataFrame:
        """The encoded table as named columns (for inspection and small outputs)."""
        prepared = self.scaled(derive(df, self.spec))
        cols = self.numeric_columns() + self.dummy_columns()
        return prepared.select(F.col(self.spec.key), *[c.alias(n) for c, n in zip(cols, self.names)])


def fit_features(train: DataFrame, spec: CaseSpec, scale: bool = False) -> FeatureModel:
    """P15 + P17 on training rows only."""
    prepared = derive(train, spec)
    numeric = [c for c in spec.encoded_numeric if c in prepared.columns]
    stats = {}
    if scale and numeric:
        row = prepared.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(numeric)],
                           *[F.stddev_samp(c).alias(f"s_{i}") for i, c in enumerate(numeric)]).first()
        for i, c in enumerate(numeric):
            mean, std = row[f"m_{i}"], row[f"s_{i}"]
            if mean is None or std is None or not std > 0:
                continue
            stats[c] = (float(mean), float(std))
    cats = [c for c in spec.encoded_categorical if c in prepared.columns]
    domains = {c: [] for c in cats}
    if cats:
        long = prepared.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))
                                                   for c in cats])).alias("kv")).select("kv.*").distinct()
        for r in sorted(collect_bounded(long, what="category domain"), key=lambda r: (r["feature"], r["value"])):
            domains[r["feature"]].append(r["value"])
    return FeatureModel(spec=spec, numeric=numeric, scale_stats=stats, domains=domains)


def numeric_stats(train: DataFrame, spec: CaseSpec, columns: list[str] | None = None) -> DataFrame:
    """P17 as a table: (name, mean, std) in one aggregate pass."""
    prepared = derive(train, spec)
    columns = columns or [c for c in spec.encoded_numeric if c in prepared.columns]
    row = F.array(*[F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
                    for c in columns])
    return prepared.agg(row.alias("s")).select(F.explode("s").alias("s")).select("s.*")


__all__ = ["clean", "add_bins", "add_ratios", "reconcile", "derive", "FeatureModel", "fit_features",
           "numeric_stats", "collect_bounded", "DoubleType"]
