"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed: its blob is the SHA-256
of its text. The ledger is a Parquet table of findings by (blob, rule
version). A scan reads the texts only of blobs that the ledger lacks under
the current rule version, each once, appends their findings, and joins
all findings of the wanted blobs back to every path and version.

Positions come from the regular expression engine alone: the text split
at the matches of a rule gives the stretches between them, so running
lengths give code points. A cheap search first leaves out texts without
any match.

Defined cases: a null text is empty; empty texts and texts without a
match are in the ledger with no finding; repeated rows get the same
findings; extra columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lodestar.llm.common import let, without
from lodestar.sources.files import scratch_path


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` is
    at least ``least`` characters long; failing ones are dropped."""
    kind: str
    pattern: str
    group: int
    least: int


# The rules, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
RULE_VERSION = "1"

SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()),
                              StructField("end", LongType())]))
LEDGER = StructType([StructField("blob", StringType()), StructField("rule_version", StringType()),
                     StructField("spans", SPANS)])


def _found(text: Column, rule: Rule) -> Column:
    """Spans of one rule in one text, by start."""
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    whole = group if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.struct(F.split(text, rule.pattern, -1).alias("between"), whole.alias("m"), group.alias("g"))

    def walk(p):
        steps = F.arrays_zip(F.slice(p["between"], F.lit(1), F.size(p["m"])).alias("b"), p["m"].alias("m"),
                             p["g"].alias("g"))
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))

        def step(acc, s):
            start = acc["at"] + F.length(s["b"])
            end = start + F.length(s["m"])
            span = F.struct(F.lit(rule.kind).alias("kind"), start.cast("long").alias("start"),
                            end.cast("long").alias("end"))
            return F.struct(end.cast("long").alias("at"), F.when(F.length(s["g"]) >= rule.least, F.concat(
                acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(steps, first, step, lambda acc: acc["out"])

    # a match that holds needs a run of this length: most texts have none
    likely = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}"}.get(rule.kind, rule.pattern)
    return F.when(text.rlike(likely), let(parts, walk)).otherwise(F.array().cast(SPANS))


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then kind as listed."""
    order = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.concat(*[_found(text, r) for r in rules])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"])
                                                  .alias("at"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger, empty where the table is not there yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan(df: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text: str = "text",
         rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """``df`` less its text with blob and spans. ``ledger``: folder of the
    ledger table; a fresh one under the shared folder if not given.

    One row stands for a blob: the texts of those rows alone are read
    again and scanned. They are found by (blob, id), so that a text which
    a third of the rows share is no hot key."""
    spark = df.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    blob = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    paths = without(df, "blob", "spans").withColumn("blob", blob)
    known = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version)
    holders = paths.groupBy("blob").agg(F.min(id_col).alias("holder")).join(
        known.select("blob"), "blob", "left_anti").select(F.col("blob").alias("fresh"), "holder")
    fresh = paths.select("blob", F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(
        holders, (F.col("blob") == F.col("fresh")) & F.col("id").eqNullSafe(F.col("holder")), "left_semi")
    scanned = fresh.select("blob", F.lit(rule_version).alias("rule_version"), findings(F.col("t"), rules).alias("spans"))
    scanned.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    held = read_ledger(spark, ledger).where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)) \
        .select("blob", "spans")
    return paths.drop(text).join(held, "blob", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(SPANS)))


def listed(spans: str = "spans") -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str, spans: str = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
