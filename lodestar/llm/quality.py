"""Quality rules: word statistics and a learned decision list.

Sequential covering over labelled statistics. A rule is a conjunction of
threshold conditions on document statistics. It is grown on two thirds of
the labelled rows by the condition of highest FOIL gain until it covers
no good document, pruned on the other third by dropping its last
conditions while its precision there does not fall, and kept if that
precision is high enough; then the rows it covers are taken out and the
next rule is grown. The ordered rules become one conditional expression
of Spark columns, so documents are judged in the job that counts their
words.

Each step is one aggregation of (statistic, threshold bin) counts over
the labelled rows; only those counts, at most ``bins`` for each
statistic, reach the driver.

Defined cases: a null text has no words; documents without words fail the
base rule; null labels are ignored and of several labels of one document
the lowest counts; without labelled rows of both kinds the list is empty
and the base rule alone decides; repeated rows are judged alike; extra
columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, let, materialise, without

# The symbols, the window of the repeat count, the base rule.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def _repeat_words(words: Column, window: int) -> Column:
    """Words under windows that occur twice or more in the document.

    Window hashes are compared within the document; where all differ the
    places are not needed, else hashes are sorted with their places and
    runs of equal ones counted."""
    def hashed(w):
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    def covered(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s):
            def same(x, j):
                return F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
                    F.get(s, j - 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(let(placed, repeated), start, lambda acc, i: F.struct(
            i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n")), lambda acc: acc["n"])

    counted = let(hashed(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
                  .otherwise(covered(h)))
    return F.when(F.size(words) > window, counted).otherwise(0)


def _removed(text: Column, pattern: str) -> Column:
    """Characters that match a one-character pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, F.lit(pattern), F.lit("")))


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` less its text with the columns COUNTS (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    by_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("word_chars"),
        _repeat_words(w, WINDOW).cast("long").alias("n_repeat_words")))
    made = without(df, *COUNTS).withColumns({
        "__words": by_words,
        "n_symbols": _removed(t, SYMBOLS).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_upper": _removed(t, "[A-Z]").cast("long"),
        "n_marks": _removed(t, "[!?]").cast("long")})
    rest = [F.col(f"`{c}`") for c in without(df, text, *COUNTS).columns]
    return made.select(*rest, *[(F.col(f"__words.{c}") if c in ("n_words", "word_chars", "n_repeat_words")
                                 else F.col(c)).alias(c) for c in COUNTS])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """The statistics that conditions test, by name."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "marks_per_word": F.col("n_marks") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, columns: dict[str, Column]) -> Column:
        c = columns[self.feature]
        return c >= self.value if self.at_least else c < self.value

    def __str__(self):
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.value:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule, columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.holds(columns)
    return out


def verdict(rules: list[Rule], columns: dict[str, Column], rejected, otherwise) -> Column:
    """The ordered list as one conditional expression."""
    out = F.lit(otherwise)
    for rule in reversed(rules):
        out = F.when(holds(rule, columns), rejected).otherwise(out)
    return out


def _gain(p0, n0, p1, n1) -> float:
    from math import log2
    return p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0))) if p1 else 0.0


def learn(labelled: DataFrame, max_conditions: int = 4, bins: int = 32, precision: float = 0.9,
          least_cover: int = 5) -> list[Rule]:
    """Rules that reject. ``labelled``: COUNTS, good (0 or 1) and part
    (0, 1: grow; 2: prune). Covering ends where no grown rule reaches the
    precision; each rule takes rows of the pruning part out, so it does."""
    names = list(features())
    rows = materialise(labelled.select("good", "part", *[c.alias(k) for k, c in features().items()]), "labelled")
    cols = {k: F.col(k) for k in names}
    shares = [i / bins for i in range(1, bins)]
    bad_only = {k: F.when(F.col("good") == 0, F.col(k)) for k in names}
    cuts = rows.agg(*[F.percentile_approx(k, shares, 10_000).alias(k) for k in names],
                    *[F.percentile_approx(c, shares, 10_000).alias(f"bad_{k}") for k, c in bad_only.items()]).first()
    if cuts[names[0]] is None or cuts[f"bad_{names[0]}"] is None:
        return []
    edges = {k: sorted(set(cuts[k]) | set(cuts[f"bad_{k}"])) for k in names}

    def counts(where: Column) -> dict:
        """(feature, edges at or below the value) -> [bad, good]."""
        def bin_of(k):
            steps = F.array(*[F.lit(float(e)) for e in edges[k]])
            return F.size(F.filter(steps, lambda e: e <= cols[k]))

        each = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), bin_of(k).alias("bin")) for k in names]))
        got = rows.where(where).select("good", each.alias("x")).groupBy("x.f", "x.bin").agg(
            F.sum(1 - F.col("good")).alias("bad"), F.sum("good").alias("good")).collect()
        return {(r.f, r.bin): (r.bad, r.good) for r in got}

    def covered(rule: Rule, where: Column) -> tuple[int, int]:
        r = rows.where(where & holds(rule, cols)).agg(
            F.coalesce(F.sum(1 - F.col("good")), F.lit(0)).alias("bad"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
        return r.bad, r.good

    def best(found: dict, p0: int, n0: int):
        top = (0.0, None, 0, 0)
        for k in names:
            under = [0, 0]
            for b in range(len(edges[k]) + 1):
                if b:
                    for at_least in (True, False):
                        p, n = (p0 - under[0], n0 - under[1]) if at_least else under
                        if p >= least_cover and (g := _gain(p0, n0, p, n)) > top[0] + 1e-9:
                            top = (g, Condition(k, at_least, edges[k][b - 1]), p, n)
                bad, good = found.get((k, b), (0, 0))
                under = [under[0] + bad, under[1] + good]
        return top

    rules: list[Rule] = []
    open_ = F.lit(True)
    while True:
        rule: Rule = ()
        grow = open_ & (F.col("part") < 2)
        while len(rule) < max_conditions:
            found = counts(grow & holds(rule, cols))
            p0 = sum(v[0] for (k, _), v in found.items() if k == names[0])
            n0 = sum(v[1] for (k, _), v in found.items() if k == names[0])
            if not p0 or not n0:
                break
            gain, condition, p, n = best(found, p0, n0)
            if condition is None:
                break
            rule = (*rule, condition)
            if not n:
                break
        if not rule:
            break
        # pruned: the shortest prefix whose precision on the pruning part is not beaten
        scored = []
        for size in range(1, len(rule) + 1):
            bad, good = covered(rule[:size], open_ & (F.col("part") == 2))
            scored.append(((bad + 1) / (bad + good + 2), -size, bad))
        top = max(scored)
        rule = rule[:-top[1]]
        if top[0] < precision:
            break
        rules.append(rule)
        open_ = open_ & ~holds(rule, cols)
    return rules


def labelled_counts(stats: DataFrame, marks: DataFrame, label: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """Counts of the labelled documents with good and part."""
    good = marks.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min(F.col(label).cast("int")).alias("good"))
    return stats.select(id_col, *COUNTS).join(good, id_col).withColumn(
        "part", F.pmod(F.xxhash64(id_col, F.lit("part")), F.lit(3)))


def judge(df: DataFrame, marks: DataFrame, label: str = "quality", id_col: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``df`` less its text with COUNTS, base_failed, kept and rule (the
    number of the rule that rejects, 0 for the base rule, else null)."""
    stats = materialise(statistics(without(df, "base_failed", "kept", "rule"), text), "statistics")
    rules = learn(labelled_counts(stats.where(~base_failed()), marks, label, id_col))
    cols = features()
    number = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        number = F.when(holds(rule, cols), F.lit(i)).otherwise(number)
    return stats.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules, cols, False, True)).withColumn(
        "rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(number))
