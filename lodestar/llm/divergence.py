"""Source divergence audit on run-length columns.

Terms are counted per (lang, source) group; a lang keeps the terms in
enough of its documents. Each kept term has a share p of its group's
occurrences, smoothed and in whole billionths. Two parts: how far two
sources of a lang differ, summed over all kept terms, and the terms that
mark a source against its lang.

The vocabulary of a lang is reordered so that terms of equal counts stand
together: by the counts in its largest sources, then by the total and a
hash of all counts. A group's column of counts is then a few runs. It is
cut into chunks of a bounded number of terms, since the sum over terms is
a sum over chunks; a task holds the runs of two blocks of sources in one
chunk, intersects the run boundaries of each pair and multiplies
f = |p - q| by the length of each common run. Nothing holds a whole
column or vocabulary.

Counting happens in the task that reads the text, so what is shuffled are
distinct (group, term) rows of a task; a term of every document, or a
source of a third of all rows, is one row a task.

Defined cases: null text, lang and source are empty strings; a group
without terms is a group; a lang that keeps no term has pair values of 0
and no term rows; a lang with one source has no pair rows; repeated rows
are documents of their own; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestar.llm.common import arrow_map, emit_rows, materialise

# Smoothing and scale of a share.
PRIOR, SCALE_STEPS, STEP = 5, 3, 1000

# Distinct terms a task holds before it hands them on; bytes of a text
# that are split at once.
HELD_TERMS, PIECE = 200_000, 1 << 20
# Largest sources whose counts order the vocabulary.
LEADERS = 4
# Terms of a chunk, sources of a block.
CHUNK, BLOCK = 16_384, 64

# Bytes to their form in a term: letters in lower case, bytes of
# characters beyond ASCII as they are, all others a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(data: bytes):
    """Folded text in pieces that end between terms."""
    text = data.translate(_FOLD)
    start = 0
    while len(text) - start > PIECE:
        end = text.find(b" ", start + PIECE)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each
    term in each group, and a row with the empty term for each group."""
    schema = StructType([StructField("lang", StringType()), StructField("source", StringType()),
                         StructField("term", StringType()), StructField("n", LongType()),
                         StructField("docs", LongType())])

    def start():
        groups: dict = {}
        held = 0

        def flush():
            nonlocal held
            out = ([], [], [], [], [])
            for (lang, source), (n, docs_with) in groups.items():
                out[0].extend([lang] * (len(n) + 1))
                out[1].extend([source] * (len(n) + 1))
                out[2].extend(["", *(t.decode() for t in n)])
                out[3].extend([0, *n.values()])
                out[4].extend([0, *(docs_with[t] for t in n)])
            groups.clear()
            held = 0
            return out

        def step(langs, sources, texts):
            nonlocal held
            for lang, source, data in zip(langs, sources, texts):
                n, docs_with = groups.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for piece in _pieces(data):
                    terms = piece.split()
                    n.update(terms)
                    seen.update(terms)
                docs_with.update(seen)
                held += len(n) - before + 1
            return flush() if held >= HELD_TERMS else None

        return step, flush

    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")],
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return emit_rows(rows, schema, start).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (count + PRIOR) / whole), in whole numbers (a long
    division by three digits at a time, so that nothing overflows)."""
    rest, out = count + PRIOR, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        out, rest = out * STEP + F.call_function("div", rest, whole), rest % whole
    return out + 1


def _shares(counts: np.ndarray, whole: int) -> np.ndarray:
    rest, out = counts.astype(np.int64) + PRIOR, np.zeros(len(counts), dtype=np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        out, rest = out * STEP + rest // whole, rest % whole
    return out + 1


@dataclass
class Audit:
    """Stored state of an audit: ``groups`` (lang, source, whole, n_terms),
    ``entries`` (lang, source, term, n, total, chunk, pos) of kept terms,
    ``langs`` (lang, whole, n_terms, n_sources) and ``chunks`` (lang,
    chunk, lo, hi)."""
    groups: DataFrame
    entries: DataFrame
    langs: DataFrame
    chunks: DataFrame


def ordered_vocabulary(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, total, chunk, pos): kept terms in the order that puts
    equal counts together; positions run on within a lang and chunk."""
    largest = Window.partitionBy("lang").orderBy(F.desc("size"), "source")
    leaders = counts.groupBy("lang", "source").agg(F.sum("n").alias("size")).withColumn(
        "place", F.row_number().over(largest)).where(F.col("place") <= LEADERS).drop("size")
    by_term = counts.where("term <> ''").join(leaders, ["lang", "source"], "left").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"),
        F.sum(F.xxhash64("source", "n") % (1 << 40)).alias("alike"),
        *[F.coalesce(F.sum(F.when(F.col("place") == i + 1, F.col("n"))), F.lit(0)).alias(f"lead{i}")
          for i in range(LEADERS)]).where(F.col("docs") >= min_docs)
    order = ["lang", *[f"lead{i}" for i in range(LEADERS)], "total", "alike", "term"]
    number = F.monotonically_increasing_id()
    # the number is the partition's (high bits) and the place in it
    return by_term.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "lang", "term", "total", number.alias("number")).select(
        "lang", "term", "total", F.call_function("div", F.col("number"), F.lit(CHUNK).cast("long")).alias("chunk"),
        (F.col("number") % CHUNK).cast("int").alias("pos"))


def prepare(docs: DataFrame, min_docs: int = 30) -> Audit:
    """Count, choose the kept terms and order them."""
    counts = materialise(term_counts(docs), "counts")
    kept = materialise(ordered_vocabulary(counts, min_docs), "vocabulary")
    entries = materialise(counts.where("term <> ''").drop("docs").join(kept, ["lang", "term"]), "entries")
    held = counts.select("lang", "source").distinct()
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("n_terms"))
    langs = held.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(vocabulary, "lang", "left").select(
        "lang", (F.coalesce("n", F.lit(0)) + PRIOR * F.coalesce("n_terms", F.lit(0))).alias("whole"),
        F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "n_sources")
    langs = materialise(langs, "langs")
    groups = held.join(sums, ["lang", "source"], "left").join(langs.drop("whole"), "lang").select(
        "lang", "source", (F.coalesce("n", F.lit(0)) + PRIOR * F.col("n_terms")).alias("whole"), "n_terms",
        F.pmod(F.xxhash64("source"), F.ceil(F.col("n_sources") / BLOCK)).cast("int").alias("block"),
        F.ceil(F.col("n_sources") / BLOCK).cast("int").alias("n_blocks"))
    chunks = kept.groupBy("lang", "chunk").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    # a lang without kept terms has one chunk without positions
    none = langs.where("n_terms = 0").select("lang", F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("lo"),
                                             F.lit(-1).alias("hi"))
    return Audit(materialise(groups, "groups"), entries, langs, materialise(chunks.unionByName(none), "chunks"))


def run_lengths(audit: Audit) -> DataFrame:
    """(lang, chunk, source, runs): each group's counts in a chunk as runs
    (first position, length, count) of counts above 0, in order."""
    alike = Window.partitionBy("lang", "chunk", "source", "n").orderBy("pos")
    islands = audit.entries.withColumn("island", F.col("pos") - F.row_number().over(alike))
    runs = islands.groupBy("lang", "chunk", "source", "n", "island").agg(
        F.min("pos").alias("first"), F.count(F.lit(1)).cast("int").alias("length"))
    return runs.groupBy("lang", "chunk", "source").agg(F.array_sort(F.collect_list(F.struct(
        "first", "length", "n"))).alias("runs"))


def _column(runs: pa.StructArray, whole: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(first positions, shares) of the runs that cover [lo, hi]: the given
    ones and, between them, those of a count of 0."""
    first, length, n = (runs.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
    after = first + length
    starts = np.concatenate([[lo], after])
    ends = np.concatenate([first, [hi + 1]])
    gap = starts < ends
    at = np.concatenate([first, starts[gap]])
    counts = np.concatenate([n, np.zeros(int(gap.sum()), dtype=np.int64)])
    order = np.argsort(at, kind="stable")
    return at[order], _shares(counts[order], whole)


def _difference(a, b, hi: int) -> int:
    """Sum of f over the positions: the boundaries of both columns cut the
    chunk into common runs."""
    bounds = np.union1d(a[0], b[0])
    length = np.diff(bounds, append=hi + 1)
    p = a[1][np.searchsorted(a[0], bounds, "right") - 1]
    q = b[1][np.searchsorted(b[0], bounds, "right") - 1]
    return int((np.abs(p - q) * length).sum())


def pair_values(audit: Audit) -> DataFrame:
    """(lang, source, item, value): f summed over the kept terms, for each
    ordered pair of sources of a lang."""
    members = audit.groups.join(audit.chunks, "lang").join(run_lengths(audit), ["lang", "chunk", "source"], "left")
    none = F.array().cast("array<struct<first:int,length:int,n:bigint>>")
    side = materialise(members.groupBy("lang", "chunk", "lo", "hi", "block", "n_blocks").agg(F.collect_list(F.struct(
        "source", "whole", F.coalesce("runs", none).alias("runs"))).alias("columns")), "columns")
    # a block meets itself and those after it; copies are keyed by the block they meet
    left = side.withColumn("other", F.explode(F.sequence("block", F.col("n_blocks") - 1)))
    right = side.select("lang", "chunk", F.col("block").alias("other"), F.col("columns").alias("others"))
    met = left.join(right, ["lang", "chunk", "other"]).select("lang", "lo", "hi", F.col("block") == F.col("other"),
                                                              "columns", "others")
    schema = StructType([StructField("lang", StringType()), StructField("a", StringType()),
                         StructField("b", StringType()), StructField("value", LongType())])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                lang, lo, hi, same = (batch.column(i)[r].as_py() for i in range(4))
                sides = []
                for members in (batch.column(4)[r].values, batch.column(5)[r].values):
                    names, wholes, runs = members.field(0).to_pylist(), members.field(1).to_pylist(), members.field(2)
                    sides.append([(s, _column(runs[i].values, w, lo, hi) if hi >= lo else None)
                                  for i, (s, w) in enumerate(zip(names, wholes))])
                out = []
                for s, x in sides[0]:
                    for t, y in sides[1]:
                        if s < t or (s > t and not same):
                            out.append((s, t, _difference(x, y, hi) if x is not None else 0))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(out), pa.string()), pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())],
                    names=schema.names)

    sums = arrow_map(met, run, schema).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("s"), "value").select("lang", "s.source", "s.item", "value")


def term_values(audit: Audit) -> DataFrame:
    """(lang, source, item, value): kept terms of a group with a larger
    share there than in the lang, and by how much."""
    p = share(F.col("n"), F.col("group_whole"))
    q = share(F.col("total"), F.col("lang_whole"))
    groups = audit.groups.select("lang", "source", F.col("whole").alias("group_whole"))
    langs = audit.langs.select("lang", F.col("whole").alias("lang_whole"))
    found = audit.entries.join(groups, ["lang", "source"]).join(langs, "lang")
    return found.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): both parts, pairs in all
    ranks, terms up to rank ``top``."""
    state = prepare(docs, min_docs)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(best)
    pairs = pair_values(state).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    terms = term_values(state).withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias(
        "rank"))
