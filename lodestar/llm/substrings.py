"""Substring dedup by level-wise doubling of repeated windows.

Windows of words are hashed by doubling: the hash of a window comes from
the hashes of its two halves. Only windows that repeat at one length are
extended to (about) twice that length, and only the survivors of the last
length decide, so the long windows of unrepeated text are never shuffled:

1. short windows (5 words for 13). Of these a document files only its
   anchors, in each full window the short one with the smallest hash. Two
   equal full windows have equal anchors, so none is missed, and a
   document files a fifth of its positions. One aggregation finds the
   anchors that start in more than one document.
2. full windows around surviving anchors. They are compared under their
   anchor; a full window is removed if the same words start in a document
   with a smaller id.

A level without survivors ends the work: the later joins are empty.

Skew: level 1 is a partial aggregation and an inner join, which AQE can
split. On level 2 anchors of at most ``group_limit`` documents are
compared within one task each; more frequent ones are aggregated by
(anchor, window) instead and joined back, so no group is held in memory.

Hashes: anchors 64 bit, full windows 64 bit more under the same anchor.

Defined cases: null and empty texts keep nothing and lose nothing;
windows of one document alone are not repeats; documents without an id
neither lose words nor make others lose them; rows that share an id count
as one document but each keeps its own words; extra columns are kept; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, IntegerType, LongType, StringType, StructField, StructType)

from lodestar.llm.common import SLICE_ROWS, arrow_map, emit_rows, materialise, without

GROUP_LIMIT = 4096
GROUP_ROWS = 65536
_U = np.uint64


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring stretches from their hashes."""
    with np.errstate(over="ignore"):
        z = x * _U(0x9E3779B97F4A7C15) + y
        z ^= z >> _U(30)
        z *= _U(0xBF58476D1CE4E5B9)
        z ^= z >> _U(27)
        z *= _U(0x94D049BB133111EB)
        z ^= z >> _U(31)
    return z


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), dtype=">u8").astype(_U)


def _longer(h: np.ndarray, short: int, window: int) -> np.ndarray:
    """Hashes of all stretches of ``window`` words from those of
    ``short`` words, doubling the length and at last overlapping."""
    while short < window:
        longer = min(2 * short, window)
        n = len(h) - (longer - short)
        h = _join(h[:n], h[longer - short:])
        short = longer
    return h


def _anchors(short_hashes: np.ndarray, n: int, reach: int) -> np.ndarray:
    """For each of the n full windows the place of its leftmost smallest
    short window."""
    best = short_hashes[:n].copy()
    at = np.zeros(n, dtype=np.int64)
    for k in range(1, reach):
        other = short_hashes[k:k + n]
        less = other < best
        best = np.where(less, other, best)
        at[less] = k
    return at + np.arange(n)


def _words(text) -> list[bytes]:
    return text.encode("utf-8").split() if text else []


def _text_hash(text) -> int:
    import xxhash
    return xxhash.xxh32_intdigest((text or "").encode("utf-8")) - (1 << 31)


def anchors(docs: DataFrame, window: int, short: int) -> DataFrame:
    """(h, id): the distinct anchors of each document."""
    schema = StructType([StructField("h", LongType()), StructField("id", LongType())])
    reach = window - short + 1

    def start():
        def step(ids, texts):
            hs, ds = [], []
            for i, t in zip(ids, texts):
                words = _words(t)
                n = len(words) - window + 1
                if n > 0:
                    low = _longer(_word_hashes(words), 1, short)
                    at = _anchors(low, n, reach)
                    # places never fall, so equal ones are neighbours
                    h = np.unique(low[at[np.r_[True, at[1:] != at[:-1]]]])
                    hs.append(h.view(np.int64))
                    ds.append(np.full(len(h), i, dtype=np.int64))
            return [np.concatenate(hs), np.concatenate(ds)] if hs else None
        return step, lambda: None

    return emit_rows(docs.select("id", "text"), schema, start)


def full_windows(marked: DataFrame, window: int, short: int) -> DataFrame:
    """One row per marked anchor and surroundings of a document: h, id, th
    (hash of the row's text), first (offset of the anchor in the first
    full window whose anchor it is), sigs, the hashes of these windows,
    the offset falling by one each, and places, where the anchor stands
    so (a text that repeats itself gives one row, not one per place)."""
    schema = StructType([StructField("h", LongType()), StructField("id", LongType()),
                         StructField("th", IntegerType()), StructField("first", IntegerType()),
                         StructField("sigs", ArrayType(LongType())), StructField("places", ArrayType(IntegerType()))])
    reach = window - short + 1

    def start():
        def step(ids, texts, marks):
            out: list[list] = [[] for _ in schema.names]
            for i, t, m in zip(ids, texts, marks):
                words = _words(t)
                n = len(words) - window + 1
                if n <= 0:
                    continue
                low = _longer(_word_hashes(words), 1, short)
                high = _longer(low, short, window)
                at = _anchors(low, n, reach)
                head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                size = np.diff(np.r_[head, n])
                place = at[head]
                h = low[place].view(np.int64)
                use = np.flatnonzero(np.isin(h, np.array(m, dtype=np.int64)))
                sig = high.view(np.int64)
                th = _text_hash(t)
                seen: dict = {}
                for u in use.tolist():
                    a, s = int(head[u]), int(size[u])
                    key = (int(h[u]), int(place[u]) - a, sig[a:a + s].tobytes())
                    if key in seen:
                        seen[key].append(int(place[u]))
                        continue
                    seen[key] = [int(place[u])]
                    for column, value in zip(out, (key[0], i, th, key[1], sig[a:a + s], seen[key])):
                        column.append(value)
            return out if out[0] else None
        return step, lambda: None

    return emit_rows(marked.select("id", "text", "marks"), schema, start)


def _compare(rows: DataFrame) -> DataFrame:
    """(id, th, places, mask) of the windows whose words start in a smaller
    document, among rows whose anchors are all below the group limit. Bit
    o of mask: the windows that begin o words before the places."""
    schema = StructType([StructField("id", LongType()), StructField("th", IntegerType()),
                         StructField("places", ArrayType(IntegerType())), StructField("mask", LongType())])
    names = schema.names
    dealt = rows.select("h", "id", "th", "first", "sigs", "places").repartition("h").sortWithinPartitions("h")

    def judge(h, ids, th, first, sigs, places):
        size = np.array([len(s) for s in sigs])
        row = np.repeat(np.arange(len(h)), size)
        sig = np.concatenate(sigs)
        offset = first[row] - (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size))
        doc = ids[row]
        order = np.lexsort((doc, sig, offset, h[row]))
        r, s, o, d = row[order], sig[order], offset[order], doc[order]
        new = np.r_[True, (h[r][1:] != h[r][:-1]) | (s[1:] != s[:-1]) | (o[1:] != o[:-1])]
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = d > least
        mask = np.zeros(len(h), dtype=np.int64)
        np.bitwise_or.at(mask, r[gone], np.int64(1) << o[gone])
        hit = mask != 0
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(th[hit]), pa.array(
            places[hit].tolist(), pa.list_(pa.int32())), pa.array(mask[hit])], names=names)

    def arrays(column):
        """The rows of a list column as an object array of arrays."""
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        ends = ends - ends[0]
        out = np.empty(len(column), dtype=object)
        for k in range(len(column)):
            out[k] = flat[ends[k]:ends[k + 1]]
        return out

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held.append((*cols, arrays(batch.column(4)), arrays(batch.column(5))))
            if sum(len(c[0]) for c in held) >= GROUP_ROWS:
                whole = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on
                if cut:
                    yield judge(*[c[:cut] for c in whole])
                held = [tuple(c[cut:] for c in whole)]
        if held and len(held[0][0]):
            yield judge(*[np.concatenate(c) for c in zip(*held)])

    return arrow_map(dealt, run, schema)


def _aggregate(rows: DataFrame) -> DataFrame:
    """The same for frequent anchors. Copies and passages give few
    different surroundings (first, sigs) of an anchor: rows are aggregated
    by surroundings before these are split into windows, the smallest
    document of each window goes back to its surroundings (at most one
    entry per offset), and a row compares its own id with them."""
    around = ["h", "first", "sigs"]
    kinds = rows.groupBy(*around).agg(F.min("id").alias("least"), F.max("id").alias("most"))
    each = kinds.select(*around, "least", "most", F.posexplode("sigs").alias("k", "sig")) \
        .withColumn("o", F.col("first") - F.col("k"))
    window = ["h", "o", "sig"]
    least = each.groupBy(*window).agg(F.min("least").alias("low"), F.max("most").alias("high")) \
        .where("low < high").select(*window, "low")
    known = each.select(*around, "o", "sig").join(least, window).groupBy(*around).agg(
        F.collect_list(F.struct("o", "low")).alias("lows"))
    mask = F.expr("aggregate(lows, 0L, (m, x) -> m | if(id > x.low, shiftleft(1L, x.o), 0L))")
    return rows.join(known, around).select("id", "th", "places", mask.alias("mask")).where("mask <> 0")


def _apply(df: DataFrame, window: int) -> DataFrame:
    """n_words, n_removed and kept from text and the removed windows."""
    fields = [StructField("n_words", LongType()), StructField("n_removed", LongType()),
              StructField("kept", StringType())]
    base = without(df, "th", "places", "mask")
    schema = StructType([*base.schema.fields, *fields])
    at = [df.columns.index(c) for c in ("text", "th", "places", "mask")]
    keep = [df.columns.index(c) for c in base.columns]

    def one(text, th, places, mask):
        words = _words(text)
        if not th:
            return len(words), 0, b" ".join(words).decode("utf-8")
        own = _text_hash(text)
        edge = [0] * (len(words) + window + 1)
        for t, where, m in zip(th, places, mask):
            while t == own and m:
                o = (m & -m).bit_length() - 1
                for p in where:
                    edge[p - o] += 1
                    edge[p - o + window] -= 1
                m &= m - 1
        cover = np.cumsum(edge)[:len(words)] > 0
        return len(words), int(cover.sum()), b" ".join([w for w, c in zip(words, cover.tolist()) if not c]).decode("utf-8")

    def run(batches):
        for batch in batches:
            for offset in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(offset, SLICE_ROWS)
                done = [one(*r) for r in zip(*[part.column(i).to_pylist() for i in at])]
                new = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                       pa.array([d[2] for d in done], pa.string())]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], *new], names=schema.names)

    return arrow_map(df, run, schema)


def dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 13,
          short: int = 5, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``id_col``, n_words, n_removed and kept (the words left, joined by
    one space) per row. Each word under a window of ``window`` words that
    also starts in a document with a smaller id is removed. ``short`` is
    at most half the window, at least a bit mask of 63 offsets away."""
    if not 1 <= short <= window or window - short > 62:
        raise ValueError("short must be at most the window and at least window - 62")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    known = docs.where("id IS NOT NULL")
    filed = anchors(known, window, short)
    repeated = filed.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most"),
                                      F.count("*").alias("n")).where("least < most").select("h", "n")
    few = F.col("n") <= group_limit
    marks = materialise(filed.join(repeated, "h").groupBy("id").agg(
        F.collect_list(F.when(few, F.col("h"))).alias("few"), F.collect_list(F.when(~few, F.col("h"))).alias("many")),
        "anchors")
    gone = _compare(full_windows(known.join(marks.select("id", F.col("few").alias("marks")), "id"), window, short))
    frequent = marks.where(F.size("many") > 0).select("id", F.col("many").alias("marks"))
    if not frequent.isEmpty():
        rows = materialise(full_windows(known.join(frequent, "id"), window, short), "frequent")
        gone = gone.unionByName(_aggregate(rows))
    removed = gone.groupBy("id").agg(F.collect_list(F.struct("th", "places", "mask")).alias("g")).select(
        "id", F.col("g.th").alias("th"), F.col("g.places").alias("places"), F.col("g.mask").alias("mask"))
    loses = known.join(removed, "id", "left")
    nothing = [F.lit(None).cast(removed.schema[c].dataType).alias(c) for c in ("th", "places", "mask")]
    whole = docs.where("id IS NULL").select("id", "text", *nothing)
    return _apply(loses.select("id", "text", "th", "places", "mask").unionByName(whole), window).select(
        F.col("id").alias(id_col), "n_words", "n_removed", "kept")
