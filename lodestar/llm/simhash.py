"""SimHash near-duplicates: fingerprints within a bit distance are linked
and components of links are classes.

Search by BK-trees (children keyed by integer Hamming distance to their
parent; a query follows only edges within the radius). Two fingerprints
at distance r or less agree on at least ``blocks - r`` of ``blocks`` bit
blocks, so every choice of that many blocks files each distinct
fingerprint under its bits there, and one tree is built per such key: no
tree spans the corpus, nothing is collected to the driver. The shard
trees are built in the tasks that query them instead of being broadcast,
since together they grow with the corpus. A key with more fingerprints
than ``tree_size`` is split into that many tree shards and query blocks,
each pair of which is its own group, so no task holds an unbounded group
and no link is lost.

Defined cases: a null or empty text has fingerprint zero and is linked
like any other; repeated rows share a fingerprint; a null doc_id never
names a component that holds a doc_id; extra columns are ignored by
``components`` and kept by ``fingerprints``; an empty table gives an
empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.llm.common import add_columns, arrow_map, materialise

SEED = 42
TREE_SIZE = 4096
# Rows of whole groups that a task turns into trees at once.
FOREST_ROWS = 65536


def _fingerprint(text, shingle: int) -> int:
    import xxhash
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:len(words) - shingle].tolist()]
        parts = [joined[a:b] for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(p, SEED) for p in parts], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for o in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[o:o + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") \
            .sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 4, out: str = "fingerprint") -> DataFrame:
    """``df`` with ``out``: the 64-bit SimHash of the text's word shingles
    (A-Z lower-cased, repeats included) as a long. Map only."""
    def start():
        return lambda texts: [[_fingerprint(t, shingle) for t in texts]]
    return add_columns(df, text, [StructField(out, LongType())], start)


# -- BK-trees, many at once -----------------------------------------------------

class Forest:
    """One BK-tree per group over the fingerprints of many groups, built
    and queried level by level with numpy."""

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        """``prints``: distinct within a group; ``group``: sorted ids."""
        n = len(prints)
        first = np.r_[True, group[1:] != group[:-1]] if n else np.empty(0, dtype=bool)
        self.prints = prints
        self.roots = np.nonzero(first)[0]
        self.groups = group[self.roots]
        parents, edges, nodes = [], [], []
        rest = np.nonzero(~first)[0]
        parent = self.roots[np.cumsum(first) - 1][rest] if n else rest
        while rest.size:
            edge = np.bitwise_count(prints[rest] ^ prints[parent]).astype(np.int64)
            key = parent * 65 + edge
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            head = np.r_[True, key[1:] != key[:-1]]
            child = rest[head]
            parents.append(key[head] // 65)
            edges.append(key[head] % 65)
            nodes.append(child)
            parent = child[np.cumsum(head) - 1][~head]
            rest = rest[~head]
        key = np.concatenate(parents) * 65 + np.concatenate(edges) if parents else np.empty(0, dtype=np.int64)
        order = np.argsort(key)
        self.edge_key = key[order]
        self.child = np.concatenate(nodes)[order] if nodes else np.empty(0, dtype=np.int64)

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int):
        """(query index, node index) of all pairs within ``radius``."""
        at = np.searchsorted(self.groups, group)
        ok = at < len(self.groups)
        ok[ok] = self.groups[at[ok]] == group[ok]
        q = np.nonzero(ok)[0]
        node = self.roots[at[ok]]
        found_q, found_n = [], []
        while q.size:
            d = np.bitwise_count(queries[q] ^ self.prints[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            lo = np.searchsorted(self.edge_key, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.edge_key, node * 65 + np.minimum(d + radius, 64), side="right")
            size = hi - lo
            total = int(size.sum())
            offset = np.repeat(np.cumsum(size) - size, size)
            node = self.child[np.arange(total) - offset + np.repeat(lo, size)]
            q = np.repeat(q, size)
        return (np.concatenate(found_q), np.concatenate(found_n)) if found_q else (q, q)


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each pair; a set's root is its smallest index."""
    while True:
        ra, rb = _root(parent, a), _root(parent, b)
        open_ = ra != rb
        if not open_.any():
            return
        a, b = ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _spanning_links(prints, group, is_query, radius):
    """Links that connect, within each group, all tree nodes and queries
    that a search joins: at most one less than their number."""
    tree = np.nonzero(~is_query)[0]
    forest = Forest(prints[tree], group[tree])
    parent = np.arange(len(prints))
    # where a group has no queries of its own, its tree is searched by itself
    asks = np.nonzero(is_query | ~np.isin(group, group[is_query]))[0]
    for o in range(0, len(asks), 1024):
        part = asks[o:o + 1024]
        q, n = forest.search(prints[part], group[part], radius)
        _union(parent, part[q], tree[n])
    root = _root(parent, np.arange(len(prints)))
    moved = np.nonzero(root != np.arange(len(prints)))[0]
    return prints[moved], prints[root[moved]]


def links(prints: DataFrame, radius: int = 4, blocks: int = 6, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs
    within ``radius`` bits. ``prints``: distinct column ``fp``. Only a
    spanning set per tree is returned, so a group of m near copies yields
    O(m) links, not m^2; components are exact."""
    if blocks <= radius:
        raise ValueError("blocks must exceed the radius")
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = []
    for keep in combinations(range(blocks), blocks - radius):
        m = 0
        for b in keep:
            m |= ((1 << cuts[b + 1]) - 1) ^ ((1 << cuts[b]) - 1)
        masks.append(m - (1 << 64) if m >> 63 else m)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
                          .alias("choice", "key"))
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / tree_size).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("k"))
    rows = keyed.join(sizes, ["choice", "key"]).withColumn("k", shards).withColumn("own", own)
    # role 0: node of tree shard x asked by block y; role 1: query of block y to tree shard x
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.when(
        j >= F.col("own"), F.struct(F.col("own").alias("x"), j.alias("y"), F.lit(0).alias("role"))).otherwise(
        F.struct(j.alias("x"), F.col("own").alias("y"), F.lit(1).alias("role")))))
    rows = rows.select("choice", "key", "fp", spread.alias("s")).select("choice", "key", "s.x", "s.y", "s.role", "fp")
    group = ["choice", "key", "x", "y"]
    dealt = rows.repartition(*group).sortWithinPartitions(*group, "role")
    out = StructType([StructField("a", LongType()), StructField("b", LongType())])

    def run(batches):
        held: list = []

        def emit(cols):
            a, b = _spanning_links(cols[0].view(np.uint64), cols[1], cols[2] == 1, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                              names=["a", "b"])

        last, number = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            keys = np.stack([c.astype(np.int64) for c in cols[:4]])
            new = np.r_[last is None or bool((keys[:, 0] != last).any()), (keys[:, 1:] != keys[:, :-1]).any(axis=0)]
            ids = number + np.cumsum(new)
            number, last = int(ids[-1]), keys[:, -1]
            held.append((cols[5], ids, cols[4]))
            if sum(len(h[0]) for h in held) >= FOREST_ROWS:
                whole = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(whole[1], number))  # the last group may go on
                if cut:
                    yield emit([c[:cut] for c in whole])
                held = [tuple(c[cut:] for c in whole)]
        if held and sum(len(h[0]) for h in held):
            yield emit([np.concatenate(c) for c in zip(*held)])

    return arrow_map(dealt, run, out).where("a != b").distinct()


# -- components -----------------------------------------------------------------

def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the
    smallest node of its component. Alternating large-star and small-star
    steps, each a partial aggregation and a join on the node (AQE splits
    the join where a node has very many neighbours)."""
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .where("u != v").distinct(), "links")
    mark = None
    while True:
        # large star: hand every larger neighbour to the smallest one
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: hand the smaller neighbours and the node to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").where("u != v").distinct()
        now = materialise(small, "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = state


def labels(prints: DataFrame, id_col: str = "doc_id", radius: int = 4) -> DataFrame:
    """Per distinct fingerprint of ``prints`` (``id_col``, fingerprint):
    fp, root (a fingerprint that names the component) and component_id,
    the smallest id reachable."""
    nodes = materialise(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_col).alias("low")), "nodes")
    tree = connected(links(nodes.select("fp"), radius))
    rooted = nodes.join(tree, nodes.fp == tree.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def components(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4,
               radius: int = 4) -> DataFrame:
    """One row per row of ``df``: id_col, fingerprint (long) and
    component_id (smallest id reachable over links of ``radius`` bits)."""
    prints = materialise(fingerprints(df.select(id_col, text), text, shingle).select(id_col, "fingerprint"), "prints")
    named = labels(prints, id_col, radius)
    return prints.join(named, prints.fingerprint == named.fp).select(id_col, "fingerprint", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4,
             radius: int = 4) -> DataFrame:
    """``df`` less near copies: of each component the row with the
    smallest id stays (rows without an id come last; of rows that repeat
    the same id and fingerprint, one stays)."""
    columns = df.columns
    tagged = fingerprints(df, text, shingle, "__print").withColumn(
        "__id", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)))
    prints = materialise(tagged.select(F.col("__id").alias("id"), F.col("__print").alias("fingerprint")), "prints")
    named = labels(prints, "id", radius).select("fp", "root")
    chosen = prints.groupBy("fingerprint").agg(F.min("id").alias("low")).join(
        named, F.col("fingerprint") == F.col("fp")).groupBy("root").agg(F.min(F.struct("low", "fp")).alias("k")) \
        .select(F.col("k.low").alias("__id"), F.col("k.fp").alias("__print"))
    return tagged.join(chosen, ["__id", "__print"]).dropDuplicates(["__id", "__print"]).select(
        *[F.col(f"`{c}`") for c in columns])


def hex16(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
