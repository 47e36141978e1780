"""Byte-level BPE encoding and decoding.

Each match of the split pattern is encoded separately. A segment tree
over the byte positions of a piece stores, per node, the leftmost
minimum pair rank below it; a merge takes the root's pair, joins the two
live neighbours and updates three leaves with a logarithmic number of
node updates each. Many pieces are merged at once: pieces of one size
class form the rows of one array of trees, so each step is a handful of
numpy operations over all of them. Pieces seen before in the task come
from a bounded cache.

Defined cases: a null text is empty; an empty text has no ids; repeated
rows are encoded alike; extra columns are kept; a clashing column named
like an output is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from lodestar.llm.common import add_columns

# Pieces kept per task between batches, and leaves of one array of trees.
CACHE_PIECES = 200_000
TREE_LEAVES = 1 << 17
_NONE = np.int64(1) << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys left * width + right of all pairs of tokens whose
    joined bytes are a token, that token's rank, and the ids of the 256
    single bytes."""
    width = max(ranks.values()) + 1
    keys, merged = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left * width + right)
                merged.append(rank)
    order = np.argsort(np.array(keys, dtype=np.int64))
    single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    return np.array(keys, dtype=np.int64)[order], np.array(merged, dtype=np.int64)[order], single


class Merger:
    """Merges byte pieces by rank with arrays of segment trees."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.keys, self.merged, self.single = pair_table(ranks)
        self.width = max(ranks.values()) + 1

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joined pair, or -1 where it is no token."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif not piece:
                out[i] = b""
            else:
                classes.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, members in classes.items():
            leaves = 1 << bits
            step = max(1, TREE_LEAVES // leaves)
            for o in range(0, len(members), step):
                part = members[o:o + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], leaves)):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), dtype=np.uint8)
        # one extra column so that a "next" past the end can be written
        ids = np.full((n, leaves + 1), -1, dtype=np.int64)
        ids[:, :leaves] = self.single[flat].reshape(n, leaves)
        ids[np.arange(leaves + 1)[None, :] >= lengths[:, None]] = -1
        after = np.tile(np.arange(1, leaves + 2, dtype=np.int64), (n, 1))
        before = np.tile(np.arange(-1, leaves, dtype=np.int64), (n, 1))
        # tree[r, leaves + p]: rank * leaves + p of the pair that starts at p
        tree = np.full((n, 2 * leaves), _NONE, dtype=np.int64)
        if leaves > 1:
            has = np.arange(leaves - 1)[None, :] + 1 < lengths[:, None]
            rank = self.pair_rank(ids[:, :leaves - 1], ids[:, 1:leaves])
            tree[:, leaves:2 * leaves - 1] = np.where(has & (rank >= 0), rank * leaves + np.arange(leaves - 1), _NONE)
            level = leaves // 2
            while level:
                low = tree[:, 2 * level:4 * level]
                tree[:, level:2 * level] = np.minimum(low[:, 0::2], low[:, 1::2])
                level //= 2
        live = np.nonzero(tree[:, 1] < _NONE)[0] if leaves > 1 else np.empty(0, dtype=np.int64)
        while live.size:
            root = tree[live, 1]
            p, new = root % leaves, root // leaves
            q = after[live, p]
            nxt = after[live, q]
            ids[live, p] = new
            ids[live, q] = -1
            after[live, p] = nxt
            before[live, np.minimum(nxt, leaves)] = p
            self._set(tree, live, q, np.full(live.size, _NONE), leaves)
            ok = nxt < leaves
            right = ids[live, np.minimum(nxt, leaves)]
            self._set(tree, live, p, self._leaf(new, right, p, ok & (right >= 0), leaves), leaves)
            left = before[live, p]
            there = left >= 0
            rows, left = live[there], left[there]
            if rows.size:
                self._set(tree, rows, left, self._leaf(ids[rows, left], new[there], left,
                                                       np.ones(rows.size, dtype=bool), leaves), leaves)
            live = live[tree[live, 1] < _NONE]
        kept = ids[:, :leaves]
        mask = kept >= 0
        packed = kept[mask].astype("<u4").tobytes()
        ends = np.cumsum(mask.sum(axis=1)) * 4
        starts = [0, *ends[:-1].tolist()]
        return [packed[a:b] for a, b in zip(starts, ends.tolist())]

    def _leaf(self, left, right, at, ok, leaves):
        rank = self.pair_rank(left, np.where(ok, right, 0))
        return np.where(ok & (rank >= 0), rank * leaves + at, _NONE)

    @staticmethod
    def _set(tree, rows, at, value, leaves):
        """Point update of one leaf per row, then of its ancestors."""
        node = leaves + at
        tree[rows, node] = value
        node = node >> 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text",
           out: str = "token_ids") -> DataFrame:
    """``df`` with ``out``: the ids of the text as little-endian unsigned
    32-bit integers (binary; ``token_count`` gives their number). The
    rank table is model-sized and travels as a broadcast variable. Map
    only; the text column stays."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    # the split pattern's white space is Unicode's White_Space property
    split = pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"(?!\S)", r"(?!\P{White_Space})") \
        .replace(r"\s", r"\p{White_Space}")

    def start():
        import regex
        merger = Merger(shared.value)
        find = regex.compile(split).findall
        cache: dict[str, bytes] = {}

        def work(texts):
            lists = [find(t) if t else [] for t in texts]
            fresh = list({p for pieces in lists for p in pieces if p not in cache})
            cache.update(zip(fresh, merger.encode([p.encode("utf-8") for p in fresh])))
            out = [b"".join([cache[p] for p in pieces]) for pieces in lists]
            if len(cache) > CACHE_PIECES:
                cache.clear()
            return [out]
        return work

    return add_columns(df, text, [StructField(out, BinaryType())], start)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes that the packed ids stand for (null
    ids give empty bytes)."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def start():
        tokens: list = [b""] * (max(shared.value.values()) + 1)
        for token, rank in shared.value.items():
            tokens[rank] = token

        def work(packed):
            return [[b"".join([tokens[i] for i in np.frombuffer(p or b"", dtype="<u4").tolist()]) for p in packed]]
        return work

    return add_columns(df, ids, [StructField(out, BinaryType())], start)


def token_count(ids: str = "token_ids") -> Column:
    return F.floor(F.length(ids) / 4).cast("long")
