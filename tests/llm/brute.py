"""Plain single-process versions of the operators' contracts, and rows
that hold the awkward cases."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, Text2 string, fingerprint string, score double, n_words string"


def documents(spark, extra=()):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    prose = "The quick brown fox jumps over the lazy dog and runs away from the old grey cat behind the barn today"
    rows = [
        (0, prose, "a"), (1, prose + " again", "a"), (2, None, "a"), (3, "", None), (4, " \t\n ", "b"),
        (5, "x", "b"), (6, "y z", "b"), (7, prose, "a"), (7, prose, "a"), (8, "word " * 3000, "c"),
        (9, "\n".join(["same line here"] * 5), "c"), (10, "é ß 日本語 \U0001F44D nbsp \x85 \x1c end", "c"),
        (None, prose + " again", "a"), (None, None, None), (11, "a" * 5000, "b"), *extra]
    return spark.createDataFrame([(i, t, s, "t2", "fp", 1.0, "w") for i, t, s in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def components(ids, linked):
    """Smallest id reachable, by brute force over all pairs."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def fingerprint(text, shingle=4):
    import xxhash
    words = [w.encode() for w in WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))]
    if not words:
        return 0
    parts = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def removed(docs, window=13):
    """(doc_id, text) rows -> list of (words, removed flags)."""
    starts = defaultdict(set)
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                starts[tuple(w[k:k + window])].add(i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and min(starts[tuple(w[k:k + window])]) < i:
                gone[k:k + window] = [True] * window
        out.append((w, gone))
    return out
