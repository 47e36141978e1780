import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import divergence
from lodestar.llm.catalog import op13_divergence
from tests.llm.brute import documents, rows_of

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs=30, top=50):
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[(lang or "", source or "")].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    for lang in df:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        groups = {s: c for (other, s), c in counts.items() if other == lang}
        total = Counter()
        for c in groups.values():
            total.update({t: c[t] for t in kept})

        def shares(c):
            whole = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // whole for t in kept}
        p, q = {s: shares(c) for s, c in groups.items()}, shares(total)
        for s, c in groups.items():
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, i, -v, r) for r, (v, i) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows],
                                 "lang string, source string, text string, term string, n long, Value long")


def test_table(spark):
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert rows_of(op13_divergence(spark, SMALL)) == brute(rows)


def _rows():
    words = ["Alpha", "beta", "GAMMA", "délta", "Épsilon", " zeta", "eta1theta", "日本語", "ÀB", "x_y", "[q]"]
    out = []
    for i in range(240):
        chosen = [w for k, w in enumerate(words) if (i * (k + 3)) % 7 < 3]
        out.append((["en", "de", None, ""][i % 4], [f"s{i % 5}", None, "S", "ß"][i % 3], " ".join(chosen * (1 + i % 4))))
    return out + [("fr", "only", "alpha beta"), ("it", "a", "rare"), ("it", "b", None), ("it", None, ""),
                  ("en", "new", "rare words here"), ("en", "s0", "beta " * 5000)] + [("en", "s0", "beta gamma")] * 40


def test_awkward_rows(spark):
    assert rows_of(divergence.audit(frame(spark, _rows()))) == brute(_rows())
    assert rows_of(divergence.audit(frame(spark, _rows()), min_docs=1, top=2)) == brute(_rows(), 1, 2)


def test_documents_with_clashing_columns(spark):
    df = documents(spark).withColumn("lang", F.lit("en")).withColumn("rank", F.lit(1))
    rows = [(r.lang, r.source, r.text) for r in df.collect()]
    assert rows_of(divergence.audit(df, min_docs=2)) == brute(rows, 2)


def test_many_sources_chunks_and_flushes(spark, monkeypatch):
    for name, value in (("CHUNK", 4), ("BLOCK", 3), ("HELD_TERMS", 5), ("PIECE", 16)):
        monkeypatch.setattr(divergence, name, value)
    rows = _rows() + [("de", f"w{i % 40}", "alpha beta gamma " * (1 + i % 3)) for i in range(200)]
    assert rows_of(divergence.audit(frame(spark, rows), min_docs=3)) == brute(rows, 3)


def test_empty(spark):
    assert rows_of(divergence.audit(frame(spark, []))) == []


def test_runs_are_few_and_pairs_equal_the_dense_sum(spark):
    """Equal counts stand together, and the runs say what the columns say."""
    state = divergence.prepare(frame(spark, _rows()), min_docs=1)
    runs = divergence.run_lengths(state).collect()
    dense = state.entries.count()
    assert sum(len(r.runs) for r in runs) < dense
    assert sum(x["length"] for r in runs for x in r.runs) == dense


def test_difference_of_run_length_columns():
    rng = np.random.default_rng(3)
    for _ in range(50):
        lo, n = int(rng.integers(0, 5)), int(rng.integers(1, 60))
        columns, runs = [], []
        for _ in range(2):
            c = rng.integers(0, 3, n)
            cuts = [i for i in range(n) if i == 0 or c[i] != c[i - 1]] + [n]
            runs.append(pa.array([{"first": lo + a, "length": b - a, "n": int(c[a])} for a, b in zip(cuts, cuts[1:]) if c[a]],
                                 pa.struct([("first", pa.int32()), ("length", pa.int32()), ("n", pa.int64())])))
            columns.append(c)
        whole = [int(c.sum()) + 5 * n for c in columns]
        p = [1 + 10**9 * (c.astype(object) + 5) // w for c, w in zip(columns, whole)]
        got = divergence._difference(*[divergence._column(r, w, lo, lo + n - 1) for r, w in zip(runs, whole)], lo + n - 1)
        assert got == sum(abs(a - b) for a, b in zip(*p))
