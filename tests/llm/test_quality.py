import re
from collections import Counter

from pyspark.sql import functions as F

from lodestar.llm import quality
from lodestar.llm.catalog import op5_quality
from tests.llm.brute import WORD, documents

SMALL = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    under = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            under.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(under))


def keys(rows):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows),
                  key=repr)


def test_counts_of_awkward_texts(spark):
    phrase = "one two three four five six seven eight nine"
    extra = [(30, f"{phrase} x {phrase}", "a"), (31, "a b " * 9, "a"), (32, " ".join(phrase.split()[:8] * 2), "a"),
             (33, "#*$ a%&|<> b!\n\n \nc\nc\n c\nc", "a")]
    docs = documents(spark, extra)
    got = quality.statistics(docs)
    assert "text" not in got.columns and "Text2" in got.columns
    assert keys(got.collect()) == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=repr)


def test_query_over_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op5_quality(spark, SMALL).collect()
    assert keys(rows) == sorted(((i, *brute(t)) for i, t in texts.items()), key=repr)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_learned_list_finds_the_planted_rule(spark):
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(f"w{i}x{j}{'###' if bad else ''}" for j in range(40))
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(0, 600)] + [(1, None), (None, 0)],
                                  "doc_id long, quality int")
    got = quality.judge(docs, marks).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in got)
    rules = quality.learn(quality.labelled_counts(quality.statistics(docs), marks))
    assert any("symbols_per_word" in str(c) or "word_length" in str(c) for c in rules[0])


def test_without_labels_the_base_rule_decides(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(documents(spark), none).collect()
    assert len(got) == documents(spark).count()
    assert all(r.kept == (not r.base_failed) for r in got)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(none, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.kept, marks[r.doc_id], r.base_failed) for r in op5_quality(spark, sf).collect() if r.doc_id in marks]
    good = [k for k, q, b in got if q == 1 and not b]
    assert sum(good) >= 0.97 * len(good)


def test_no_python_in_the_plan(spark):
    assert not re.search("Python|Arrow|Pandas", quality.statistics(documents(spark))._jdf.queryExecution().toString())


def test_covering_goes_on_while_rules_hold(spark):
    """Twelve kinds of bad text, each between two good ones: a rule each."""
    rows = [(20 + 10 * v, 5 * (20 + 10 * v), 0, 0, 0, 0, 0, 1 - v % 2, i % 3) for v in range(24) for i in range(36)]
    labelled = spark.createDataFrame(
        rows, ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                              "n_upper", "n_marks")) + ", good int, part int")
    rules = quality.learn(labelled)
    assert len(rules) == 12
    said = quality.verdict(rules, quality.features(), False, True)
    assert labelled.where(said != (F.col("good") == 1)).count() == 0
