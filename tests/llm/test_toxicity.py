from zlib import crc32

from lodestar.llm import toxicity
from lodestar.llm.catalog import op6_toxicity
from tests.llm.brute import documents

SF = "/root/testdata/sf0.01"


def planted(spark, n=400):
    """Every fourth document has one toxic sentence among clean ones."""
    rows, marks = [], []
    for i in range(n):
        parts = [f"calm prose number {i} goes on about {('rivers', 'trees', 'roads')[i % 3]} again" for _ in range(5)]
        if i % 4 == 0:
            parts[i % 5] = f"you are a {('vile', 'rotten')[i // 4 % 2]} creature number {i}"
        rows.append((i, ". ".join(parts) + "."))
        marks.append((i, int(i % 4 == 0)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(marks, "doc_id long, toxic int"))


def test_documents_and_sentences_on_held_out_rows(spark):
    docs, marks = planted(spark)
    got = toxicity.score(docs, toxicity.fit(docs, marks)).withColumn("held", toxicity.held_out()).collect()
    for r in got:
        assert r.held == (crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.doc_id % 4 == 0)
        if r.predicted:
            found = [r.text[s.start:s.end] for s in r.offending]
            assert len(found) == 1 and ("vile" in found[0] or "rotten" in found[0])


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, marks = planted(spark, 200)
    turned = marks.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) toxic")
    a, b = toxicity.fit(docs, marks), toxicity.fit(docs, turned)
    assert a == b


def test_accuracy_on_the_table(spark):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op6_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    judged = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert sum(p == y for p, y in judged) >= 0.95 * len(judged)
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows_and_labels(spark):
    docs = documents(spark)
    marks = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 1), (None, 1), (5, None), (6, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    assert len(got) == docs.count() and all(r.score is not None for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, toxicity.fit(empty, marks)).count() == 0


def test_sample_holds_one_row_of_an_id(spark):
    """A third of all rows share an id; copies and texts of their own."""
    docs, marks = planted(spark, 300)
    own = spark.range(150).selectExpr("3L doc_id", "concat('text ', id % 50) text")
    sample = toxicity.training_sample(docs.unionByName(own), marks, "toxic", "doc_id", "text", 10_000)
    ids = marks.where(~toxicity.held_out()).count()
    assert sample.count() == ids
    few = toxicity.training_sample(docs.unionByName(own), marks, "toxic", "doc_id", "text", 40).count()
    assert 15 <= few <= 80
