import re
import tempfile

from pyspark.sql import functions as F

from lodestar.llm import secret_scan as S
from tests.llm.brute import documents

KEY = "AKIA" + "ABCDEFGHIJKLMNOP1"
TEXTS = [(20, f'é api_key: "abc123XYZ" then {KEY} end', "a"), (21, "token=short apikey: token:abcdefg", "a"),
         (22, "Password='hunter22' PASSWD = x SECRET:deadbeef00 " + "0123456789abcdef" * 3, "a"),
         (23, "AKIA1 " + "f" * 23 + " " + "f" * 24 + "g" + "0" * 30, "a"), (24, f"{KEY}{KEY}", "a"),
         (25, 'token="' + "a1" * 20 + '" and again token="' + "a1" * 20 + '"', "a"), (26, "a1" * 20, "a")]


def brute(text):
    text, spans = text or "", []
    for i, r in enumerate(S.RULES):
        for m in re.finditer(r.pattern, text):
            if len(m.group(r.group)) >= r.least:
                spans.append((m.start(), i, r.kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


def test_spans_match_brute_force(spark):
    docs = documents(spark, TEXTS)
    want = sorted(((r.doc_id, brute(r.text)) for r in docs.collect()), key=repr)
    got = S.scan(docs).select("doc_id", S.listed().alias("s"), "Text2").collect()
    assert sorted(((r.doc_id, r.s) for r in got), key=repr) == want
    assert any(s for _, s in want)


def test_only_unseen_blobs_are_scanned(spark):
    ledger = tempfile.mkdtemp() + "/ledger"
    first = spark.createDataFrame([("p1", 1, TEXTS[0][1]), ("p2", 1, TEXTS[0][1]), ("p1", 2, "clean")],
                                  "path string, version int, text string")
    found = S.scan(first, ledger, id_col="path")
    assert found.where("size(spans) > 0").count() == 2
    assert spark.read.parquet(ledger).count() == 2
    # a ledger entry is believed: blobs it holds are not scanned again
    second = first.union(spark.createDataFrame([("p3", 1, TEXTS[2][1])], first.schema))
    S.scan(second, ledger, id_col="path").collect()
    rows = spark.read.parquet(ledger)
    assert rows.count() == 3 and rows.select("blob").distinct().count() == 3
    S.scan(second, ledger, id_col="path", rule_version="2").collect()
    assert spark.read.parquet(ledger).groupBy("rule_version").count().orderBy("rule_version").collect()[1][1] == 3


def test_empty_table(spark):
    assert S.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = S.scan(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_counts(spark):
    r = S.scan(documents(spark, TEXTS)).where("doc_id = 25").select(
        S.count_of("assign").alias("a"), S.count_of("hex").alias("h"), F.size("spans").alias("n")).first()
    assert (r.a, r.h, r.n) == (2, 2, 4)
