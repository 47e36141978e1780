from lodestar.llm import simhash
from lodestar.llm.catalog import op10_simhash
from tests.llm.brute import components, documents, fingerprint

SMALL = "/root/testdata/sf0.001"


def near(a, b, radius=4):
    return (a ^ b).bit_count() <= radius


def test_awkward_table(spark):
    docs = documents(spark)
    rows = docs.collect()
    prints = {r.doc_id: fingerprint(r.text) for r in rows if r.doc_id is not None}
    want = components(list(prints), lambda a, b: near(prints[a], prints[b]))
    got = simhash.components(docs).select("doc_id", simhash.hex16("fingerprint").alias("fp"), "component_id").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert int(r.fp, 16) == prints[r.doc_id] and len(r.fp) == 16
            assert r.component_id == want[r.doc_id]
        else:
            assert r.component_id in (1, 2)


def test_query_over_whole_table(spark):
    prints = {r.doc_id: fingerprint(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = components(list(prints), lambda a, b: near(prints[a], prints[b]))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in op10_simhash(spark, SMALL).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}


def test_links_of_crowded_keys(spark):
    """Chains and dense groups over several tree shards lose no link."""
    base = 0x0123456789ABCDEF
    prints = {base ^ ((1 << i) - 1) for i in range(64)} | {base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fingerprint long")
    for size in (7, 4096):
        tree = simhash.connected(simhash.links(df.selectExpr("fingerprint as fp"), 1, blocks=3, tree_size=size))
        roots = {r.node: r.root for r in tree.collect()}
        want = components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 1)
        for a in signed:
            assert roots.get(a, a) == want[a]


def test_keep_one_row_of_each_group(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    n = simhash.components(docs).count()
    assert 0 < kept.count() < n
    comps = {(r.doc_id, r.component_id) for r in simhash.components(docs).where("doc_id is not null").collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in comps})


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(empty).count() == 0 and simhash.keep_one(empty).count() == 0
