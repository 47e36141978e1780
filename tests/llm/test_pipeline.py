from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from lodestar.llm import bpe, mixing, pii, toxicity
from tests.llm.brute import components, fingerprint
from tests.llm.test_pii import brute as base_spans

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        before, after = docs.collect(), out.collect()
        by_id = {r.doc_id: r for r in before}
        if name != "byte_bpe":
            assert out.columns == docs.columns
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
            assert sorted(after) == sorted(r for r in before if r.doc_id not in bad)
        elif name == "simhash_near_dedup":
            prints = {r.doc_id: fingerprint(r.text) for r in before}
            want = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
            assert sorted(r.doc_id for r in after) == sorted(set(want.values()))
            assert all(by_id[r.doc_id] == r for r in after)
        elif name == "pii":
            clean = {r.doc_id: r.clean for r in pii.sanitise(docs).collect()}
            assert {r.doc_id: r.text for r in after} == clean
            for r in after:
                assert r.n_chars == len(r.text)
                found = base_spans(by_id[r.doc_id].text)
                assert bool(found) == (r.text != by_id[r.doc_id].text)
                assert not any(by_id[r.doc_id].text[a:b] in r.text for _, a, b in found)
        elif name == "mixing":
            times = {r.doc_id: r.taken // r["size"] for r in mixing.shares(docs).collect() if r["size"]}
            assert Counter(r.doc_id for r in after if times.get(r.doc_id)) == Counter(
                {i: n for i, n in times.items() if n})
            assert all(by_id[r.doc_id] == r for r in after)
        else:
            ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={})
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
            for r in after:
                assert r.token_ids == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(
                    by_id[r.doc_id].text)) and r.n_tokens == len(r.token_ids) // 4
        docs = out


def test_run_gives_the_last_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted((r.doc_id, bytes(r.token_ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)
