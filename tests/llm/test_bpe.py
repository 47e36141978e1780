import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from lodestar.llm import bpe
from lodestar.llm.catalog import op1_byte_bpe
from tests.llm.brute import documents

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def unpack(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def test_awkward_texts(spark, ranks, library):
    rnd = random.Random(5)
    alphabet = ["a", "b", " ", "  ", "\x1c", "\x85", " ", "\xa0", "é", "ß", "日", "1", "Ⅷ", "'s", "'ll", "\n", "\t",
                "​", "!", "👍", "́", "\x00", "\r\n", "<|endoftext|>"]
    extra = [(100 + i, "".join(rnd.choices(alphabet, k=rnd.randint(0, 40))), "r") for i in range(300)]
    extra.append((900, "ab" * 3000 + " " * 999 + "!" * 2049, "r"))
    docs = documents(spark, extra)
    out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(out) == docs.count()
    assert "Text2" in out[0].asDict()
    for r in out:
        assert unpack(r.token_ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_clashing_output_column_is_replaced(spark, ranks):
    df = spark.createDataFrame([("hello world", 1)], "text string, TOKEN_IDS int")
    out = bpe.encode(df, ranks, public_tokenizers.PATTERN)
    assert out.columns == ["text", "token_ids"]


def test_empty_table(spark, ranks):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, ranks, public_tokenizers.PATTERN).count() == 0


def test_query_over_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op1_byte_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
