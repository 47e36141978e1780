"""Registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, chat, divergence, mixing, negatives, pii, quality, secret_scan, simhash, substrings, topk, toxicity, warc
from lodestar.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "token_ids")
    both = bpe.decode(ids, ranks)
    return both.select("doc_id", bpe.token_count().alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[secret_scan.count_of(r.kind).alias(f"n_{r.kind}") for r in secret_scan.RULES],
                        F.sha2(secret_scan.listed(), 256).alias("base_sha256"), secret_scan.listed().alias("spans"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "rule")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted",
                                              "offending")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    made = chat.examples(rows.unionByName(planted))
    turns = F.array_join(F.transform(chat.parsed(F.col("formatted")), lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = made.select("conv_id", "upto", chat.masked().alias("loss"), F.length("formatted").alias("chars"),
                       F.when(F.col("is_last"), F.sha2(turns, 256)).alias("sha"))
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct(
        "upto", "loss")))), lambda x: x["loss"]), "")
    whole = read.groupBy("conv_id").agg(F.max("upto").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"),
                                        loss.alias("loss"), F.sum("chars").cast("long").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.sanitise(docs)
    return found.select("doc_id", *[pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fingerprint").alias("fingerprint"), "component_id")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"))
    return warc.resolve(warc.read(spark, warc.deduplicate(spark, archive))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_secrets": op2_secrets,
    "op3_topk": op3_topk,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_chat": op7_chat,
    "op8_substrings": op8_substrings,
    "op9_pii": op9_pii,
    "op10_simhash": op10_simhash,
    "op11_negatives": op11_negatives,
    "op12_warc": op12_warc,
    "op13_divergence": op13_divergence,
}

_OP2 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT r, 'assign' AS kind, 1 AS place, string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS b,
        regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
        regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g,
        6 AS least FROM t
  UNION ALL SELECT r, 'access', 2, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0),
        regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), 20 FROM t
  UNION ALL SELECT r, 'hex', 3, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+', 0),
        regexp_extract_all(t, '[0-9a-f]+', 0), 24 FROM t),
s AS (SELECT r, kind, place, least, unnest(m) AS m, unnest(g) AS g, unnest(b[1:len(m)]) AS b,
        unnest(range(1, len(m) + 1)) AS i FROM a WHERE len(m) > 0),
p AS (SELECT r, kind, place, least, g, sum(length(b) + length(m)) OVER (PARTITION BY r, place ORDER BY i) AS e, length(m) AS n
      FROM s),
k AS (SELECT r, kind, place, (e - n)::BIGINT AS st, e::BIGINT AS e FROM p WHERE length(g) >= least),
j AS (SELECT r, string_agg(kind || ':' || st || ':' || e, ',' ORDER BY st, place) AS spans,
        count(*) FILTER (WHERE place = 1) AS n1, count(*) FILTER (WHERE place = 2) AS n2, count(*) FILTER (WHERE place = 3) AS n3
      FROM k GROUP BY r)
SELECT doc_id, coalesce(n1, 0) AS n_assign, coalesce(n2, 0) AS n_access, coalesce(n3, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN j USING (r)
"""

_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


_OP7 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
  sum(length({_escaped('role')}) + length({_escaped('text')}) + 13) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, max(n_turns) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR place = n_turns))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
h AS (SELECT r, doc_id, i, md5(list_aggregate(w[i:i + 12], 'string_agg', ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM h JOIN f USING (h) WHERE doc_id > least),
x AS (SELECT r, list(i) AS gone FROM g GROUP BY r),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN x USING (r)),
z AS (SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
    list_filter(w, lambda v, i: NOT list_contains(gone, i)) AS kept FROM k)
SELECT doc_id, n_words, n_removed, sha256(coalesce(list_aggregate(kept, 'string_agg', ' '), '')) AS kept_sha256 FROM z
"""

_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

_OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS kept,
  row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS place FROM p),
b AS (SELECT *, list_transform(range(4), lambda i: ('0x' || s[10 * i + 1:10 * i + 10])::BIGINT) AS parts FROM g)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(flatten(list_transform(parts, lambda x: list_transform(range(8),
    lambda j: ('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[1 + (x >> (35 - 5 * j)) % 32]))), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN kept END AS refers_to FROM b
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT r, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS total FROM c GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT lang, source, term, sum(n)::BIGINT AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
h AS (SELECT g.lang, g.source, coalesce(sum(e.n), 0) + 5 * coalesce(any_value(v.v), 0) AS whole
  FROM g LEFT JOIN e USING (lang, source) LEFT JOIN v USING (lang) GROUP BY g.lang, g.source),
f AS (SELECT h.lang, h.source, k.term, coalesce(e.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(e.n, 0) + 5)) // h.whole::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.total + 5)) // (v.n + 5 * v.v)::HUGEINT AS q
  FROM h JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN e ON e.lang = h.lang AND e.source = h.source AND e.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM f WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM z WHERE part = 'pair' OR rank <= 50
"""

# Left out where SQL lacks the hash, the vocabulary or the fitted model
# that the query names: those are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_secrets": _OP2,
    "op3_topk": _OP3,
    "op7_chat": _OP7,
    "op8_substrings": _OP8,
    "op11_negatives": _OP11,
    "op12_warc": _OP12,
    "op13_divergence": _OP13,
}
