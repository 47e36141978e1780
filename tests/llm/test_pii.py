import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestar.llm import pii
from lodestar.llm.catalog import op9_pii
from tests.llm.brute import documents

SF = "/root/testdata/sf0.001"
TEXTS = [
    (20, "mail a.b+c@x-y.example.com, x@y, @z.de and a@b@c.com é u_1%@h.co.uk.", "a"),
    (21, "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.4 0000255.1.1.1 1.2.3", "a"),
    (22, "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004 6011000990139424 12345678901234567890", "a"),
    (23, "+1 (743) 555-3824 +12 +1234567 +49 30 1234567890123456 ++1 555 555 5555-", "a"),
    (24, "x@y.z" * 3 + " 4111111111111111@x.com +4111111111111111 ", "a"),
]


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        t += n - 9 if n > 9 else n
    return t % 10 == 0


def brute(text):
    out = []
    for kind, p in pii.PATTERNS.items():
        for m in re.finditer(p, text or ""):
            s = m.group()
            d = re.sub("[^0-9]", "", s)
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")),
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def text_of(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans(spark):
    docs = documents(spark, TEXTS)
    got = sorted(((r.doc_id, r.s) for r in pii.sanitise(docs).select("doc_id", pii.listed("base").alias("s")).collect()),
                 key=repr)
    assert got == sorted(((r.doc_id, text_of(brute(r.text))) for r in docs.collect()), key=repr)
    assert sum(bool(s) for _, s in got) == 5


def test_query_over_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op9_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(text_of(base).split(",")) - {""} <= set(spans)
        assert base or not spans


def corpus(spark):
    """A nickname that stands beside one address alone, a common word."""
    rows = [(i, f"write to Zorro Smith at zorro@x.org about number {i}") for i in range(6)]
    rows += [(i, f"write about number {i} to someone about Smith") for i in range(6, 40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_disclosing_terms_go_and_common_ones_stay(spark):
    got = {r.doc_id: r for r in pii.sanitise(corpus(spark)).collect()}
    assert got[0].clean == "write to  Smith at [EMAIL] about number 0"
    assert all(got[i].clean == got[i].text and not got[i].spans for i in range(6, 40))
    terms = {r.term: r.action for r in pii.disclosing(corpus(spark), pii.scan(corpus(spark)).where("size(context) > 0")
                                                      .select("context")).collect()}
    assert terms == {"zorro": "remove"}


def test_rare_terms_are_no_evidence(spark):
    df = spark.createDataFrame([(0, "only once zorro@x.org beside Quixote"), (1, "nothing here")],
                               "doc_id long, text string")
    assert {r.clean for r in pii.sanitise(df).collect()} == {"only once [EMAIL] beside Quixote", "nothing here"}


def test_clean_replaces_all_spans_and_keeps_the_rest(spark):
    docs = documents(spark, TEXTS)
    out = pii.sanitise(docs)
    assert set(docs.columns) < set(out.columns)
    for r in out.collect():
        if not r.spans:
            assert r.clean == r.text
        else:
            assert not any(r.text[s.start:s.end] in r.clean for s in r.base if s.kind != "email" or True)


def test_empty_table(spark):
    assert pii.sanitise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_terms_far_from_the_entity_are_counted_and_marked_in_whole_texts(spark):
    gap = " filler" * 20
    rows = [(i, f"Zorro wrote.{gap} his address is zorro@x.org{gap} and so did Zorro, number {i}") for i in range(6)]
    rows += [(i, f"nobody wrote.{gap} number {i}") for i in range(6, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert all("Zorro" not in got[i].clean for i in range(6))
    assert [sum(s.kind == "remove" and got[0].text[s.start:s.end] == "Zorro" for s in got[i].spans)
            for i in range(6)] == [2] * 6
    assert all(got[i].clean == got[i].text for i in range(6, 40))


def test_counts_are_of_documents_and_outside_spans(spark):
    """n(e) = 6, of which 3 hold no term; n(e,t) = n(t) = 3: one in two
    documents of N = 40 discloses all; a term inside an address is none."""
    rows = [(i, "zorro@x.org Quixote" if i < 3 else "zorro@x.org") for i in range(6)]
    rows += [(i, "12 quixotes@quixote.com" if i < 30 else "34") for i in range(6, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.term: r.n for r in pii.term_counts(df).collect()} == {"quixote": 3}
    got = pii.disclosing(df, pii.scan(df).where("size(context) > 0").select("context")).collect()
    assert [(r.entity, r.term, r.action) for r in got] == [("zorro@x.org", "quixote", "remove")]


def test_clashing_columns_are_kept(spark):
    rows = [(1, "write to a@b.co today", "k", 2.0, "c", "t"), (2, "nothing here", "k", 3.0, "c", "t"), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, told double, context string, known string")
    df = df.withColumns({"__told": F.lit(1), "row": F.lit("r"), "Spans": F.lit(7)})
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert (got[1].key, got[1].told, got[1].context, got[1].known, got[1]["__told"], got[1].row) == ("k", 2.0, "c", "t", 1, "r")
    assert got[1].clean == "write to [EMAIL] today" and got[2].clean == "nothing here" and got[3].clean is None
    assert [tuple(s) for s in got[1].spans] == [("email", 9, 15)] and got[3].spans == []


def test_entities_of_one_document_have_disclosing_terms(spark):
    rows = [(i, f"person{i}@x.org and neighbour{i} wrote about it") for i in range(100)]
    got = {r.doc_id: r.clean for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "[EMAIL] and  wrote about it" for i in range(100)}


def test_spans_of_a_whole_table_equal_a_plain_count(spark):
    """Document frequencies counted one by one, without Spark."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    base = {i: brute(t) for i, t in texts.items()}

    def terms(i):
        taken = [(a, b) for _, a, b in base[i]]
        return [m for m in re.finditer(r"[^\W_]{3,}", texts[i])
                if not any(a < m.end() and m.start() < b for a, b in taken)]

    def entities(i):
        return {(k, texts[i][a:b] if k == "email" else re.sub(r"[^0-9.]" if k == "ip" else r"[^0-9]", "", texts[i][a:b]))
                for k, a, b in base[i]}

    n_term, n_entity, joint = Counter(), Counter(), Counter()
    for i in texts:
        held = {m.group().lower() for m in terms(i)}
        n_term.update(held)
        n_entity.update(entities(i))
        joint.update((e, t) for e in entities(i) for t in held)
    n = len(texts)

    def action(i, term):
        shares = [math.log(n * (joint[e, term] - 0.5) / (n_entity[e] * n_term[term])) / math.log(n / n_entity[e])
                  for e in entities(i)]
        return "remove" if max(shares) >= 0.8 else "generalise" if max(shares) >= 0.5 else None

    added = 0
    for r in op9_pii(spark, SF).select("doc_id", "spans").collect():
        more = sorted((action(r.doc_id, m.group().lower()), *m.span()) for m in terms(r.doc_id)
                      if base[r.doc_id] and action(r.doc_id, m.group().lower()))
        assert r.spans == text_of(base[r.doc_id] + more)
        added += len(more)
    assert added
