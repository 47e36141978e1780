"""Personal data: patterns, and the terms that give them away.

Information-theoretic sanitisation. Pattern matches are the protected
entities. A term (three or more letters or digits) in a text with an
entity tells about it as much as their co-occurrence in the corpus says:
with document frequencies, all of them over whole texts and, for terms,
outside all matches, the pointwise mutual information
log(N (n(e,t) - d) / (n(e) n(t))) is the part of the entity's information
content log(N / n(e)) that the term discloses. The discount d takes from
each joint count what chance may have added: a pair seen once counts half,
so that in a small corpus it proves little, and in a large one an entity
of a single document has disclosing terms like any other. Terms that
disclose at least ``remove_at`` are removed wherever they stand in texts
with that entity, those from ``generalise_at`` on are generalised.

All counts cover all documents. Terms are counted per task before the
shuffle; entity-term pairs come only from texts that hold an entity, are
aggregated per task and salted for frequent entities where they meet
their count, and only texts with an entity are shuffled when the findings
are joined back. Entities of a single document have equal counts with
each of its terms; the least one of a document speaks for all of them.

Defined cases: null and empty texts have no spans; repeated rows are
treated alike; extra columns are kept; an empty table gives an empty
table.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lodestar.llm.common import add_columns, emit_rows, materialise

# The patterns, in the order in which kinds are listed.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_REGEX = {k: re.compile(p) for k, p in PATTERNS.items()}
_TERM = re.compile(r"[^\W_]{3,}")
COUNT_TERMS = 300_000
SALTS = 32
# An entity with more than this share of all uses is salted; there are fewer than 1 / share of them.
HOT_SHARE = 0.001


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in found.split("."))
    digits = "".join(c for c in found if "0" <= c <= "9")
    return 16 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def _emails(t: str):
    """Matches of the e-mail pattern, tried only in front of an @, so
    that a long text without one costs one search."""
    done, at = 0, t.find("@")
    while at >= 0:
        first = at
        while first > done and t[first - 1] in _LOCAL:
            first -= 1
        m = _REGEX["email"].match(t, first) if first < at else None
        if m:
            yield m
            done = m.end()
        at = t.find("@", max(at + 1, done))


# Fixed value: the characters in front of an @.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def find(t: str | None) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) by kind as listed, then start."""
    if not t:
        return []
    spans = [("email", m.start(), m.end()) for m in _emails(t)] if "@" in t else []
    for kind in KINDS[1:]:
        spans += [(kind, m.start(), m.end()) for m in _REGEX[kind].finditer(t) if _holds(kind, m.group())]
    return spans


def _terms(t: str, spans):
    """Matches of the terms of a text outside all spans."""
    taken = sorted((a, b) for _, a, b in spans)
    k = end = 0
    for m in _TERM.finditer(t):
        while k < len(taken) and taken[k][0] < m.end():
            end = max(end, taken[k][1])
            k += 1
        if end <= m.start():
            yield m


def _term_set(t: str, spans) -> set[str]:
    found = {m.group() for m in _terms(t, spans)} if spans else set(_TERM.findall(t))
    return {x.lower() for x in found}


def _context(t: str, spans):
    """The distinct entities (kind, entity, no term) of a text, then its
    distinct terms (no kind, no entity, term)."""
    entities = {(kind, t[a:b] if kind == "email" else "".join(c for c in t[a:b] if c.isdigit() or kind == "ip"))
                for kind, a, b in spans}
    return [(*e, None) for e in sorted(entities)] + [(None, None, x) for x in sorted(_term_set(t, spans))]


_SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()),
                    StructField("end", LongType())])
_CONTEXT = StructType([StructField("kind", StringType()), StructField("entity", StringType()),
                       StructField("term", StringType())])


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with base (spans by kind, then start) and context (the
    entities and terms of a text with spans, else empty). Map only."""
    fields = [StructField("base", ArrayType(_SPAN)), StructField("context", ArrayType(_CONTEXT))]
    span_names, context_names = _SPAN.names, _CONTEXT.names

    def start():
        def work(texts):
            base = [find(t) for t in texts]
            near = [_context(t, s) if s else [] for t, s in zip(texts, base)]
            return [[[dict(zip(span_names, s)) for s in b] for b in base],
                    [[dict(zip(context_names, c)) for c in n] for n in near]]
        return work

    return add_columns(df, text, fields, start)


def term_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): the documents of the corpus that hold each term outside
    all spans."""
    out = StructType([StructField("term", StringType()), StructField("n", LongType())])

    def start():
        counts: Counter = Counter()

        def flush():
            cols = [list(counts.keys()), list(counts.values())]
            counts.clear()
            return cols

        def step(texts):
            for t in texts:
                if t:
                    counts.update(_term_set(t, find(t)))
            return flush() if len(counts) > COUNT_TERMS else None
        return step, flush

    return emit_rows(df.select(text), out, start).groupBy("term").agg(F.sum("n").alias("n"))


def _entities(contexts: DataFrame) -> DataFrame:
    """(kind, entity, ne): the documents that hold each entity."""
    return contexts.select(F.explode("context").alias("c")).where("c.kind IS NOT NULL").groupBy(
        F.col("c.kind").alias("kind"), F.col("c.entity").alias("entity")).agg(F.count("*").alias("ne"))


def _pairs(contexts: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per document (key), entity of ``entities`` (with its other
    columns) and term that it holds; with ``ne``, entities of one document
    are represented by the least one."""
    counted = _entities(contexts)
    total = counted.agg(F.coalesce(F.sum("ne"), F.lit(0))).first()[0]
    # fewer than 1 / HOT_SHARE rows
    hot = F.broadcast(counted.where(F.col("ne") > total * HOT_SHARE).select("kind", "entity", F.lit(True).alias("hot")))
    salted = entities.join(hot, ["kind", "entity"], "left").withColumn("salt", F.explode(
        F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    uses = contexts.select("key", F.explode("context").alias("c")).where("c.kind IS NOT NULL") \
        .select("key", "c.kind", "c.entity").distinct().join(hot, ["kind", "entity"], "left") \
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
                    .otherwise(F.lit(0))).drop("hot")
    own = uses.join(salted, ["kind", "entity", "salt"]).groupBy("key").agg(
        F.collect_list(F.struct(*entities.columns)).alias("own"))
    if "ne" in entities.columns:
        single = F.slice(F.array_sort(F.filter("own", lambda e: e["ne"] == 1)), 1, 1)
        own = own.withColumn("own", F.concat(F.filter("own", lambda e: e["ne"] > 1), single))
    terms = contexts.select("key", F.expr("transform(filter(context, c -> c.term IS NOT NULL), c -> c.term)").alias("terms"))
    return terms.join(own, "key").select("key", "terms", F.explode("own").alias("e")).select(
        "key", "e.*", F.explode("terms").alias("term"))


def disclosing(df: DataFrame, contexts: DataFrame, text: str = "text", generalise_at: float = 0.5,
               remove_at: float = 0.8, discount: float = 0.5) -> DataFrame:
    """(kind, entity, term, action) of the pairs at or over a disclosure
    threshold; of the entities that one document alone holds, its least.
    ``contexts``: one ``context`` array per document that holds an entity,
    and the ``key`` of its text if at hand."""
    total = df.count()
    if "key" not in contexts.columns:
        contexts = contexts.withColumn("key", F.sha2(F.to_json("context"), 256))
    # an entity with n(e) = N carries no information: nothing can disclose it
    entities = _entities(contexts).where(F.col("ne") < total)
    pairs = _pairs(contexts, entities).groupBy("kind", "entity", "ne", "term").agg(F.count("*").alias("net"))
    joint = F.col("net") - F.lit(discount)
    share = F.log(F.lit(float(total)) * joint / (F.col("ne") * F.col("n"))) / F.log(F.lit(float(total)) / F.col("ne"))
    return pairs.join(term_counts(df, text), "term") \
        .withColumn("share", share).where(F.col("share") >= generalise_at) \
        .select("kind", "entity", "term", F.when(F.col("share") >= remove_at, "remove").otherwise("generalise")
                .alias("action"))


def sanitise(df: DataFrame, text: str = "text", generalise_at: float = 0.5, remove_at: float = 0.8,
             discount: float = 0.5) -> DataFrame:
    """``df`` with base, spans (base ones and, as kinds ``generalise``
    and ``remove``, disclosing terms; both arrays by kind as listed, then
    start) and clean, the text with every span replaced."""
    # the input's columns travel in a struct: no name of theirs meets one of these
    columns = [c for c in df.columns if c.lower() not in _OUT]
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row") if columns else F.struct(
        F.lit(0).alias("none")).alias("row"), F.col(f"`{text}`").alias("text"))
    found = scan(inner, "text")
    held = materialise(found.where(F.size("context") > 0).select(F.sha2("text", 256).alias("key"), "context"), "pii")
    telling = materialise(disclosing(inner.select("text"), held, "text", generalise_at, remove_at, discount), "telling")
    extra = _pairs(held.dropDuplicates(["key"]), telling.select("kind", "entity").distinct()) \
        .join(telling, ["kind", "entity", "term"]).groupBy("key").agg(
            F.collect_set(F.struct("term", "action")).alias("told"))
    # texts without an entity stay as they are; only those with one meet the join
    plain = found.where(F.size("context") == 0).select("row", "base", F.col("base").alias("spans"), F.col("text").alias("clean"))
    full = found.where(F.size("context") > 0).select("row", "text", "base", F.sha2("text", 256).alias("key"))
    whole = plain.unionByName(_rewrite(full.join(extra, "key", "left")).select("row", *_OUT))
    return whole.select(*[F.col("row").getField(c).alias(c) for c in columns], *_OUT)


_OUT = ("base", "spans", "clean")


def _rewrite(df: DataFrame) -> DataFrame:
    """``df`` (text, base, told) with spans, base and then every place of
    the terms in told, and clean. A term told of by two entities keeps the
    stronger action; overlapping spans are replaced as one."""
    known = F.struct(F.col("text").alias("t"), F.col("base").alias("b"), F.col("told").alias("told"))
    put = {"remove": "", "generalise": "[TERM]", **{k: f"[{k.upper()}]" for k in KINDS}}
    names = _SPAN.names

    def start():
        def rewritten(p):
            t, spans = p["t"], [(s["kind"], s["start"], s["end"]) for s in p["b"]]
            action = dict(sorted((x["term"], x["action"]) for x in p["told"] or []))  # remove comes last
            if action:
                places = ((action.get(m.group().lower()), *m.span()) for m in _terms(t, spans))
                spans = spans + sorted(x for x in places if x[0])
            out, at = [], 0
            for kind, first, end in sorted(spans, key=lambda s: (s[1], -s[2])):
                if first >= at:
                    out += [t[at:first], put[kind]]
                at = max(at, end)
            return [dict(zip(names, x)) for x in spans], "".join(out) + t[at:]

        return lambda rows: list(zip(*map(rewritten, rows)))

    return add_columns(df.withColumn("known", known), "known", [
        StructField("spans", ArrayType(_SPAN)), StructField("clean", StringType())], start)


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
