"""Column-level building blocks (all JVM-side expressions, no UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

# Text that Python's float() accepts and that DuckDB casts the same way.
# Spark's try_cast alone is looser (it accepts suffixes such as "1d").
NUMERIC_TEXT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[Nn][Aa][Nn]|[Ii][Nn][Ff]([Ii][Nn][Ii][Tt][Yy])?)$"

# Marker strings of the change encoding (fixed values).
TRANSITION_SEP = "__transition__"
TO_SEP = "__to__"
MISSING_TEXT = "None"
UNKNOWN = "Unknown"


# Fixed value: the white space that Python's str.strip removes.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006" \
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.trim(col(c), F.lit(WHITE_SPACE))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_double(c, dtype=None) -> Column:
    """Lenient numeric cleaning: text -> trimmed -> double; null or
    unparseable -> 0.0. NaN text stays NaN (only nulls are replaced)."""
    c = col(c)
    if dtype is not None and isinstance(dtype, NumericType):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    return lenient_stripped(strip(c.cast("string")))


def lenient_stripped(text: Column) -> Column:
    """:func:`lenient_double` of text without white space around it."""
    parsed = F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))
    return F.coalesce(parsed, F.lit(0.0))


def clean_category(c, dtype=None) -> Column:
    """Categorical cleaning: text, trimmed, null -> 'Unknown'."""
    c = col(c)
    if dtype is not None and isinstance(dtype, StringType):
        return F.coalesce(strip(c), F.lit(UNKNOWN))
    return F.coalesce(strip(c.cast("string")), F.lit(UNKNOWN))


def right_closed_bin(c, cuts, labels) -> Column:
    """x <= c0 -> l0; (c[i-1], c[i]] -> l[i]; else (including NaN) last."""
    c = col(c)
    expr = F.when(c <= F.lit(float(cuts[0])), F.lit(labels[0]))
    for cut, label in zip(cuts[1:], labels[1:-1]):
        expr = expr.when(c <= F.lit(float(cut)), F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def net_ratio(plus, minus, base) -> Column:
    """(plus - minus) / (base + 1); x/0 keeps +-inf, NaN and null -> 0."""
    num = col(plus) - col(minus)
    den = col(base) + F.lit(1.0)
    raw = (F.when(den == 0, F.when(num > 0, F.lit(float("inf")))
                  .when(num < 0, F.lit(float("-inf"))))
           .otherwise(num / den))
    return F.coalesce(F.nanvl(raw, F.lit(None).cast("double")), F.lit(0.0))


def isclose(a, b) -> Column:
    """numpy.isclose(a, b): |a - b| <= 1e-8 + 1e-5 * |b| (asymmetric)."""
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


# Fixed values of the hash draw (shared with the SQL oracle).
HASH_PRIME = 2147483647
HASH_MULT = 1000003
HASH_STEP = 2654435761
HASH_C1 = 12345
HASH_C2 = 67890


def wide_id(*parts) -> Column:
    """60-bit id of a composite key (md5 of its parts): no numbering, no
    bound on any part; other engines reproduce it."""
    text = F.concat_ws("|", *[col(p).cast("string") if not isinstance(p, Column) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_base(parts: list) -> Column:
    """Fold non-negative integer parts into [0, p): base = base * M + part (mod p)."""
    base = F.lit(0).cast("bigint")
    for p in parts:
        v = (F.lit(p) if isinstance(p, int) else col(p)).cast("bigint")
        base = (base * F.lit(HASH_MULT) + v % F.lit(HASH_PRIME)) % F.lit(HASH_PRIME)
    return base


def uniform_draws(parts: list, n: int) -> list[Column]:
    """``n`` deterministic uniforms in [0, 1) per row from integer parts.

    Draw j offsets the folded key by (j + 1) * STEP and applies two rounds
    of x -> x^2 + c (mod 2^31 - 1). Pure bigint arithmetic: it stays in
    generated code, never depends on partitioning, and any SQL engine with
    64-bit integers reproduces it bit for bit.
    """
    base = hash_base(parts)
    P = F.lit(HASH_PRIME)
    draws = []
    for j in range(n):
        x = (base + F.lit(((j + 1) * HASH_STEP) % HASH_PRIME)) % P
        x = (x * x + F.lit(HASH_C1)) % P
        x = (x * x + F.lit(HASH_C2)) % P
        draws.append(x / F.lit(float(HASH_PRIME)))
    return draws


def uniform_draw(parts: list) -> Column:
    return uniform_draws(parts, 1)[0]


def with_uniform_draws(df, parts: list, names: list[str]):
    """Adds the draws of :func:`uniform_draws` as columns ``names``, with
    each hash round materialised as its own projection so ``x * x`` never
    duplicates the expression tree below it."""
    P = F.lit(HASH_PRIME)
    df = df.withColumn("__hb", hash_base(parts))
    df = df.withColumns({f"__h{j}": (F.col("__hb") + F.lit(((j + 1) * HASH_STEP) % HASH_PRIME)) % P
                         for j in range(len(names))})
    for c in (HASH_C1, HASH_C2):
        df = df.withColumns({f"__h{j}": (F.col(f"__h{j}") * F.col(f"__h{j}") + F.lit(c)) % P
                             for j in range(len(names))})
    df = df.withColumns({n: F.col(f"__h{j}") / F.lit(float(HASH_PRIME)) for j, n in enumerate(names)})
    return df.drop("__hb", *[f"__h{j}" for j in range(len(names))])


def token_text(c) -> Column:
    """Value as it appears inside a transition token."""
    return F.replace(strip(F.coalesce(col(c).cast("string"), F.lit(MISSING_TEXT))), F.lit(" "), F.lit("_"))


def transition_token(feature: str, original, counterfactual) -> Column:
    return F.concat(F.lit(feature + TRANSITION_SEP), token_text(original),
                    F.lit(TO_SEP), token_text(counterfactual))


def readable_transition(token) -> Column:
    """'f__transition__A__to__B' -> 'f: A -> B' ('_' -> ' ');
    text without both markers passes through."""
    t = col(token)
    parts = F.split(t, TRANSITION_SEP, 2)
    feature = F.element_at(parts, 1)
    rest = F.element_at(parts, 2)
    ends = F.split(rest, TO_SEP, 2)
    src = F.element_at(ends, 1)
    dst = F.element_at(ends, 2)
    ok = (F.size(parts) == 2) & (F.size(ends) == 2)
    text = F.concat(feature, F.lit(": "), F.replace(src, F.lit("_"), F.lit(" ")),
                    F.lit(" -> "), F.replace(dst, F.lit("_"), F.lit(" ")))
    return F.when(ok, text).otherwise(t)


def percent0(rate) -> Column:
    """Python's '{:.0%}': half-to-even on the binary value of rate*100."""
    return F.concat(F.bround(col(rate) * F.lit(100.0), 0).cast("bigint").cast("string"), F.lit("%"))


def signed3(x) -> Column:
    """Python's '{:+.3f}': the decimal nearest to the exact binary value.

    ``p`` is x * 1000 as a double and ``e`` its exact rounding error (by
    splitting x in two halves of 26 bits); only where p ends in .5 does
    the error decide, and an exact tie goes to the even neighbour."""
    x = col(x)
    p = x * F.lit(1000.0)
    high = x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
    e = (high * F.lit(1000.0) - p) + (x - high) * F.lit(1000.0)
    tie = (p - F.floor(p)) == F.lit(0.5)
    n = F.when(tie & (e > 0), F.ceil(p)).when(tie & (e < 0), F.floor(p)).otherwise(F.rint(p).cast("bigint"))
    size = F.abs(n)
    text = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("+")), F.floor(size / 1000).cast("string"), F.lit("."),
                    F.lpad((size % 1000).cast("string"), 3, "0"))
    return F.when(F.isnan(x), F.lit("+nan")).otherwise(text)


def condition_key(c) -> Column:
    """Condition text before the first '(' trimmed and lower-cased."""
    return F.lower(strip(F.substring_index(col(c), "(", 1)))


def clamp01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def sum_columns(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)
