"""Shared CTE prefix: cases -> clean -> score -> linear SHAP.

Fixed values below restate the operator definitions (order case table,
scorecard) so the oracle never reads the engine's code.
"""

from __future__ import annotations


def d(x: float) -> str:
    """A DOUBLE literal with the exact binary value of ``x``."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


# Order priority levels, lowest first.
PRIORITY = [("5-LOW", 1.0), ("4-NOT SPECIFIED", 2.0), ("3-MEDIUM", 3.0), ("2-HIGH", 4.0), ("1-URGENT", 5.0)]
NUMERIC = ["total_price", "acct_bal", "line_count", "sum_qty", "avg_discount", "priority_num"]
CATEGORICAL = ["segment", "priority", "status", "nation", "region"]
# Scorecard terms in evaluation order.
SC_INTERCEPT = -5.2
SC_NUMERIC = [("line_count", 0.55, 0.0), ("sum_qty", 0.018, 0.0), ("avg_discount", -6.0, 0.0),
              ("total_price", 0.000002, 0.0), ("priority_num", 0.25, 1.0), ("acct_bal", 0.00002, 0.0)]
SC_CATEGORICAL = [("segment", [("BUILDING", 0.5), ("MACHINERY", -0.4)])]


def priority_case(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {d(v)}" for k, v in PRIORITY)
    return f"(CASE {col} {whens} END)"


def cases_cte() -> str:
    return f"""
per_order AS (
  SELECT l_orderkey, COUNT(*) AS line_count, SUM(l_quantity) AS sum_qty, AVG(l_discount) AS avg_discount,
         SUM(l_extendedprice * ({d(1.0)} - l_discount)) AS revenue
  FROM lineitem GROUP BY l_orderkey),
raw_cases AS (
  SELECT o.o_orderkey AS case_id, o.o_totalprice AS total_price, c.c_acctbal AS acct_bal,
         p.line_count, p.sum_qty, p.avg_discount, {priority_case('o.o_orderpriority')} AS priority_num,
         c.c_mktsegment AS segment, o.o_orderpriority AS priority, o.o_orderstatus AS status,
         n.n_name AS nation, r.r_name AS region,
         CAST(COALESCE(p.revenue, 0.0) > {d(200000.0)} AS INTEGER) AS target
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN per_order p ON o.o_orderkey = p.l_orderkey),
cases AS (
  SELECT case_id,
         {", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in NUMERIC)},
         {", ".join(f"COALESCE(TRIM({c}), 'Unknown') AS {c}" for c in CATEGORICAL)},
         target
  FROM raw_cases)"""


def margin_sql(prefix: str = "") -> str:
    z = d(SC_INTERCEPT)
    for c, w, center in SC_NUMERIC:
        z = f"({z} + {d(w)} * ({prefix}{c} - {d(center)}))"
    for c, values in SC_CATEGORICAL:
        for v, w in values:
            z = f"({z} + {d(w)} * CAST({prefix}{c} = '{v}' AS DOUBLE))"
    return z


def scored_cte() -> str:
    return f"""
scored AS (
  SELECT *, {margin_sql()} AS margin FROM cases),
scored2 AS (
  SELECT *, {d(1.0)} / ({d(1.0)} + EXP(-margin)) AS p1, CAST(margin > 0 AS INTEGER) AS prediction FROM scored)"""


def shap_terms() -> list[tuple[str, str, float]]:
    """(feature name, encoded value SQL, weight)."""
    out = [(c, f"{c}", w) for c, w, _ in SC_NUMERIC]
    for c, values in SC_CATEGORICAL:
        for v, w in values:
            out.append((f"{c}_{v}", f"CAST({c} = '{v}' AS DOUBLE)", w))
    return out


def shap_cte() -> str:
    terms = shap_terms()
    means = ", ".join(f"AVG({expr}) AS m{i}" for i, (_, expr, _) in enumerate(terms))
    unions = "\n  UNION ALL ".join(
        f"SELECT case_id AS instance_id, '{name}' AS feature_name, {expr} AS feature_value, "
        f"{d(w)} * ({expr} - bg.m{i}) AS shap_value FROM cases, bg"
        for i, (name, expr, w) in enumerate(terms))
    return f"""
bg AS (SELECT {means} FROM cases),
shap AS (
  {unions})"""


def with_prefix(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().lstrip(",") for c in ctes)


# ---------------------------------------------------------------- search
# Search roles of the order case table.
ACTIONABLE = ["total_price", "line_count", "sum_qty", "avg_discount", "segment", "priority"]
INTEGRAL = ["line_count", "sum_qty"]
FROZEN = ["nation", "region", "acct_bal", "status"]
PERMITTED = {"sum_qty": (1.0, 300.0)}
FORBIDDEN = {"segment": ["FURNITURE"]}
DIST_NUMERIC = ["total_price", "acct_bal", "line_count", "sum_qty", "avg_discount"]
N_CANDIDATES = 64
MAX_VARIED = 3
TOTAL_CFS = 5
# (run_id, model_name, seed, created_at)
RUNS = [("run-a", "scorecard", 42, "2024-01-01 00:00:00"), ("run-b", "scorecard", 7, "2024-02-01 00:00:00")]


def runs_cte(runs=None) -> str:
    runs = runs or RUNS
    vals = ", ".join(f"('{r}', '{m}', {s}, TIMESTAMP '{t}')" for r, m, s, t in runs)
    return f"\nruns AS (SELECT * FROM (VALUES {vals}) t(run_id, model_name, seed, created_at))"


# Fixed values of the hash draw.
HP, HM, HS, HC1, HC2 = 2147483647, 1000003, 2654435761, 12345, 67890


def hash_base_sql(parts) -> str:
    base = "CAST(0 AS BIGINT)"
    for p in parts:
        base = f"(({base} * {HM} + CAST({p} AS BIGINT) % {HP}) % {HP})"
    return base


def draw_sql(base: str, j: int) -> str:
    x = f"(({base} + {((j + 1) * HS) % HP}) % {HP})"
    x = f"(({x} * {x} + {HC1}) % {HP})"
    x = f"(({x} * {x} + {HC2}) % {HP})"
    return f"({x} / {d(float(HP))})"


def draw(k: int) -> str:
    return draw_sql("hb", k)


def permitted_sql() -> str:
    """Every actionable numeric inside its fixed range or training bounds."""
    parts = []
    for c in ACTIONABLE:
        if c in NUMERIC:
            lo, hi = (d(PERMITTED[c][0]), d(PERMITTED[c][1])) if c in PERMITTED else (f"lo_{c}", f"hi_{c}")
            parts.append(f"({c} >= {lo} AND {c} <= {hi})")
    return " AND ".join(parts)


def search_cte(runs=None, n_candidates: int = N_CANDIDATES, k: int = TOTAL_CFS, strict: bool = False) -> str:
    nd = len(ACTIONABLE)
    ctx_cols = ", ".join(f"MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}" for c in NUMERIC)
    doms = ", ".join(f"list_sort(list(DISTINCT {c})) AS dom_{c}" for c in ACTIONABLE if c in CATEGORICAL)
    origs = ", ".join(f"{c} AS o_{c}" for c in NUMERIC + CATEGORICAL)
    hashes = f"{hash_base_sql(['case_id', 'cand', 'seed'])} AS hb"
    draws = ", ".join(f"{draw(i)} AS u{i}" for i in range(2 * nd))
    ranks = []
    for i in range(nd):
        terms = [f"CAST((u{j} < u{i}) OR (u{j} = u{i} AND {'TRUE' if j < i else 'FALSE'}) AS INTEGER)"
                 for j in range(nd) if j != i]
        ranks.append(f"(({' + '.join(terms)}) < 1 + cand % {MAX_VARIED}) AS var{i}")
    news = []
    for i, c in enumerate(ACTIONABLE):
        v = f"u{nd + i}"
        if c in NUMERIC:
            lo, hi = (f"{d(PERMITTED[c][0])}", f"{d(PERMITTED[c][1])}") if c in PERMITTED else (f"lo_{c}", f"hi_{c}")
            drawn = f"({lo} + {v} * ({hi} - {lo}))"
            if c in INTEGRAL:
                drawn = f"ROUND({drawn})"
            news.append(f"CASE WHEN var{i} THEN {drawn} ELSE o_{c} END AS {c}")
        else:
            news.append(f"CASE WHEN var{i} THEN dom_{c}[CAST(FLOOR({v} * len(dom_{c})) AS BIGINT) + 1] ELSE o_{c} END AS {c}")
    keep = [c for c in NUMERIC + CATEGORICAL if c not in ACTIONABLE and c != "priority_num"]
    frozen = " AND ".join(f"({c} IS NOT DISTINCT FROM o_{c})" for c in FROZEN)
    rng = permitted_sql()
    forb = " AND ".join(f"COALESCE({c} NOT IN ({', '.join(repr(v) for v in vals)}), TRUE)" for c, vals in FORBIDDEN.items())
    dep = f"({priority_case('priority')} IS NULL OR priority_num = {priority_case('priority')})"
    ordn = f"COALESCE({priority_case('priority')} >= {priority_case('o_priority')}, TRUE)"
    terms = [f"ABS({c} - o_{c}) / GREATEST(hi_{c} - lo_{c}, {d(1.0)})" for c in DIST_NUMERIC]
    terms += [f"CAST({c} IS DISTINCT FROM o_{c} AS DOUBLE)" for c in CATEGORICAL]
    dist = terms[0]
    for t in terms[1:]:
        dist = f"({dist} + {t})"
    dist = f"({dist} / {d(float(len(terms)))})"
    return runs_cte(runs) + f""",
sctx AS (SELECT {ctx_cols} FROM cases),
sdom AS (SELECT {doms} FROM cases),
base AS (SELECT case_id, prediction AS original_class, {origs} FROM scored2),
cand0 AS (SELECT b.*, r.run_id, r.model_name, r.seed, r.created_at, unnest(range(0, {n_candidates})) AS cand
          FROM base b CROSS JOIN runs r),
cand1 AS (SELECT *, {hashes} FROM cand0),
cand2 AS (SELECT *, {draws} FROM cand1),
cand3 AS (SELECT *, {', '.join(ranks)} FROM cand2),
cand4 AS (SELECT case_id, run_id, model_name, seed, created_at, cand, original_class,
                 {', '.join('o_' + c for c in NUMERIC + CATEGORICAL)}, lo_total_price, hi_total_price,
                 {', '.join(f'lo_{c}, hi_{c}' for c in NUMERIC if c != 'total_price')},
                 {', '.join(news)}, {', '.join(f'o_{c} AS {c}' for c in keep)}
          FROM cand3 CROSS JOIN sctx CROSS JOIN sdom),
cand4b AS (SELECT *, CAST({margin_sql().replace('priority_num', 'o_priority_num')} > 0 AS INTEGER) AS drawn FROM cand4),
cand5 AS (SELECT *, COALESCE({priority_case('priority')}, o_priority_num) AS priority_num FROM cand4b),
cand6 AS (SELECT *, CAST({margin_sql()} > 0 AS INTEGER) AS prediction FROM cand5),
valid AS (SELECT *, {dist} AS distance FROM cand6
          WHERE drawn = 1 - original_class{" AND prediction = 1 - original_class" if strict else ""} AND {frozen} AND {dep} AND {ordn} AND {forb} AND {rng}),
found AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, case_id ORDER BY distance, cand) AS cf_rank
          FROM valid QUALIFY cf_rank <= {k})"""


# ------------------------------------------------------------- artifacts
ENC_NUMERIC = ["total_price", "line_count", "sum_qty", "avg_discount"]
ENC_CATEGORICAL = ["segment", "priority"]
K = 6
STEPS = 3
# Rule wording.
NO_PATTERN = "No dominant intervention pattern"


def token_sql(f: str, a: str, b: str) -> str:
    t = lambda x: f"replace(trim(COALESCE(CAST({x} AS VARCHAR), 'None')), ' ', '_')"
    return f"('{f}__transition__' || {t(a)} || '__to__' || {t(b)})"


def wide_id_sql(*parts: str) -> str:
    """60-bit id of a composite key."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def artifacts_cte() -> str:
    """cfs: the counterfactual artifact as typed columns (o_* original)."""
    cols = ", ".join(f"o_{c}, {c}" for c in NUMERIC + CATEGORICAL)
    return f""",
cfs AS (
  SELECT {wide_id_sql('model_name', 'run_id', 'case_id', 'cf_rank')} AS id, model_name, run_id,
         case_id AS instance_id, original_class, prediction AS target_class, distance, created_at, {cols}
  FROM found)"""


def encode_cte() -> str:
    rng = ", ".join(f"GREATEST(GREATEST(MAX(o_{c}), MAX({c})) - LEAST(MIN(o_{c}), MIN({c})), {d(1.0)}) AS r_{c}"
                    for c in ENC_NUMERIC)
    deltas = ", ".join(f"({c} - o_{c}) / r_{c} AS {c}__delta" for c in ENC_NUMERIC)
    nflags = ", ".join(
        f"CAST(NOT (ABS(o_{c} - {c}) <= {d(1e-8)} + {d(1e-5)} * ABS({c})) AS DOUBLE) AS {c}__changed"
        for c in ENC_NUMERIC)
    cflags = ", ".join(f"CAST(o_{c} IS DISTINCT FROM {c} AS DOUBLE) AS {c}__changed" for c in ENC_CATEGORICAL)
    toks = ", ".join(f"CASE WHEN o_{c} IS DISTINCT FROM {c} THEN {token_sql(c, 'o_' + c, c)} END"
                     for c in ENC_CATEGORICAL)
    fixed = [f"{c}__delta" for c in ENC_NUMERIC] + [f"{c}__changed" for c in ENC_NUMERIC] + \
            [f"{c}__changed" for c in ENC_CATEGORICAL]
    return f""",
eranges AS (SELECT run_id, {rng} FROM cfs GROUP BY run_id),
enc0 AS (SELECT cfs.*, {deltas}, {nflags}, {cflags},
                list_filter([{toks}], lambda t: t IS NOT NULL) AS tokens
         FROM cfs JOIN eranges USING (run_id)),
vocab AS (SELECT run_id, list_sort(list(DISTINCT t)) AS vocab
          FROM (SELECT run_id, unnest(tokens) AS t FROM enc0) GROUP BY run_id),
enc AS (SELECT enc0.*, list_concat([{', '.join(fixed)}],
               list_transform(COALESCE(v.vocab, []), lambda t: CAST(list_contains(enc0.tokens, t) AS DOUBLE))) AS vector
        FROM enc0 LEFT JOIN vocab v USING (run_id))"""


def sqd(v: str, c: str) -> str:
    return f"list_reduce(list_transform(range(1, len({v}) + 1), lambda i: ({v}[i] - {c}[i]) * ({v}[i] - {c}[i])), lambda x, y: x + y)"


def cluster_cte(k: int = K, steps: int = STEPS) -> str:
    u = draw_sql(hash_base_sql(["id", "42"]), 0)
    parts = [f""",
init AS (SELECT run_id, vector, MIN(struct_pack(u := {u}, id := id)) AS first FROM enc GROUP BY run_id, vector),
c0 AS (SELECT run_id, CAST(ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY first.u, first.id) - 1 AS INTEGER) AS cluster_id,
              vector AS centre FROM init QUALIFY cluster_id < {k})"""]
    for i in range(steps + 1):
        parts.append(f""",
a{i} AS (SELECT e.run_id, e.id, e.vector, c.cluster_id, {sqd('e.vector', 'c.centre')} AS sq_distance
        FROM enc e JOIN c{i} c USING (run_id)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY e.run_id, e.id ORDER BY sq_distance, c.cluster_id) = 1)""")
        if i < steps:
            parts.append(f""",
m{i} AS (SELECT run_id, cluster_id, list(m ORDER BY pos) AS centre FROM (
          SELECT run_id, cluster_id, pos, AVG(v) AS m FROM (
            SELECT run_id, cluster_id, unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM a{i})
          GROUP BY run_id, cluster_id, pos) GROUP BY run_id, cluster_id),
c{i + 1} AS (SELECT c.run_id, c.cluster_id, COALESCE(m.centre, c.centre) AS centre
        FROM c{i} c LEFT JOIN m{i} m USING (run_id, cluster_id))""")
    parts.append(f""",
labelled AS (SELECT enc.*, a.cluster_id, a.sq_distance FROM enc JOIN a{steps} a USING (run_id, id))""")
    return "".join(parts)


def rules_cte() -> str:
    feats = ENC_NUMERIC + ENC_CATEGORICAL
    fl = "\n    UNION ALL ".join(
        f"SELECT model_name, run_id, cluster_id, '{f}' AS feature, {i} AS ord, CAST({f}__changed AS INTEGER) AS flag, "
        f"{f + '__delta' if f in ENC_NUMERIC else 'CAST(NULL AS DOUBLE)'} AS delta FROM labelled"
        for i, f in enumerate(feats))
    readable = ("CASE WHEN len(string_split(token, '__transition__')) >= 2 AND "
                "len(string_split(split_part(token, '__transition__', 2), '__to__')) >= 2 THEN "
                "split_part(token, '__transition__', 1) || ': ' || "
                "replace(split_part(split_part(token, '__transition__', 2), '__to__', 1), '_', ' ') || ' -> ' || "
                "replace(split_part(split_part(token, '__transition__', 2), '__to__', 2), '_', ' ') ELSE token END")
    is_num = "feature IN (" + ", ".join(f"'{c}'" for c in ENC_NUMERIC) + ")"
    return f""",
sizes AS (SELECT model_name, run_id, cluster_id, COUNT(*) AS size, AVG(distance) AS avg_distance,
                 COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY model_name, run_id) AS share
          FROM labelled GROUP BY model_name, run_id, cluster_id),
fprof AS (SELECT model_name, run_id, cluster_id, feature, ord, SUM(flag) / COUNT(*) AS change_rate, AVG(delta) AS avg_delta
          FROM ({fl}) GROUP BY ALL),
tcount AS (SELECT model_name, run_id, cluster_id, token, COUNT(*) AS n
           FROM (SELECT model_name, run_id, cluster_id, unnest(tokens) AS token FROM labelled) GROUP BY ALL),
tprof AS (SELECT t.model_name, t.run_id, t.cluster_id, t.token, t.n / s.size AS rate,
                 ROW_NUMBER() OVER (PARTITION BY t.model_name, t.run_id, t.cluster_id ORDER BY t.n / s.size DESC, t.token) AS rank
          FROM tcount t JOIN sizes s USING (model_name, run_id, cluster_id)
          QUALIFY rank <= 10),
conds AS (
  SELECT model_name, run_id, cluster_id, 0 AS section, -change_rate AS neg, ord,
         CASE WHEN {is_num} AND avg_delta IS NOT NULL AND ABS(avg_delta) >= {d(0.05)}
              THEN feature || ' tends to ' || (CASE WHEN avg_delta > 0 THEN 'increase' ELSE 'decrease' END)
                   || ' (avg normalized delta ' || printf('%+.3f', avg_delta) || ')'
              ELSE feature || ' changes (' || printf('%.0f', change_rate * 100) || '% of cluster)' END AS text
  FROM fprof WHERE change_rate >= {d(0.80)}
  UNION ALL
  SELECT model_name, run_id, cluster_id, 1, 0.0, rank, {readable} || ' (' || printf('%.0f', rate * 100) || '%)'
  FROM tprof WHERE rate >= {d(0.10)}),
clists AS (SELECT model_name, run_id, cluster_id, list(text ORDER BY section, neg, ord) AS conditions
           FROM conds GROUP BY ALL),
rules AS (
  SELECT s.model_name, s.run_id, s.cluster_id, s.size, CAST(s.size AS INTEGER) AS support, s.share, s.avg_distance,
         COALESCE(c.conditions, ['{NO_PATTERN}']) AS conditions
  FROM sizes s LEFT JOIN clists c USING (model_name, run_id, cluster_id)),
rq AS (
  SELECT *, len(conditions) AS condition_count,
         CASE WHEN len(conditions) > 0 THEN {d(1.0)} / len(conditions) ELSE 0.0 END AS compactness,
         GREATEST({d(0.0)}, LEAST({d(1.0)}, {d(1.0)} - COALESCE(avg_distance, CAST('nan' AS DOUBLE)))) AS distance_score
  FROM rules),
rq2 AS (SELECT *, {d(0.4)} * share + {d(0.3)} * compactness + {d(0.3)} * distance_score AS quality_score FROM rq),
rtok AS (SELECT model_name, run_id, cluster_id, list_distinct(list_transform(conditions, lambda c: lower(trim(split_part(c, '(', 1))))) AS toks FROM rq2),
pairs AS (
  SELECT a.model_name, a.run_id, a.cluster_id AS cluster_a, b.cluster_id AS cluster_b,
         CASE WHEN len(list_distinct(list_concat(a.toks, b.toks))) = 0 THEN 0.0
              ELSE len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) END AS similarity
  FROM rtok a JOIN rtok b ON a.model_name = b.model_name AND a.run_id = b.run_id AND a.cluster_id < b.cluster_id)"""


def distil_prefix() -> str:
    return with_prefix(cases_cte(), scored_cte(), search_cte(), artifacts_cte(), encode_cte(),
                       cluster_cte(), rules_cte())
# Closing sentence of a rule.
THEN_TEXT = "THEN model prediction reaches the counterfactual target class"


def metrics_cte() -> str:
    names = ["accuracy", "f1", "roc_auc", "n_cases"]
    unions = " UNION ALL ".join(
        f"SELECT '{m}' AS metric_name, {i} AS ord, {m} AS metric_value FROM mwide" for i, m in enumerate(names))
    return f""",
aucp AS (SELECT p1 AS s, COUNT(*) FILTER (WHERE target = 1) AS pos, COUNT(*) FILTER (WHERE target = 0) AS neg
         FROM scored2 GROUP BY p1),
aucr AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
         FROM aucp),
auc AS (SELECT CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0
                    THEN SUM(pos * (below + neg / 2.0)) / (SUM(pos) * SUM(neg)) END AS roc_auc FROM aucr),
af AS (SELECT AVG(CAST(target = prediction AS DOUBLE)) AS accuracy,
              COUNT(*) FILTER (WHERE target = 1 AND prediction = 1) AS tp,
              COUNT(*) FILTER (WHERE target = 0 AND prediction = 1) AS fp,
              COUNT(*) FILTER (WHERE target = 1 AND prediction = 0) AS fn,
              CAST(COUNT(*) AS DOUBLE) AS n_cases FROM scored2),
mwide AS (SELECT accuracy, CASE WHEN 2 * tp + fp + fn > 0 THEN (2.0 * tp) / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
                 roc_auc, n_cases FROM af CROSS JOIN auc),
mlong AS ({unions}),
metrics AS (SELECT {wide_id_sql('r.model_name', 'r.run_id', 'm.metric_name')} AS id, r.model_name, r.run_id,
                   m.metric_name, CAST(m.metric_value AS DOUBLE) AS metric_value, r.created_at
            FROM mlong m CROSS JOIN runs r)"""


def shap_art_cte() -> str:
    return f""",
shap_art AS (SELECT {wide_id_sql('r.model_name', 'r.run_id', 's.instance_id', 's.feature_name')} AS id,
                    r.model_name, r.run_id, s.instance_id, s.feature_name, s.feature_value, s.shap_value, r.created_at
             FROM shap s CROSS JOIN runs r),
clusters_art AS (SELECT id AS counterfactual_id, model_name, run_id, instance_id, cluster_id, created_at, id FROM labelled),
rules_art AS (SELECT {wide_id_sql('model_name', 'run_id', 'cluster_id')} AS id, model_name, run_id, cluster_id,
                     conditions, support, share AS support_share, avg_distance, quality_score, r.created_at
              FROM rq2 JOIN (SELECT run_id, created_at FROM runs) r USING (run_id))"""


def full_prefix() -> str:
    return with_prefix(cases_cte(), scored_cte(), search_cte(), artifacts_cte(), encode_cte(),
                       cluster_cte(), rules_cte(), shap_cte(), metrics_cte(), shap_art_cte())


# ------------------------------------------------------------ preparation
# Bins of the order case table (source, name, cuts, labels).
BINS = [
    ("total_price", "price_band", [50000.0, 100000.0, 150000.0, 200000.0, 250000.0, 300000.0],
     ["upto_50k", "50k_100k", "100k_150k", "150k_200k", "200k_250k", "250k_300k", "over_300k"]),
    ("sum_qty", "qty_band", [25.0, 50.0, 100.0, 150.0, 200.0], ["tiny", "small", "medium", "large", "bulk", "huge"]),
    ("priority_num", "urgency", [1.0, 2.0, 3.0, 4.0, 5.0],
     ["low", "not_specified", "medium", "high", "urgent", "beyond"]),
]
ENCODED_NUMERIC = NUMERIC + ["price_per_line"]
ENCODED_CATEGORICAL = CATEGORICAL + [b[1] for b in BINS]


def bin_sql(src: str, cuts, labels) -> str:
    whens = " ".join(f"WHEN {src} <= {d(c)} THEN '{lab}'" for c, lab in zip(cuts, labels[:-1]))
    return f"(CASE {whens} ELSE '{labels[-1]}' END)"


def ratio_sql() -> str:
    num = "(total_price - acct_bal)"
    den = f"(line_count + {d(1.0)})"
    raw = f"(CASE WHEN {den} = 0 THEN (CASE WHEN {num} > 0 THEN CAST('inf' AS DOUBLE) WHEN {num} < 0 THEN CAST('-inf' AS DOUBLE) END) ELSE {num} / {den} END)"
    return f"COALESCE(CASE WHEN isnan({raw}) THEN NULL ELSE {raw} END, 0.0)"


def derived_cte() -> str:
    bins = ", ".join(f"{bin_sql(s, c, l)} AS {n}" for s, n, c, l in BINS)
    return f"""
derived AS (SELECT *, {bins}, {ratio_sql()} AS price_per_line FROM cases)"""


def split_cte(src: str, name: str, salt: int, size: float = 0.2) -> str:
    u = draw_sql(hash_base_sql(["case_id", "42", str(salt)]), 0)
    return f"""
{name}_u AS (SELECT *, {u} AS u FROM {src}),
{name}_q AS (SELECT target, COUNT(*) AS n, COUNT(*) * {d(size)} AS q, FLOOR(COUNT(*) * {d(size)}) AS f
             FROM {name}_u GROUP BY target),
{name}_t AS (SELECT target, f + CASE WHEN ROW_NUMBER() OVER (ORDER BY q - f DESC, CAST(target AS VARCHAR))
                                       <= (SELECT CEIL(SUM(n) * {d(size)}) - SUM(f) FROM {name}_q) THEN 1 ELSE 0 END AS t
             FROM {name}_q),
{name} AS (SELECT {name}_u.* EXCLUDE (u),
                  ROW_NUMBER() OVER (PARTITION BY target ORDER BY u, case_id) <= t AS is_test
           FROM {name}_u JOIN {name}_t USING (target))"""
