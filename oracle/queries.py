"""Oracle SQL per registered query name."""

from __future__ import annotations

from oracle.prefix import cases_cte, scored_cte, search_cte, shap_cte, with_prefix


def r6(x: str) -> str:
    return f"(ROUND({x}, 6) + 0.0)"


def q_global_importance() -> str:
    return with_prefix(cases_cte(), shap_cte()) + f"""
SELECT feature_name, {r6('AVG(ABS(shap_value))')} AS mean_abs_shap
FROM shap GROUP BY feature_name ORDER BY AVG(ABS(shap_value)) DESC, feature_name LIMIT 10"""


def q_linear_shap() -> str:
    return with_prefix(cases_cte(), shap_cte()) + f"""
SELECT instance_id, feature_name, {r6('feature_value')} AS feature_value, {r6('shap_value')} AS shap_value FROM shap"""


def q_scorecard() -> str:
    return with_prefix(cases_cte(), scored_cte()) + f"""
SELECT case_id, {r6('margin')} AS margin, {r6('p1')} AS p1, prediction, target FROM scored2"""


ORACLE = {
    "h2_linear_shap": q_linear_shap,
    "q04_global_importance": q_global_importance,
    "m05_scorecard": q_scorecard,
}


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLE.items()}


def q_search(strict: bool = False) -> str:
    return with_prefix(cases_cte(), scored_cte(), search_cte(strict=strict)) + f"""
SELECT run_id, case_id, cf_rank, cand, original_class, prediction AS target_class,
       prediction = 1 - original_class AS flipped, {r6('distance')} AS distance,
       {r6('total_price')} AS total_price, {r6('line_count')} AS line_count, {r6('sum_qty')} AS sum_qty,
       {r6('avg_discount')} AS avg_discount, segment, priority, {r6('priority_num')} AS priority_num
FROM found"""


ORACLE["x08_counterfactual_search"] = q_search
ORACLE["x05_strict_search"] = lambda: q_search(strict=True)


# ------------------------------------------------------------- artifacts
from oracle.prefix import (CATEGORICAL, ENC_CATEGORICAL, ENC_NUMERIC, NUMERIC, RUNS,  # noqa: E402
                           THEN_TEXT, distil_prefix, runs_cte)


def _sig_list() -> str:
    feats = sorted(NUMERIC + CATEGORICAL)
    items = ", ".join(f"CASE WHEN o_{c} IS DISTINCT FROM {c} THEN '{c}' END" for c in feats)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def q_x09() -> str:
    return distil_prefix() + f"""
SELECT id, model_name, run_id, instance_id, original_class, target_class, {r6('distance')} AS distance, created_at,
       array_to_string({_sig_list()}, ',') AS signature, len({_sig_list()}) AS n_changed
FROM cfs"""


def q_x10() -> str:
    return distil_prefix() + """
SELECT c.case_id, r.run_id FROM cases c CROSS JOIN runs r
WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.case_id = c.case_id AND f.run_id = r.run_id)"""


def q_e03() -> str:
    unions = " UNION ALL ".join(f"SELECT run_id, '{c}' AS feature, {r6('r_' + c)} AS feature_range FROM eranges"
                                for c in ENC_NUMERIC)
    return distil_prefix() + f"\nSELECT * FROM ({unions})"


def q_e08() -> str:
    return distil_prefix() + """
SELECT run_id, CAST(generate_subscripts(vocab, 1) - 1 AS INTEGER) AS position, unnest(vocab) AS token FROM vocab"""


def q_e09() -> str:
    flags = ENC_NUMERIC + ENC_CATEGORICAL
    nchg = "0.0"
    for f in flags:
        nchg = f"({nchg} + {f}__changed)"
    deltas = ", ".join(f"{r6(c + '__delta')} AS {c}__delta" for c in ENC_NUMERIC)
    return distil_prefix() + f"""
SELECT id, run_id, {deltas}, {r6(nchg)} AS n_changed, array_to_string(tokens, ';') AS tokens,
       CAST(len(vector) AS INTEGER) AS width, {r6('list_reduce(vector, lambda x, y: x + y)')} AS vector_sum
FROM enc"""


def q_e11() -> str:
    return distil_prefix() + f"""
SELECT id, run_id, CAST(len(vector) AS INTEGER) AS width, {r6('list_sum(vector)')} AS vector_sum FROM enc"""


def q_c2() -> str:
    return distil_prefix() + f"""
SELECT run_id, cluster_id, COUNT(*) AS size, {r6('SUM(sq_distance)')} AS inertia,
       {r6('COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY run_id)')} AS share
FROM labelled GROUP BY run_id, cluster_id"""


def q_c4() -> str:
    return distil_prefix() + sil_cte() + f"""
SELECT run_id, {r6("AVG(CASE WHEN isnan(s) OR s IS NULL THEN 0.0 ELSE s END)")} AS silhouette_sq_euclidean FROM sil GROUP BY run_id"""


def sil_cte() -> str:
    sq = "list_reduce(list_transform(vector, lambda v: v * v), lambda x, y: x + y)"
    dot = "list_reduce(list_transform(range(1, len(l.vector) + 1), lambda i: l.vector[i] * m.mu[i]), lambda x, y: x + y)"
    return f""",
cst AS (SELECT run_id, cluster_id, COUNT(*) AS n, AVG({sq}) AS q FROM labelled GROUP BY ALL),
cmu AS (SELECT run_id, cluster_id, list(m ORDER BY pos) AS mu FROM (
          SELECT run_id, cluster_id, pos, AVG(v) AS m FROM (
            SELECT run_id, cluster_id, unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM labelled)
          GROUP BY ALL) GROUP BY ALL),
pd AS (SELECT l.run_id, l.id, l.cluster_id AS own, m.cluster_id AS other,
              ({sq.replace('vector', 'l.vector')} - 2.0 * {dot} + s.q) AS msd, s.n
       FROM labelled l JOIN cmu m ON l.run_id = m.run_id JOIN cst s ON s.run_id = m.run_id AND s.cluster_id = m.cluster_id),
ab AS (SELECT run_id, id,
              MAX(CASE WHEN own = other THEN n END) AS own_n,
              MAX(CASE WHEN own = other THEN msd END) AS own_msd,
              MIN(CASE WHEN own <> other THEN msd END) AS b
       FROM pd GROUP BY run_id, id),
sil AS (SELECT run_id, CASE WHEN own_n <= 1 THEN 0.0
                            ELSE (b - own_msd * own_n / (own_n - 1)) / GREATEST(own_msd * own_n / (own_n - 1), b) END AS s
        FROM ab)"""


def q_r01() -> str:
    return distil_prefix() + f"""
SELECT run_id, cluster_id, size, {r6('share')} AS share, {r6('avg_distance')} AS avg_distance FROM sizes"""


def q_r03() -> str:
    return distil_prefix() + f"""
SELECT run_id, cluster_id, feature, {r6('change_rate')} AS change_rate, {r6('avg_delta')} AS avg_delta FROM fprof"""


def q_r04() -> str:
    return distil_prefix() + f"""
SELECT run_id, cluster_id, token, {r6('rate')} AS rate, CAST(rank AS INTEGER) AS rank FROM tprof"""


def q_r08() -> str:
    return distil_prefix() + f"""
SELECT run_id, cluster_id, array_to_string(conditions, ' | ') AS conditions, support, {r6('share')} AS share,
       {r6('avg_distance')} AS avg_distance, CAST(condition_count AS INTEGER) AS condition_count,
       {r6('compactness')} AS compactness, {r6('distance_score')} AS distance_score,
       {r6('quality_score')} AS quality_score
FROM rq2"""


def q_r14() -> str:
    return distil_prefix() + f"\nSELECT run_id, cluster_a, cluster_b, {r6('similarity')} AS similarity FROM pairs"


def q_r16() -> str:
    return distil_prefix() + f"""
SELECT run_id, cluster_id,
       array_to_string(list_transform(conditions, lambda c, i: CASE WHEN i = 1 THEN 'IF ' ELSE 'AND ' END || c), ' ')
       || ' {THEN_TEXT}' AS sentence
FROM rq2"""


ORACLE.update({
    "x09_counterfactual_records": q_x09, "x10_uncovered_cases": q_x10, "e03_corpus_ranges": q_e03,
    "e08_transition_vocabulary": q_e08, "e09_change_vectors": q_e09, "e11_clustering_matrix": q_e11, "c2_cluster_assignment": q_c2,
    "c4_silhouette": q_c4, "r01_cluster_sizes": q_r01, "r03_feature_profile": q_r03,
    "r04_transition_profile": q_r04, "r08_rules": q_r08, "r14_rule_similarity": q_r14,
    "r16_rule_sentences": q_r16,
})


# ------------------------------------------------------------- explorer
from oracle.prefix import full_prefix  # noqa: E402


def num_text(x: str) -> str:
    return f"CAST(CAST(ROUND({x}, 6) AS DECIMAL(38,6)) AS VARCHAR)"


def _changes() -> str:
    """One row per (counterfactual, changed feature) with value text."""
    parts = []
    for c in NUMERIC + CATEGORICAL:
        ov = num_text(f"o_{c}") if c in NUMERIC else f"COALESCE(o_{c}, 'None')"
        nv = num_text(c) if c in NUMERIC else f"COALESCE({c}, 'None')"
        parts.append(f"SELECT id, run_id, instance_id, distance, '{c}' AS feature, {ov} AS original_value, "
                     f"{nv} AS counterfactual_value FROM cfs WHERE o_{c} IS DISTINCT FROM {c}")
    return "changes AS (" + " UNION ALL ".join(parts) + ")"


def fp(tail: str) -> str:
    return full_prefix() + tail


def q_q01():
    return fp("""
SELECT run_id, model_name, COUNT(*) AS n_counterfactuals, MAX(created_at) AS last_created_at
FROM cfs WHERE run_id IS NOT NULL GROUP BY run_id, model_name""")


def q_q02():
    return fp(f"""
SELECT c.id, c.run_id, c.instance_id, c.original_class, c.target_class, {r6('c.distance')} AS distance, k.cluster_id
FROM cfs c LEFT JOIN clusters_art k ON c.id = k.counterfactual_id AND c.run_id = k.run_id
WHERE c.run_id = 'run-a'""")


def q_q03():
    return fp(f"""
SELECT id, run_id, cluster_id, array_to_string(conditions, ' | ') AS conditions, support,
       {r6('support_share')} AS support_share, {r6('avg_distance')} AS avg_distance, {r6('quality_score')} AS quality_score
FROM rules_art WHERE run_id = 'run-a'""")


def q_q05():
    return fp(f"""
SELECT instance_id, feature_name, {r6('feature_value')} AS feature_value, {r6('shap_value')} AS shap_value
FROM shap_art WHERE run_id = 'run-a'
  AND instance_id = (SELECT MIN(instance_id) FROM shap_art WHERE run_id = 'run-a')
ORDER BY ABS(shap_art.shap_value) DESC, feature_name LIMIT 5""")


def q_q06():
    return fp("""
SELECT (SELECT COUNT(*) FROM cfs WHERE run_id = 'run-a') AS n_counterfactuals,
       (SELECT COUNT(DISTINCT instance_id) FROM cfs WHERE run_id = 'run-a') AS n_instances,
       (SELECT COUNT(DISTINCT cluster_id) FROM clusters_art WHERE run_id = 'run-a') AS n_clusters,
       (SELECT COUNT(*) FROM rules_art WHERE run_id = 'run-a') AS n_rules,
       (SELECT COUNT(DISTINCT instance_id) FROM shap_art WHERE run_id = 'run-a') AS n_shap_instances""")


def q_q07():
    return fp(", " + _changes() + """
SELECT id, run_id, feature, original_value, counterfactual_value FROM changes""")


def q_q09():
    return fp("\nSELECT DISTINCT instance_id FROM shap_art WHERE run_id = 'run-a'")


def q_q11():
    return fp(f"""
SELECT id, run_id, instance_id, {r6('distance')} AS distance, created_at FROM cfs
ORDER BY created_at DESC, id DESC LIMIT 100""")


def q_q12():
    return fp(f"""
SELECT metric_name, {r6('arg_max(metric_value, (created_at, id))')} AS metric_value FROM metrics GROUP BY metric_name""")


def q_q13():
    return fp(f"""
SELECT id, run_id, metric_name, {r6('metric_value')} AS metric_value, created_at FROM metrics
WHERE metric_name = 'accuracy' ORDER BY created_at DESC, id DESC LIMIT 10""")


def q_q15():
    return fp(f"""
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT c.instance_id) AS n_instances,
       {r6('COALESCE(AVG(c.distance), 0.0)')} AS mean_distance
FROM cfs c LEFT JOIN clusters_art k ON c.id = k.counterfactual_id AND c.run_id = k.run_id
WHERE c.run_id = 'run-a' AND c.distance <= {r6('0.05')} AND k.cluster_id IN (0, 1)""")


def q_q16():
    return fp(f"""
SELECT id, run_id, instance_id, {r6('distance')} AS distance, target_class FROM cfs
WHERE instance_id = (SELECT MIN(instance_id) FROM cfs)""")


def q_q17():
    return fp(f"""
SELECT run_id, COUNT(*) AS n_rules, CAST(SUM(support) AS BIGINT) AS total_support,
       {r6('AVG(quality_score)')} AS mean_quality, {r6('AVG(avg_distance)')} AS mean_distance
FROM rules_art WHERE quality_score >= 0.5 GROUP BY run_id""")


def q_q18():
    return fp(f"""
SELECT run_id, cluster_id, {r6('quality_score')} AS quality_score,
       CAST(ROW_NUMBER() OVER (PARTITION BY model_name, run_id ORDER BY quality_score DESC, cluster_id) AS INTEGER) AS rank
FROM rules_art QUALIFY rank <= 3""")


def q_q19():
    return fp(f"""
SELECT feature_name, {r6('m')} AS mean_abs_shap, CAST(ROW_NUMBER() OVER (ORDER BY m DESC, feature_name) AS INTEGER) AS rank
FROM (SELECT feature_name, AVG(ABS(shap_value)) AS m FROM shap_art WHERE run_id = 'run-a'
      GROUP BY feature_name ORDER BY m DESC, feature_name LIMIT 10)""")


def q_q20():
    return fp(f"""
SELECT instance_id,
       COALESCE((MAX(struct_pack(v := shap_value, f := feature_name)) FILTER (WHERE shap_value > 0)).f, 'N/A') AS top_positive_feature,
       {r6("COALESCE(MAX(shap_value) FILTER (WHERE shap_value > 0), 0.0)")} AS top_positive_value,
       COALESCE((MAX(struct_pack(v := ABS(shap_value), f := feature_name)) FILTER (WHERE shap_value < 0)).f, 'N/A') AS top_negative_feature,
       {r6("COALESCE(MIN(shap_value) FILTER (WHERE shap_value < 0), 0.0)")} AS top_negative_value,
       {r6('SUM(ABS(shap_value))')} AS total_abs_shap,
       COUNT(*) FILTER (WHERE shap_value >= 0) AS n_non_negative
FROM shap_art WHERE run_id = 'run-a' GROUP BY instance_id""")


def q_q21():
    return fp(", " + _changes() + f""",
per AS (SELECT id, array_to_string(list_sort(list(feature || ': ' || original_value || ' -> ' || counterfactual_value)), '; ') AS changes
        FROM changes WHERE run_id = 'run-a' GROUP BY id)
SELECT c.id, c.instance_id, {r6('c.distance')} AS distance, COALESCE(p.changes, '') AS changes
FROM cfs c LEFT JOIN per p USING (id) WHERE c.run_id = 'run-a'""")


# ---------------------------------------------------------------- report
def q_v01():
    return fp("""
SELECT run_id, model_name, MAX(created_at) AS last_created_at FROM cfs c
WHERE EXISTS (SELECT 1 FROM rules_art r WHERE r.run_id = c.run_id AND r.model_name = c.model_name)
GROUP BY run_id, model_name ORDER BY last_created_at DESC, run_id DESC, model_name DESC LIMIT 1""")


def q_v02():
    return fp("""
SELECT c.id, c.run_id, c.model_name, k.cluster_id FROM cfs c
LEFT JOIN clusters_art k ON c.id = k.counterfactual_id AND c.run_id = k.run_id AND c.model_name = k.model_name""")


def v04_cte():
    return f""",
v04 AS (SELECT model_name, run_id, COUNT(*) AS n_counterfactuals, COUNT(DISTINCT instance_id) AS n_instances,
               AVG(distance) AS mean_distance, MIN(distance) AS min_distance, MAX(distance) AS max_distance,
               AVG(len({_sig_list()})) AS mean_changed_features,
               COUNT(DISTINCT array_to_string({_sig_list()}, ',')) AS n_signatures
        FROM cfs GROUP BY model_name, run_id),
v05 AS (SELECT model_name, run_id, COUNT(*) AS n_clusters, MAX(size) / SUM(size) AS largest_share,
               array_to_string(list(CAST(cluster_id AS VARCHAR) || ':' || CAST(size AS VARCHAR) ORDER BY cluster_id), ',') AS sizes
        FROM (SELECT model_name, run_id, cluster_id, COUNT(*) AS size FROM clusters_art WHERE cluster_id IS NOT NULL GROUP BY ALL)
        GROUP BY model_name, run_id),
v06 AS (SELECT model_name, run_id, COUNT(*) AS n_shap_rows, COUNT(DISTINCT instance_id) AS n_shap_instances,
               COUNT(DISTINCT feature_name) AS n_shap_features, ANY_VALUE(t.top_features) AS top_features
        FROM shap_art JOIN (SELECT model_name, run_id, array_to_string(list(feature_name ORDER BY m DESC, feature_name)[1:10], ',') AS top_features
              FROM (SELECT model_name, run_id, feature_name, AVG(ABS(shap_value)) AS m FROM shap_art GROUP BY ALL) GROUP BY ALL) t
        USING (model_name, run_id) GROUP BY model_name, run_id),
v07 AS (SELECT r.model_name, r.run_id, COUNT(*) AS n_rules, AVG(quality_score) AS mean_quality,
               MAX(quality_score) AS best_quality, AVG(len(conditions)) AS mean_conditions,
               COALESCE(ANY_VALUE(p.mj), 0.0) AS mean_jaccard, COALESCE(ANY_VALUE(p.xj), 0.0) AS max_jaccard
        FROM rules_art r LEFT JOIN (SELECT model_name, run_id, AVG(similarity) AS mj, MAX(similarity) AS xj
                                    FROM pairs GROUP BY ALL) p USING (model_name, run_id)
        GROUP BY r.model_name, r.run_id),
v08 AS (SELECT COALESCE(a.model_name, b.model_name) AS model_name, COALESCE(a.run_id, b.run_id) AS run_id,
               COALESCE(a.attempted, 0) AS attempted, COALESCE(b.covered, 0) AS covered,
               CASE WHEN COALESCE(a.attempted, 0) = 0 THEN NULL ELSE COALESCE(b.covered, 0) / a.attempted END AS coverage,
               CASE WHEN COALESCE(b.covered, 0) = 0 THEN NULL ELSE b.n / b.covered END AS cfs_per_covered
        FROM (SELECT model_name, run_id, COUNT(DISTINCT instance_id) AS attempted FROM shap_art GROUP BY ALL) a
        FULL JOIN (SELECT model_name, run_id, COUNT(DISTINCT instance_id) AS covered, COUNT(*) AS n FROM cfs GROUP BY ALL) b
        USING (model_name, run_id)),
v09 AS (SELECT model_name, run_id,
               COALESCE(arg_max(metric_value, (created_at, id)) FILTER (WHERE metric_name = 'test_accuracy'),
                        arg_max(metric_value, (created_at, id)) FILTER (WHERE metric_name = 'accuracy')) AS accuracy,
               COALESCE(arg_max(metric_value, (created_at, id)) FILTER (WHERE metric_name = 'test_f1'),
                        arg_max(metric_value, (created_at, id)) FILTER (WHERE metric_name = 'weighted avg_f1-score'),
                        arg_max(metric_value, (created_at, id)) FILTER (WHERE metric_name = 'f1')) AS f1,
               COALESCE(arg_max(metric_value, (created_at, id)) FILTER (WHERE metric_name = 'test_roc_auc'),
                        arg_max(metric_value, (created_at, id)) FILTER (WHERE metric_name = 'roc_auc')) AS roc_auc
        FROM metrics GROUP BY model_name, run_id)"""


def q_v04():
    return fp(v04_cte() + f"""
SELECT model_name, run_id, n_counterfactuals, n_instances, {r6('mean_distance')} AS mean_distance,
       {r6('min_distance')} AS min_distance, {r6('max_distance')} AS max_distance,
       {r6('mean_changed_features')} AS mean_changed_features, n_signatures,
       {r6('n_signatures / n_counterfactuals')} AS diversity FROM v04""")


def q_v05():
    return fp(sil_cte() + v04_cte() + f"""
SELECT model_name, run_id, n_clusters, {r6('largest_share')} AS largest_share, sizes,
       {r6('silhouette_sq_euclidean')} AS silhouette_sq_euclidean FROM v05 JOIN {SILHOUETTE} USING (run_id)""")


SILHOUETTE = ("(SELECT run_id, AVG(CASE WHEN isnan(s) OR s IS NULL THEN 0.0 ELSE s END) AS silhouette_sq_euclidean "
              "FROM sil GROUP BY run_id)")


def facts_cte() -> str:
    from oracle.prefix import shap_terms
    return ("," + split_cte("cases", "sp", 1) + f""",
facts AS (SELECT COUNT(*) FILTER (WHERE NOT is_test) AS train_rows, COUNT(*) FILTER (WHERE is_test) AS test_rows,
                 CAST({len(shap_terms())} AS INTEGER) AS feature_count, 'explain' AS stage FROM sp)""")


def q_v06():
    return fp(v04_cte() + "\nSELECT * FROM v06")


def q_v07():
    return fp(v04_cte() + f"""
SELECT model_name, run_id, n_rules, {r6('mean_quality')} AS mean_quality, {r6('best_quality')} AS best_quality,
       {r6('mean_conditions')} AS mean_conditions, {r6('mean_jaccard')} AS mean_jaccard, {r6('max_jaccard')} AS max_jaccard
FROM v07""")


def q_v08():
    return fp(v04_cte() + f"""
SELECT model_name, run_id, attempted, covered, {r6('coverage')} AS coverage, {r6('cfs_per_covered')} AS cfs_per_covered
FROM v08""")


def q_v09():
    return fp(v04_cte() + facts_cte() + f"""
SELECT model_name, run_id, {r6('accuracy')} AS accuracy, {r6('f1')} AS f1, {r6('roc_auc')} AS roc_auc,
       feature_count, stage, train_rows, test_rows FROM v09 CROSS JOIN facts""")


def q_v10():
    sections = {
        "corpus": ["n_counterfactuals", "n_instances", "mean_distance", "min_distance", "max_distance",
                   "mean_changed_features", "n_signatures", "diversity"],
        "run": ["+explanation_run_id", "+model"],
        "clusters": ["n_clusters", "largest_share", "+sizes", "silhouette_sq_euclidean"],
        "shap": ["n_shap_rows", "n_shap_instances", "n_shap_features", "+top_features"],
        "rules": ["n_rules", "mean_quality", "best_quality", "mean_conditions", "mean_jaccard", "max_jaccard"],
        "coverage": ["attempted", "covered", "coverage", "cfs_per_covered"],
        "model": ["accuracy", "f1", "roc_auc", "feature_count", "+stage", "train_rows", "test_rows"],
    }
    src = {"corpus": "(SELECT *, n_signatures / n_counterfactuals AS diversity FROM v04)", "clusters": f"(SELECT * FROM v05 JOIN {SILHOUETTE} USING (run_id))",
           "shap": "v06", "rules": "v07", "coverage": "v08", "model": "(SELECT * FROM v09 CROSS JOIN facts)",
           "run": "(SELECT DISTINCT model_name, run_id, run_id AS explanation_run_id, model_name AS model FROM rules_art)"}
    parts = []
    for sec, ms in sections.items():
        for m in ms:
            value, text = (r6(f'CAST({m} AS DOUBLE)'), "CAST(NULL AS VARCHAR)") if m[0] != "+" else (
                "CAST(NULL AS DOUBLE)", m[1:])
            parts.append(f"SELECT model_name, run_id, '{sec}' AS section, '{m.lstrip('+')}' AS metric, "
                         f"{value} AS value, {text} AS text FROM {src[sec]}")
    return fp(sil_cte() + v04_cte() + facts_cte() + "\n" + " UNION ALL ".join(parts))


ORACLE.update({
    "q01_runs": q_q01, "q02_counterfactuals_with_clusters": q_q02, "q03_rules_of_run": q_q03,
    "q05_local_attribution": q_q05, "q06_run_summary": q_q06, "q07_changed_features": q_q07,
    "q09_explained_instances": q_q09, "q11_newest_counterfactuals": q_q11, "q12_latest_metrics": q_q12,
    "q13_metric_history": q_q13, "q15_explorer_summary": q_q15, "q16_instance_counterfactuals": q_q16,
    "q17_rule_summary": q_q17, "q18_ranked_rules": q_q18, "q19_ranked_importance": q_q19,
    "q20_local_summary": q_q20, "q21_listing": q_q21,
    "v01_resolve_run": q_v01, "v02_counterfactual_clusters": q_v02, "v04_corpus_metrics": q_v04,
    "v05_cluster_metrics": q_v05, "v06_shap_metrics": q_v06, "v07_rule_metrics": q_v07, "v08_coverage": q_v08,
    "v09_model_metrics": q_v09, "v10_report": q_v10,
})


# ----------------------------------------------------------- preparation
from oracle.prefix import (ENCODED_CATEGORICAL, ENCODED_NUMERIC, d, derived_cte,  # noqa: E402
                           split_cte)


def q_p04():
    label = ("(' ' || CASE WHEN target = 1 THEN '>200K' ELSE '<=200K' END || "
             "CASE WHEN status = 'P' THEN '.' ELSE '' END)")
    norm = f"regexp_replace(regexp_replace(trim({label}), ',', ''), ' ', '')"
    return with_prefix(cases_cte()) + f"""
SELECT case_id, trim(segment) AS segment, trim(priority) AS priority, trim(status) AS status,
       CAST({norm} = '>200K' AS INTEGER) AS target
FROM raw_cases WHERE {norm} IN ('<=200K', '>200K')"""


def q_p06():
    return with_prefix(cases_cte(), split_cte("cases", "sp", 1)) + "\nSELECT case_id, target, is_test FROM sp"


def q_p07():
    return with_prefix(cases_cte(), split_cte("cases", "sp", 1),
                       "train AS (SELECT * EXCLUDE (is_test) FROM sp WHERE NOT is_test)",
                       split_cte("train", "tv", 2)) + \
        "\nSELECT case_id, target, is_test AS is_validation FROM tv"


def q_p08():
    from oracle.prefix import draw_sql, hash_base_sql
    u = draw_sql(hash_base_sql(["case_id", "42", "3"]), 0)
    return with_prefix(cases_cte()) + f"""
SELECT case_id, target FROM cases ORDER BY {u}, case_id LIMIT 200"""


def q_p12():
    cols = ", ".join(r6(c) + f" AS {c}" for c in NUMERIC)
    return with_prefix(cases_cte(), derived_cte()) + f"""
SELECT case_id, {cols}, {', '.join(CATEGORICAL)}, price_band, qty_band, urgency, {r6('price_per_line')} AS price_per_line
FROM derived"""


def _train_derived():
    return with_prefix(cases_cte(), split_cte("cases", "sp", 1), derived_cte().replace("FROM cases", "FROM sp"),
                       "train AS (SELECT * FROM derived WHERE NOT is_test)")


def q_p15():
    nums = " UNION ALL ".join(f"SELECT {i} AS g, '' AS v, '{c}_scaled' AS name" for i, c in enumerate(ENCODED_NUMERIC))
    cats = " UNION ALL ".join(f"SELECT DISTINCT {100 + i} AS g, {c} AS v, '{c}_' || {c} AS name FROM train"
                              for i, c in enumerate(ENCODED_CATEGORICAL))
    return _train_derived() + f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY g, v) - 1 AS BIGINT) AS ord, name FROM ({nums} UNION ALL {cats})"""


def q_p16():
    stats = ", ".join(f"AVG({c}) AS m_{c}, STDDEV_SAMP({c}) AS s_{c}" for c in ENCODED_NUMERIC)
    hot = " + ".join(f"CAST({c} IN (SELECT DISTINCT {c} FROM train) AS INTEGER)" for c in ENCODED_CATEGORICAL)
    scaled = ", ".join(
        f"{r6(f'COALESCE(CASE WHEN isnan(({c} - m_{c}) / s_{c}) THEN NULL ELSE ({c} - m_{c}) / s_{c} END, 0.0)')} AS {c}_scaled"
        for c in ENCODED_NUMERIC)
    doms = " + ".join(f"(SELECT COUNT(DISTINCT {c}) FROM train)" for c in ENCODED_CATEGORICAL)
    return _train_derived() + f""",
st AS (SELECT {stats} FROM train)
SELECT case_id, is_test, CAST({len(ENCODED_NUMERIC)} + {doms} AS INTEGER) AS width,
       {r6(f'CAST({hot} AS DOUBLE)')} AS n_hot, {scaled}
FROM derived CROSS JOIN st"""


def q_p17():
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS name, {r6(f'AVG({c})')} AS mean, {r6(f'STDDEV_SAMP({c})')} AS std FROM train"
        for c in ENCODED_NUMERIC)
    return _train_derived() + "\n" + parts


# --------------------------------------------------------------- metrics
def q_m08():
    return with_prefix(cases_cte(), scored_cte()) + f"""
SELECT {r6('AVG(CAST(target = prediction AS DOUBLE))')} AS accuracy,
       {r6('''CASE WHEN 2 * COUNT(*) FILTER (WHERE target = 1 AND prediction = 1) + COUNT(*) FILTER (WHERE target = 0 AND prediction = 1)
                    + COUNT(*) FILTER (WHERE target = 1 AND prediction = 0) > 0
               THEN (2.0 * COUNT(*) FILTER (WHERE target = 1 AND prediction = 1)) /
                    (2 * COUNT(*) FILTER (WHERE target = 1 AND prediction = 1) + COUNT(*) FILTER (WHERE target = 0 AND prediction = 1)
                     + COUNT(*) FILTER (WHERE target = 1 AND prediction = 0)) ELSE 0.0 END''')} AS f1
FROM scored2"""


def q_m09():
    return with_prefix(cases_cte(), scored_cte(), runs_cte(), metrics_cte_sql()) + f"""
SELECT {r6('roc_auc')} AS roc_auc FROM auc"""


def metrics_cte_sql():
    from oracle.prefix import metrics_cte
    return metrics_cte()


def q_m10():
    return with_prefix(cases_cte(), scored_cte()) + f""",
conf AS (SELECT target AS y, prediction AS p, COUNT(*) AS n FROM scored2 GROUP BY ALL),
cls AS (SELECT y AS c FROM conf UNION SELECT p FROM conf),
per AS (SELECT c, COALESCE((SELECT n FROM conf WHERE y = c AND p = c), 0) AS tp,
               COALESCE((SELECT SUM(n) FROM conf WHERE y = c), 0) AS support,
               COALESCE((SELECT SUM(n) FROM conf WHERE p = c), 0) AS predicted FROM cls),
per2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
                   CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
per3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
         FROM per2)
SELECT CAST(c AS VARCHAR) || '_precision' AS metric_name, {r6('precision')} AS metric_value FROM per3
UNION ALL SELECT CAST(c AS VARCHAR) || '_recall', {r6('recall')} FROM per3
UNION ALL SELECT CAST(c AS VARCHAR) || '_f1-score', {r6('f1')} FROM per3
UNION ALL SELECT CAST(c AS VARCHAR) || '_support', {r6('CAST(support AS DOUBLE)')} FROM per3
UNION ALL SELECT 'macro avg_precision', {r6('AVG(precision)')} FROM per3
UNION ALL SELECT 'macro avg_recall', {r6('AVG(recall)')} FROM per3
UNION ALL SELECT 'macro avg_f1-score', {r6('AVG(f1)')} FROM per3
UNION ALL SELECT 'weighted avg_precision', {r6('SUM(precision * support) / SUM(support)')} FROM per3
UNION ALL SELECT 'weighted avg_recall', {r6('SUM(recall * support) / SUM(support)')} FROM per3
UNION ALL SELECT 'weighted avg_f1-score', {r6('SUM(f1 * support) / SUM(support)')} FROM per3"""


def q_m13():
    from oracle.prefix import margin_sql
    shifts = [-1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0]
    vals = ", ".join(f"({i}, {d(s)})" for i, s in enumerate(shifts))
    return with_prefix(cases_cte()) + f""",
tr AS (SELECT * FROM (VALUES {vals}) t(trial, shift)),
res AS (SELECT trial, AVG(CAST(target = CAST({margin_sql()} + shift > 0 AS INTEGER) AS DOUBLE)) AS metric_value
        FROM cases CROSS JOIN tr GROUP BY trial)
SELECT arg_max(trial, (metric_value, -trial)) AS best_trial, {r6('MAX(metric_value)')} AS best_value,
       COUNT(*) AS completed_trials FROM res"""


# ----------------------------------------------------------------- store
def q_s02():
    cols = ", ".join(r6(c) + f" AS {c}" for c in NUMERIC)
    return with_prefix(cases_cte()) + f"\nSELECT case_id, {cols}, {', '.join(CATEGORICAL)}, target FROM cases"


def q_s03():
    return fp(f"""
SELECT c.id, c.run_id, c.instance_id, {r6('c.distance')} AS distance, s.n_shap
FROM cfs c LEFT JOIN (SELECT instance_id, COUNT(*) AS n_shap FROM shap_art WHERE run_id = 'run-a' GROUP BY ALL) s
USING (instance_id) WHERE c.run_id = 'run-a'""")


def q_s05():
    return with_prefix(cases_cte(), scored_cte(), runs_cte()) + f""",
af AS (SELECT AVG(CAST(target = prediction AS DOUBLE)) AS accuracy,
              COUNT(*) FILTER (WHERE target = 1 AND prediction = 1) AS tp,
              COUNT(*) FILTER (WHERE target = 0 AND prediction = 1) AS fp,
              COUNT(*) FILTER (WHERE target = 1 AND prediction = 0) AS fn FROM scored2),
w AS (SELECT accuracy, CASE WHEN 2 * tp + fp + fn > 0 THEN (2.0 * tp) / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM af)
SELECT r.run_id, m.metric_name, {r6('m.metric_value')} AS metric_value
FROM (SELECT 'accuracy' AS metric_name, accuracy AS metric_value FROM w UNION ALL SELECT 'f1', f1 FROM w) m
CROSS JOIN runs r"""


def q_s08():
    return fp(f"""
SELECT r.run_id, r.cluster_id, r.support, {r6('r.quality_score')} AS quality_score, k.n_assigned
FROM rules_art r JOIN (SELECT run_id, cluster_id, COUNT(*) AS n_assigned FROM clusters_art GROUP BY ALL) k
USING (run_id, cluster_id)""")


def q_s09():
    return fp("""
SELECT COUNT(*) AS n, COUNT(*) AS n_distinct, CAST(1001 AS BIGINT) AS min_id, CAST(1000 + COUNT(*) AS BIGINT) AS max_id
FROM cfs""")


ORACLE.update({
    "p04_label_target": q_p04, "p06_stratified_split": q_p06, "p07_nested_split": q_p07, "p08_sample": q_p08,
    "p12_features": q_p12, "p15_feature_schema": q_p15, "p16_encoded": q_p16, "p17_numeric_stats": q_p17,
    "m08_accuracy_f1": q_m08, "m09_roc_auc": q_m09, "m10_class_report": q_m10, "m13_best_trial": q_m13,
    "s02_parquet_cache": q_s02, "s03_store_round_trip": q_s03, "s05_metrics_store": q_s05,
    "s08_rerun_rules": q_s08, "s09_surrogate_ids": q_s09, "s10_report_json": q_v10,
})


ORACLE["t01_streaming_scores"] = q_scorecard


# ------------------------------------------------------------ more operators
def q_x03():
    from oracle.prefix import PERMITTED
    parts = []
    for c in NUMERIC:
        plo, phi = (d(PERMITTED[c][0]), d(PERMITTED[c][1])) if c in PERMITTED else (f"MIN({c})", f"MAX({c})")
        parts.append(f"SELECT '{c}' AS feature, {r6(f'MIN({c})')} AS lo, {r6(f'MAX({c})')} AS hi, "
                     f"{r6(f'GREATEST(MAX({c}) - MIN({c}), 1.0)')} AS feature_range, {r6(plo)} AS permitted_lo, "
                     f"{r6(phi)} AS permitted_hi FROM cases")
    return with_prefix(cases_cte()) + "\n" + " UNION ALL ".join(parts)


def q_x06():
    from oracle.prefix import FORBIDDEN, FROZEN, permitted_sql, priority_case
    frozen = " AND ".join(f"({c} IS NOT DISTINCT FROM o_{c})" for c in FROZEN)
    rng = permitted_sql()
    forb = " AND ".join(f"COALESCE({c} NOT IN ({', '.join(repr(v) for v in vals)}), TRUE)" for c, vals in FORBIDDEN.items())
    dep = f"({priority_case('priority')} IS NULL OR priority_num = {priority_case('priority')})"
    ordn = f"COALESCE({priority_case('priority')} >= {priority_case('o_priority')}, TRUE)"
    return with_prefix(cases_cte(), scored_cte(), search_cte()) + f"""
SELECT run_id, COUNT(*) AS n_candidates, COUNT(*) FILTER (WHERE prediction <> original_class) AS n_flipped,
       COUNT(*) FILTER (WHERE {frozen}) AS n_frozen_unchanged, COUNT(*) FILTER (WHERE {dep}) AS n_dependent_consistent,
       COUNT(*) FILTER (WHERE {ordn}) AS n_ordinal_not_decreasing, COUNT(*) FILTER (WHERE {forb}) AS n_allowed_destination,
       COUNT(*) FILTER (WHERE {rng}) AS n_within_permitted
FROM cand6 GROUP BY run_id"""


def q_h5():
    from oracle.prefix import SC_CATEGORICAL, SC_INTERCEPT, SC_NUMERIC
    z = d(SC_INTERCEPT)
    for c, w, center in SC_NUMERIC:
        z = f"({z} + {d(w)} * (AVG({c}) - {d(center)}))"
    for c, values in SC_CATEGORICAL:
        for v, w in values:
            z = f"({z} + {d(w)} * AVG(CAST({c} = '{v}' AS DOUBLE)))"
    return with_prefix(cases_cte()) + f"\nSELECT {r6(z)} AS base_value FROM cases"


def q_m15():
    return with_prefix(cases_cte(), split_cte("cases", "sp", 1), derived_cte().replace("FROM cases", "FROM sp"),
                       "train AS (SELECT * FROM derived WHERE NOT is_test)") + f"""
SELECT 'run-a' AS run_id, key, value FROM (
  SELECT 'n_rows' AS key, CAST(COUNT(*) AS VARCHAR) AS value FROM sp
  UNION ALL SELECT 'n_test', CAST(COUNT(*) FILTER (WHERE is_test) AS VARCHAR) FROM sp
  UNION ALL SELECT 'n_train', CAST(COUNT(*) FILTER (WHERE NOT is_test) AS VARCHAR) FROM sp
  UNION ALL SELECT 'n_features', CAST({len(ENCODED_NUMERIC)} + {' + '.join(f'(SELECT COUNT(DISTINCT {c}) FROM train)' for c in ENCODED_CATEGORICAL)} AS VARCHAR))"""


def q_q10():
    return """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events"""


def q_q10l():
    return fp("""
SELECT run_id, cluster_id, array_to_string(conditions, ' | ') AS conditions, CAST(len(conditions) AS INTEGER) AS n_conditions
FROM rules_art""")


def q_q12e():
    return f"""
SELECT user_id, event_type, {r6('arg_max(value, (ts, event_id))')} AS value, MAX(ts) AS ts
FROM events GROUP BY user_id, event_type"""


def q_d01():
    cuts, labels = [1000.0, 10000.0, 50000.0], ["short", "medium", "long", "very_long"]
    from oracle.prefix import bin_sql
    band = bin_sql("n_chars", cuts, labels)
    return f"""
WITH docs AS (
  SELECT d.doc_id AS case_id, COALESCE(CAST(d.n_chars AS DOUBLE), 0.0) AS n_chars,
         COALESCE(TRIM(d.lang), 'Unknown') AS lang, COALESCE(TRIM(d.source), 'Unknown') AS source,
         CAST(l.quality AS INTEGER) AS target
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
b AS (SELECT *, {band} AS length_band FROM docs)
SELECT case_id, target, length_band,
       CAST(1 + (SELECT COUNT(DISTINCT lang) FROM b) + (SELECT COUNT(DISTINCT source) FROM b)
            + (SELECT COUNT(DISTINCT length_band) FROM b) AS INTEGER) AS width,
       CAST(CAST(lang IN (SELECT lang FROM b) AS INTEGER) + CAST(source IN (SELECT source FROM b) AS INTEGER)
            + CAST(length_band IN (SELECT length_band FROM b) AS INTEGER) AS DOUBLE) AS n_hot
FROM b"""


ORACLE.update({
    "x03_search_context": q_x03, "x06_feasibility_counts": q_x06, "h5_base_value": q_h5,
    "m15_run_facts": q_m15, "q10_parse_json": q_q10, "q10_parse_json_list": q_q10l,
    "q08_changed_features_json": q_q07, "q12_latest_event": q_q12e,
    "d01_document_features": q_d01,
})


def q_euclidean_silhouette() -> str:
    return f"""
WITH p AS (SELECT row_number() OVER () AS r, label AS c, list_transform(embedding, lambda v: v::DOUBLE) AS v
  FROM embeddings WHERE label IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM p GROUP BY c),
s AS (SELECT a.r, a.c AS own, b.c, sum(list_distance(a.v, b.v)) AS d FROM p a JOIN p b ON a.r <> b.r GROUP BY ALL),
m AS (SELECT s.r, any_value(o.n) AS own_n, sum(d) FILTER (s.c = own) / any_value(o.n - 1) AS a,
    min(d / n.n) FILTER (s.c <> own) AS b
  FROM s JOIN n ON n.c = s.c JOIN n o ON o.c = s.own GROUP BY s.r)
SELECT {r6('avg(CASE WHEN own_n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette
FROM m"""


ORACLE["c4_euclidean_silhouette"] = q_euclidean_silhouette
ORACLE["q12_latest_stream"] = ORACLE["q12_latest_event"]


def q_kernel_shap() -> str:
    """Shapley values as a weighted sum of the worths of all coalitions."""
    from math import factorial

    from oracle.prefix import draw_sql, hash_base_sql, margin_sql
    feats, n = NUMERIC + CATEGORICAL, len(NUMERIC + CATEGORICAL)
    u = draw_sql(hash_base_sql(["case_id", "42", "3"]), 0)
    mixed = ", ".join(f"CASE WHEN (m >> {i}) & 1 = 1 THEN s.{c} ELSE b.{c} END AS {c}" for i, c in enumerate(feats))
    joins = "[" + ", ".join(f"{factorial(k - 1) * factorial(n - k) / factorial(n)!r}::DOUBLE" if k else "0.0"
                            for k in range(n + 1)) + "]"
    parts = " UNION ALL ".join(
        f"SELECT case_id, '{c}' AS feature_name, sum(v * CASE WHEN (m >> {i}) & 1 = 1 THEN w[bit_count(m) + 1] "
        f"ELSE -w[bit_count(m) + 2] END) AS shap_value FROM v, weights GROUP BY case_id" for i, c in enumerate(feats))
    value = "CASE feature_name " + " ".join(f"WHEN '{c}' THEN {c}" for c in NUMERIC) + " END"
    return with_prefix(cases_cte(), split_cte("cases", "sp", 1),
                       f"s AS (SELECT * FROM sp WHERE is_test ORDER BY {u}, case_id LIMIT 100)",
                       f"b AS (SELECT * FROM sp WHERE NOT is_test ORDER BY {u}, case_id LIMIT 50)",
                       f"x AS (SELECT s.case_id, m::INTEGER AS m, {mixed} FROM s, b, range({2 ** n}) t(m))",
                       f"v AS (SELECT case_id, m, avg(1.0 / (1.0 + exp(-({margin_sql()})))) AS v FROM x GROUP BY ALL)",
                       f"weights AS (SELECT {joins} AS w)", f"p AS ({parts})") + f"""
SELECT p.case_id AS instance_id, feature_name, {r6(value)} AS feature_value, {r6('shap_value')} AS shap_value
FROM p JOIN s ON s.case_id = p.case_id"""


ORACLE["h3_kernel_shap"] = q_kernel_shap
