"""Queries over the stored artifact tables (Q1-Q21).

Artifact tables (see ``lodestar.sources.store``):
counterfactuals(id, model_name, run_id, instance_id, original_features,
counterfactual_features, original_class, target_class, distance, created_at),
counterfactual_clusters(id, model_name, run_id, instance_id,
counterfactual_id, cluster_id, created_at), global_rules(id, model_name,
run_id, cluster_id, conditions, support, support_share, avg_distance,
quality_score, created_at), shap_values(id, model_name, run_id,
instance_id, feature_name, feature_value, shap_value, created_at),
metrics(id, model_name, run_id, metric_name, metric_value, created_at).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType
from pyspark.sql.window import Window

from lodestar.functions.columns import all_of


def _eq_filters(df: DataFrame, **conds) -> DataFrame:
    preds = [F.col(k) == F.lit(v) for k, v in conds.items() if v is not None]
    return df.filter(all_of(preds)) if preds else df


def runs(counterfactuals: DataFrame) -> DataFrame:
    """Q1: counterfactual count and newest timestamp per (run, model), newest first."""
    return (counterfactuals.filter(F.col("run_id").isNotNull())
            .groupBy("run_id", "model_name")
            .agg(F.count(F.lit(1)).alias("n_counterfactuals"), F.max("created_at").alias("last_created_at"))
            .orderBy(F.col("last_created_at").desc(), "run_id", "model_name"))


def counterfactuals_with_clusters(counterfactuals: DataFrame, clusters: DataFrame, run_id: str) -> DataFrame:
    """Q2: counterfactuals of one run left-joined to their cluster on (id, run)."""
    cf = counterfactuals.filter(F.col("run_id") == F.lit(run_id))
    cl = clusters.filter(F.col("run_id") == F.lit(run_id)).select(
        F.col("counterfactual_id"), F.col("run_id").alias("cl_run_id"), "cluster_id")
    return (cf.join(cl, (cf["id"] == cl["counterfactual_id"]) & (cf["run_id"] == cl["cl_run_id"]), "left")
            .select(cf["id"], cf["run_id"], cf["model_name"], cf["instance_id"], cf["original_features"],
                    cf["counterfactual_features"], cf["original_class"], cf["target_class"], cf["distance"],
                    cl["cluster_id"])
            .orderBy("instance_id", "distance", "id"))


def rules_of_run(rules: DataFrame, run_id: str) -> DataFrame:
    """Q3: rules of a run, best quality first."""
    return rules.filter(F.col("run_id") == F.lit(run_id)).orderBy(F.col("quality_score").desc(), "cluster_id")


def global_importance(shap: DataFrame, top_n: int = 10, **filters) -> DataFrame:
    """Q4: mean |shap| per feature, descending, top n (n >= 1)."""
    if top_n < 1:
        raise ValueError("top_n must be >= 1")
    return (_eq_filters(shap, **filters).groupBy("feature_name")
            .agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
            .orderBy(F.col("mean_abs_shap").desc(), "feature_name").limit(top_n))


def local_attribution(shap: DataFrame, instance_id, top_n: int | None = None, **filters) -> DataFrame:
    """Q5: one instance's contributions by |shap| descending, optional top
    n. ``instance_id``: a value, or a one-row frame that holds it."""
    chosen = _eq_filters(shap, **filters)
    chosen = chosen.join(instance_id, "instance_id", "left_semi") if isinstance(instance_id, DataFrame) else \
        chosen.filter(F.col("instance_id") == F.lit(instance_id))
    out = (chosen
           .select("instance_id", "feature_name", "feature_value", "shap_value")
           .orderBy(F.abs("shap_value").desc(), "feature_name"))
    return out.limit(top_n) if top_n else out


def run_summary(counterfactuals: DataFrame, clusters: DataFrame, rules: DataFrame, shap: DataFrame,
                run_id: str) -> DataFrame:
    """Q6: five counts across four tables (two distinct) as one row.

    Five one-row aggregates combined by joining on the run key; every
    side is a global aggregate (partial aggregation map side)."""
    r = F.lit(run_id)
    a = counterfactuals.filter(F.col("run_id") == r).agg(
        F.count(F.lit(1)).alias("n_counterfactuals"),
        F.countDistinct("instance_id").alias("n_instances"))
    b = clusters.filter(F.col("run_id") == r).agg(F.countDistinct("cluster_id").alias("n_clusters"))
    c = rules.filter(F.col("run_id") == r).agg(F.count(F.lit(1)).alias("n_rules"))
    d = shap.filter(F.col("run_id") == r).agg(F.countDistinct("instance_id").alias("n_shap_instances"))
    out = a.withColumn("k", F.lit(1))
    for side in (b, c, d):
        out = out.join(side.withColumn("k", F.lit(1)), "k")
    return out.drop("k")


SIDES = ("original", "counterfactual")


def _typed(df: DataFrame) -> bool:
    """The records carry both sides as structs next to their JSON text."""
    return all(isinstance(df.schema[c].dataType, StructType) if c in df.columns else False for c in SIDES)


def _json_side(c: str):
    """A JSON object as map from key to (text with its JSON quotes, plain
    text); a JSON null has no text."""
    return F.transform_values(F.from_json(F.col(c), "map<string,variant>"), lambda k, v: F.struct(
        F.nullif(F.to_json(v), F.lit("null")).alias("json"), v.cast("string").alias("plain")))


def _is_number(json):
    return json.isNotNull() & ~json.startswith('"') & json.try_cast("double").isNotNull()


def _values_equal(a, b):
    """Python equality of two JSON scalars held as JSON text: numbers
    compare as numbers (9 == 9.0), texts as texts ("01" is not "1")."""
    return F.when(_is_number(a) & _is_number(b), a.try_cast("double") == b.try_cast("double")).otherwise(a.eqNullSafe(b))


def _number_text(n):
    """A number with 6 fixed decimals (engine independent)."""
    return (F.round(n * F.lit(1e6), 0) / F.lit(1e6)).cast("decimal(38,6)").cast("string")


def _json_text(v):
    return F.when(_is_number(v["json"]), _number_text(v["json"].try_cast("double"))).otherwise(
        F.coalesce(v["plain"], F.lit("None")))


def _changes(df: DataFrame, union_keys: bool):
    """Array of (feature, original_value, counterfactual_value) of the
    changed features, sorted by feature. Typed sides compare by their
    column types and parse nothing; else each side is parsed once."""
    if _typed(df):
        types = [{f.name: f.dataType for f in df.schema[c].dataType.fields} for c in SIDES]
        names = sorted(set(types[0]) | (set(types[1]) if union_keys else set()))

        def side(i, name):
            if name not in types[i]:
                return F.lit(None).cast(types[1 - i][name])
            return F.col(f"{SIDES[i]}.`{name}`")

        def text(i, name):
            v = side(i, name)
            shown = _number_text(v.cast("double")) if isinstance(types[i].get(name), NumericType) else v.cast("string")
            return F.coalesce(shown, F.lit("None"))
        items = [F.when(~side(0, n).eqNullSafe(side(1, n)), F.struct(
            F.lit(n).alias("feature"), text(0, n).alias("original_value"), text(1, n).alias("counterfactual_value")))
            for n in names]
        return F.filter(F.array(*items), lambda x: x.isNotNull())
    parsed = F.array(F.struct(_json_side("original_features").alias("o"),
                              _json_side("counterfactual_features").alias("c")))

    def changed(p):
        o, c = p["o"], p["c"]
        keys = F.array_union(F.map_keys(o), F.map_keys(c)) if union_keys else F.map_keys(o)
        rest = F.filter(F.array_sort(keys), lambda k: ~_values_equal(o[k]["json"], c[k]["json"]))
        return F.transform(rest, lambda k: F.struct(k.alias("feature"), _json_text(o[k]).alias("original_value"),
                                                    _json_text(c[k]).alias("counterfactual_value")))
    return F.transform(parsed, changed)[0]


def changed_features(counterfactuals: DataFrame, union_keys: bool = True) -> DataFrame:
    """Q7 (key union) / Q8 (original keys only): one row per changed
    feature with old and new value as text, sorted by feature."""
    rows = counterfactuals.select("id", "run_id", "model_name", "instance_id",
                                  F.explode(_changes(counterfactuals, union_keys)).alias("x"))
    return rows.select("id", "run_id", "model_name", "instance_id", "x.feature", "x.original_value",
                       "x.counterfactual_value")


def explained_instances(shap: DataFrame, **filters) -> DataFrame:
    """Q9: distinct explained instances, ascending."""
    return _eq_filters(shap, **filters).select("instance_id").distinct().orderBy("instance_id")


def newest_counterfactuals(counterfactuals: DataFrame, limit: int = 100, model_name=None, run_id=None) -> DataFrame:
    """Q11: newest first with optional filters (id breaks timestamp ties)."""
    if limit < 0:
        raise ValueError("limit must be >= 0")
    return (_eq_filters(counterfactuals, model_name=model_name, run_id=run_id)
            .orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit))


def latest_metrics(metrics: DataFrame, model_name=None, run_id=None) -> DataFrame:
    """Q12: latest value per metric name (max_by over (created_at, id))."""
    return (_eq_filters(metrics, model_name=model_name, run_id=run_id).groupBy("metric_name")
            .agg(F.max_by("metric_value", F.struct("created_at", "id")).alias("metric_value")))


def metric_history(metrics: DataFrame, metric_name: str, limit: int = 100, model_name=None, run_id=None) -> DataFrame:
    """Q13: one metric's history, newest first."""
    return (_eq_filters(metrics, metric_name=metric_name, model_name=model_name, run_id=run_id)
            .orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit))


def explorer_filter(cf_clusters: DataFrame, max_distance: float, clusters=()) -> DataFrame:
    """Q14: distance <= d and cluster in set (empty set: no cluster filter)."""
    out = cf_clusters.filter(F.col("distance") <= F.lit(float(max_distance)))
    if clusters:
        out = out.filter(F.col("cluster_id").isin(list(clusters)))
    return out


def explorer_summary(filtered: DataFrame) -> DataFrame:
    """Q15: rows, distinct instances, mean distance (0.0 when empty)."""
    return filtered.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("instance_id").alias("n_instances"),
                        F.coalesce(F.avg("distance"), F.lit(0.0)).alias("mean_distance"))


def instance_counterfactuals(counterfactuals: DataFrame, instance_id) -> DataFrame:
    """Q16: counterfactuals of one instance (a value, or a one-row frame
    that holds it), nearest first."""
    chosen = counterfactuals.join(instance_id, "instance_id", "left_semi") if isinstance(instance_id, DataFrame) \
        else counterfactuals.filter(F.col("instance_id") == F.lit(instance_id))
    return chosen.orderBy("distance", "id")


def rule_filter(rules: DataFrame, min_quality: float = 0.0, clusters=()) -> DataFrame:
    """Q17 (filter part)."""
    out = rules.filter(F.col("quality_score") >= F.lit(float(min_quality)))
    return out.filter(F.col("cluster_id").isin(list(clusters))) if clusters else out


def rule_summary(rules: DataFrame, keys=()) -> DataFrame:
    """Q17 (summary part): count, total support, mean quality, mean
    distance, in all or per ``keys``."""
    return rules.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rules"), F.sum("support").cast("bigint").alias("total_support"),
                     F.avg("quality_score").alias("mean_quality"), F.avg("avg_distance").alias("mean_distance"))


def ranked_rules(rules: DataFrame, top: int = 3) -> DataFrame:
    """Q18: rule comparison with 1-based rank by quality, top n per run.

    The rank window is partitioned by (model_name, run_id)."""
    w = Window.partitionBy("model_name", "run_id").orderBy(F.col("quality_score").desc(), "cluster_id")
    return rules.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def ranked_importance(importance: DataFrame) -> DataFrame:
    """Q19: 1-based rank of an importance table (already top-n, bounded)."""
    w = Window.orderBy(F.col("mean_abs_shap").desc(), "feature_name")
    return importance.withColumn("rank", F.row_number().over(w))


def local_summary(shap: DataFrame) -> DataFrame:
    """Q20: per instance strongest positive / negative contribution
    ('N/A', 0.0 when none) and total |shap|; all instances in one groupBy."""
    pos = F.col("shap_value") > 0
    neg = F.col("shap_value") < 0
    by = F.struct(F.abs("shap_value"), F.col("feature_name"))
    return (shap.groupBy("instance_id").agg(
        F.coalesce(F.max_by(F.when(pos, F.col("feature_name")), F.when(pos, F.struct(F.col("shap_value"), F.col("feature_name")))), F.lit("N/A")).alias("top_positive_feature"),
        F.coalesce(F.max(F.when(pos, F.col("shap_value"))), F.lit(0.0)).alias("top_positive_value"),
        F.coalesce(F.max_by(F.when(neg, F.col("feature_name")), F.when(neg, F.struct(F.abs("shap_value"), F.col("feature_name")))), F.lit("N/A")).alias("top_negative_feature"),
        F.coalesce(F.min(F.when(neg, F.col("shap_value"))), F.lit(0.0)).alias("top_negative_value"),
        F.sum(F.abs("shap_value")).alias("total_abs_shap"),
        F.count_if(F.col("shap_value") >= 0).alias("n_non_negative")))


def listing(counterfactuals: DataFrame) -> DataFrame:
    """Q21: counterfactual listing ordered by instance and distance with
    its changes (original keys) as text."""
    text = F.transform(_changes(counterfactuals, union_keys=False), lambda x: F.concat(
        x["feature"], F.lit(": "), x["original_value"], F.lit(" -> "), x["counterfactual_value"]))
    return (counterfactuals.select("id", "instance_id", "distance", F.array_join(text, "; ").alias("changes"))
            .orderBy("instance_id", "distance", "id"))


def signature(counterfactuals: DataFrame):
    """V3: sorted names of changed features over the key union (Python
    equality on JSON values, so 9 == 9.0 and "01" != "1")."""
    if _typed(counterfactuals):
        # no value is made text for its name
        types = [{f.name for f in counterfactuals.schema[c].dataType.fields} for c in SIDES]
        sides = {n: [F.col(f"{c}.`{n}`") if n in t else F.lit(None) for c, t in zip(SIDES, types)] for n in sorted(types[0] | types[1])}
        return F.filter(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in sides.items()]), lambda n: n.isNotNull())
    return F.transform(_changes(counterfactuals, union_keys=True), lambda x: x["feature"])


def parse_json(df: DataFrame, column: str, keys) -> DataFrame:
    """Q10: one JSON object per row as (keys.., value map). A value that
    is not an object fails the query."""
    m = F.from_json(F.col(column), "map<string,string>")
    bad = F.raise_error(F.lit("expected a JSON object"))
    return df.select(*keys, F.when(m.isNull() & F.col(column).isNotNull(), bad).otherwise(m).alias("value"))


def parse_json_list(df: DataFrame, column: str, keys) -> DataFrame:
    """Q10: one JSON array of scalars per row as array<string>. A value
    that is not an array fails the query."""
    a = F.from_json(F.col(column), "array<string>")
    bad = F.raise_error(F.lit("expected a JSON array"))
    shaped = F.col(column).rlike(r"^\s*\[") & a.isNotNull()
    return df.select(*keys, F.when(F.col(column).isNotNull() & ~shaped, bad).otherwise(a).alias("value"))
