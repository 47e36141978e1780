"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the given tables (or data Spark derives from them) in
full. Double outputs are rounded to 6 digits so the SQL oracle can
compare values across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from lodestar.operators import explore
from lodestar.plans import context as ctx
from lodestar.session import tune

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        def run(spark, sf_dir):
            tune(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


def round6(c, digits: int = 6):
    """round(x * 10^d) / 10^d, half away from zero on the scaled double
    (the arithmetic SQL engines use), not Spark's exact-decimal HALF_UP."""
    scale = float(10 ** digits)
    # + 0.0 turns a negative zero into +0.0 (IEEE), as the oracle does
    return F.round(c.cast("double") * F.lit(scale), 0) / F.lit(scale) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    exprs = {f.name: round6(F.col(f.name), digits) for f in df.schema.fields
             if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(exprs) if exprs else df


@register("m05_scorecard")
def m05_scorecard(spark, sf_dir):
    """M4 + M5 with the fixed scorecard on every case."""
    return rounded(ctx.scored_cases(spark, sf_dir).select("case_id", "margin", "p1", "prediction", "target"))


@register("h2_linear_shap")
def h2_linear_shap(spark, sf_dir):
    """H2 + H5/H6: long-form linear SHAP for every case."""
    return rounded(ctx.linear_shap(spark, sf_dir))


@register("q04_global_importance")
def q04_global_importance(spark, sf_dir):
    """Q4: which features drive the score (mean |shap|, top 10)."""
    return rounded(explore.global_importance(ctx.linear_shap(spark, sf_dir), top_n=10))



@register("x08_counterfactual_search")
def x08_counterfactual_search(spark, sf_dir):
    """Top-5 feasible counterfactuals per case and run."""
    found = ctx.counterfactuals_found(spark, sf_dir)
    return rounded(found.select(*FOUND_COLUMNS))


FOUND_COLUMNS = ["run_id", "case_id", "cf_rank", "cand", "original_class", "target_class", "flipped", "distance",
                 "total_price", "line_count", "sum_qty", "avg_discount", "segment", "priority", "priority_num"]


@register("x05_strict_search")
def x05_strict_search(spark, sf_dir):
    """X5 with ``strict``: the stored counterfactual still flips."""
    return rounded(ctx.counterfactuals_found(spark, sf_dir, strict=True).select(*FOUND_COLUMNS))


# ---------------------------------------------------------------- artifacts
def _cfs(spark, sf_dir, store=True):
    """The counterfactual artifact, stored once where several jobs read it
    (recomputing it would re-run the search); a single reader takes it
    from the search as it comes (``store`` False)."""
    return ctx.counterfactual_table(spark, sf_dir, store=store)


@register("x09_counterfactual_records")
def x09_counterfactual_records(spark, sf_dir):
    """X9 + V3: stored records with provenance and intervention signature."""
    cfs = _cfs(spark, sf_dir, store=False)
    sig = explore.signature(cfs)
    return rounded(cfs.select("id", "model_name", "run_id", "instance_id", "original_class", "target_class",
                              "distance", "created_at", F.array_join(sig, ",").alias("signature"),
                              F.size(sig).alias("n_changed")))


@register("x10_uncovered_cases")
def x10_uncovered_cases(spark, sf_dir):
    """Cases of each run without any counterfactual."""
    from lodestar.operators import search as S
    cases = ctx.kept(ctx.clean_cases(spark, sf_dir), "cases")
    found = ctx.counterfactuals_found(spark, sf_dir, cases=cases)
    out = None
    for run_id, *_ in ctx.RUNS:
        part = S.uncovered(cases, found.filter(F.col("run_id") == run_id), "case_id").withColumn("run_id", F.lit(run_id))
        out = part if out is None else out.unionByName(part)
    return out


@register("e03_corpus_ranges")
def e03_corpus_ranges(spark, sf_dir):
    """Per run and numeric feature, the corpus range max(range, 1)."""
    from lodestar.operators import encode as enc
    return rounded(enc.range_table(enc.typed_pairs(_cfs(spark, sf_dir, store=False)), ctx.ENC_NUMERIC, ["run_id"]))


@register("e08_transition_vocabulary")
def e08_transition_vocabulary(spark, sf_dir):
    """E7 + E8: the sorted transition vocabulary learned per run."""
    from lodestar.operators import encode as enc
    return enc.vocabulary_table(enc.typed_pairs(_cfs(spark, sf_dir, store=False)), ctx.ENC_CATEGORICAL, ["run_id"])


@register("e09_change_vectors")
def e09_change_vectors(spark, sf_dir):
    """Per counterfactual deltas, flags, tokens and vector summary."""
    cfs = _cfs(spark, sf_dir)
    out = None
    for run_id, *_ in ctx.RUNS:
        encoder, encoded = ctx.encoded_run(cfs, run_id)
        part = encoded.select("id", "run_id", *[f"{f}__delta" for f in ctx.ENC_NUMERIC],
                              (sum([F.col(f"{f}__changed") for f in ctx.ENC_NUMERIC + ctx.ENC_CATEGORICAL], F.lit(0.0)))
                              .alias("n_changed"),
                              F.array_join("tokens", ";").alias("tokens"),
                              F.size("vector").alias("width"),
                              F.aggregate("vector", F.lit(0.0), lambda a, v: a + v).alias("vector_sum"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@register("e11_clustering_matrix")
def e11_clustering_matrix(spark, sf_dir):
    """The JSON text parsed leniently, encoded, as ML vectors."""
    from lodestar.operators import encode as enc
    from pyspark.ml.functions import vector_to_array
    parsed = ctx.parsed_records(spark, sf_dir)
    out = None
    for run_id, *_ in ctx.RUNS:
        encoder, encoded = ctx.encoded_run(parsed, run_id)
        made = enc.clustering_matrix(encoded, encoder).select("id", "run_id", vector_to_array("features").alias("v"))
        out = made if out is None else out.unionByName(made)
    return rounded(out.select("id", "run_id", F.size("v").alias("width"),
                              F.aggregate("v", F.lit(0.0), lambda a, v: a + v).alias("vector_sum")))


def _distilled(spark, sf_dir):
    return ctx.distilled(spark, sf_dir)


@register("c2_cluster_assignment")
def c2_cluster_assignment(spark, sf_dir):
    """C2 + C3 + C5 + C6: frozen-init Lloyd clusters: size, share, inertia per cluster."""
    lab = _distilled(spark, sf_dir)["labelled"]
    per = lab.groupBy("run_id", "cluster_id").agg(F.count(F.lit(1)).alias("size"),
                                                   F.sum("sq_distance").alias("inertia"))
    tot = lab.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    return rounded(per.join(tot, "run_id").withColumn("share", F.col("size") / F.col("total")).drop("total"))


@register("c4_silhouette")
def c4_silhouette(spark, sf_dir):
    """C4: exact silhouette (squared Euclidean) per run, no point pairs."""
    d = _distilled(spark, sf_dir)
    return rounded(ctx.silhouettes(d["labelled"], readers=d["readers"]))


@register("r01_cluster_sizes")
def r01_cluster_sizes(spark, sf_dir):
    """R1 + R5: size, share, mean distance per cluster (ascending id)."""
    return rounded(_distilled(spark, sf_dir)["sizes"].select("run_id", "cluster_id", "size", "share", "avg_distance"))


@register("r03_feature_profile")
def r03_feature_profile(spark, sf_dir):
    """R2 + R3: change rate and mean normalised delta per cluster and feature."""
    return rounded(_distilled(spark, sf_dir)["features"].select("run_id", "cluster_id", "feature", "change_rate",
                                                                "avg_delta"))


@register("r04_transition_profile")
def r04_transition_profile(spark, sf_dir):
    """Top-10 transitions per cluster by rate."""
    return rounded(_distilled(spark, sf_dir)["transitions"].select("run_id", "cluster_id", "token", "rate", "rank"))


@register("r08_rules")
def r08_rules(spark, sf_dir):
    """Distilled rule text, support and quality per cluster."""
    r = _distilled(spark, sf_dir)["rules"]
    return rounded(r.select("run_id", "cluster_id", F.array_join("conditions", " | ").alias("conditions"),
                            "support", "share", "avg_distance", "condition_count", "compactness",
                            "distance_score", "quality_score"))


@register("r15_converged_rules")
def r15_converged_rules(spark, sf_dir):
    """C1 + R15: rules of clusters that ten restarts converged to."""
    r = ctx.distilled(spark, sf_dir, steps=None)["rules"]
    return rounded(r.select("run_id", "cluster_id", F.array_join("conditions", " | ").alias("conditions"), "support",
                            "share", "avg_distance", "quality_score"))


@register("r14_rule_similarity")
def r14_rule_similarity(spark, sf_dir):
    """Jaccard similarity of all unordered rule pairs per run."""
    from lodestar.operators import rules as rl
    # k rows, read twice
    r = ctx.kept(_distilled(spark, sf_dir)["rules"], "rules")
    return rounded(rl.rule_pairs(r, ["model_name", "run_id"]).select("run_id", "cluster_a", "cluster_b", "similarity"))


@register("r16_rule_sentences")
def r16_rule_sentences(spark, sf_dir):
    """R16: 'IF ... AND ... THEN ...' sentence per rule."""
    from lodestar.operators import rules as rl
    r = _distilled(spark, sf_dir)["rules"]
    return r.select("run_id", "cluster_id", rl.rule_sentence(F.col("conditions")).alias("sentence"))



# ------------------------------------------------------- explorer queries
from lodestar.operators import report as rep  # noqa: E402


def _artifacts(spark, sf_dir, need=("cfs", "clusters", "rules", "shap", "metrics"), steps=ctx.LLOYD_STEPS):
    out = {}
    if {"clusters", "rules"} & set(need):
        d = ctx.distilled(spark, sf_dir, steps=steps)
        out["cfs"] = d["counterfactuals"]
        out["clusters"] = ctx.cluster_table(d["labelled"])
        out["rules"] = ctx.rules_table(d["rules"])
        out["labelled"], out["readers"] = d["labelled"], d["readers"]
    elif "cfs" in need:
        out["cfs"] = _cfs(spark, sf_dir)
    if "shap" in need:
        out["shap"] = ctx.shap_table(spark, sf_dir)
    if "metrics" in need:
        out["metrics"] = ctx.metrics_table(spark, sf_dir)
    return out


def _first_instance(shap):
    """The example instance: the smallest explained instance id (Q9)."""
    return shap.agg(F.min("instance_id").alias("instance_id"))


@register("q01_runs")
def q01_runs(spark, sf_dir):
    return explore.runs(_cfs(spark, sf_dir, store=False))


@register("q02_counterfactuals_with_clusters")
def q02_counterfactuals_with_clusters(spark, sf_dir):
    a = _artifacts(spark, sf_dir, ("cfs", "clusters"))
    out = explore.counterfactuals_with_clusters(a["cfs"], a["clusters"], "run-a")
    return rounded(out.select("id", "run_id", "instance_id", "original_class", "target_class", "distance", "cluster_id"))


@register("q03_rules_of_run")
def q03_rules_of_run(spark, sf_dir):
    a = _artifacts(spark, sf_dir, ("rules",))
    out = explore.rules_of_run(a["rules"], "run-a")
    return rounded(out.select("id", "run_id", "cluster_id", F.array_join("conditions", " | ").alias("conditions"),
                              "support", "support_share", "avg_distance", "quality_score"))


@register("q05_local_attribution")
def q05_local_attribution(spark, sf_dir):
    """Q5: contributions of the example instance, |shap| descending."""
    shap = ctx.shap_table(spark, sf_dir)
    first = _first_instance(shap.filter(F.col("run_id") == "run-a"))
    return rounded(explore.local_attribution(shap, first, top_n=5, run_id="run-a"))


@register("q06_run_summary")
def q06_run_summary(spark, sf_dir):
    a = _artifacts(spark, sf_dir, ("cfs", "clusters", "rules", "shap"))
    return explore.run_summary(a["cfs"], a["clusters"], a["rules"], a["shap"], "run-a")


@register("q07_changed_features")
def q07_changed_features(spark, sf_dir):
    """Q7/Q8: changed features of every counterfactual with value text."""
    return explore.changed_features(_cfs(spark, sf_dir, store=False)).drop("model_name", "instance_id")


@register("q08_changed_features_json")
def q08_changed_features_json(spark, sf_dir):
    """Q8: the same from the JSON text alone, over the original's keys."""
    text = _cfs(spark, sf_dir, store=False).drop("original", "counterfactual")
    return explore.changed_features(text, union_keys=False).drop("model_name", "instance_id")


@register("q09_explained_instances")
def q09_explained_instances(spark, sf_dir):
    return explore.explained_instances(ctx.shap_table(spark, sf_dir), run_id="run-a")


@register("q11_newest_counterfactuals")
def q11_newest_counterfactuals(spark, sf_dir):
    cfs = _cfs(spark, sf_dir, store=False)
    return rounded(explore.newest_counterfactuals(cfs, limit=100).select("id", "run_id", "instance_id", "distance",
                                                                         "created_at"))


@register("q12_latest_metrics")
def q12_latest_metrics(spark, sf_dir):
    return rounded(explore.latest_metrics(ctx.metrics_table(spark, sf_dir)))


@register("q13_metric_history")
def q13_metric_history(spark, sf_dir):
    out = explore.metric_history(ctx.metrics_table(spark, sf_dir), "accuracy", limit=10)
    return rounded(out.select("id", "run_id", "metric_name", "metric_value", "created_at"))


@register("q15_explorer_summary")
def q15_explorer_summary(spark, sf_dir):
    """Q14 + Q15: distance <= 0.05 and cluster in {0, 1} of run-a, summarised."""
    a = _artifacts(spark, sf_dir, ("cfs", "clusters"))
    joined = explore.counterfactuals_with_clusters(a["cfs"], a["clusters"], "run-a")
    return rounded(explore.explorer_summary(explore.explorer_filter(joined, 0.05, (0, 1))))


@register("q16_instance_counterfactuals")
def q16_instance_counterfactuals(spark, sf_dir):
    cfs = _cfs(spark, sf_dir)
    one = explore.instance_counterfactuals(cfs, _first_instance(cfs))
    return rounded(one.select("id", "run_id", "instance_id", "distance", "target_class"))


@register("q17_rule_summary")
def q17_rule_summary(spark, sf_dir):
    """Q17: rules with quality >= 0.5, summarised per run."""
    a = _artifacts(spark, sf_dir, ("rules",))
    return rounded(explore.rule_summary(explore.rule_filter(a["rules"], 0.5), ["run_id"]))


@register("q18_ranked_rules")
def q18_ranked_rules(spark, sf_dir):
    a = _artifacts(spark, sf_dir, ("rules",))
    return rounded(explore.ranked_rules(a["rules"], 3).select("run_id", "cluster_id", "quality_score", "rank"))


@register("q19_ranked_importance")
def q19_ranked_importance(spark, sf_dir):
    shap = ctx.shap_table(spark, sf_dir)
    return rounded(explore.ranked_importance(explore.global_importance(shap, 10, run_id="run-a")))


@register("q20_local_summary")
def q20_local_summary(spark, sf_dir):
    shap = ctx.shap_table(spark, sf_dir).filter(F.col("run_id") == "run-a")
    return rounded(explore.local_summary(shap))


@register("q21_listing")
def q21_listing(spark, sf_dir):
    """Q21: every counterfactual of run-a with its changes as text."""
    return rounded(explore.listing(_cfs(spark, sf_dir, store=False).filter(F.col("run_id") == "run-a")))


# --------------------------------------------------------------- report
KEYS = ("model_name", "run_id")


@register("v01_resolve_run")
def v01_resolve_run(spark, sf_dir):
    a = _artifacts(spark, sf_dir, ("cfs", "rules"))
    return rep.resolve_run(a["cfs"], a["rules"])


@register("v02_counterfactual_clusters")
def v02_counterfactual_clusters(spark, sf_dir):
    a = _artifacts(spark, sf_dir, ("cfs", "clusters"))
    return rep.with_clusters(a["cfs"], a["clusters"]).select("id", "run_id", "model_name", "cluster_id")


@register("v04_corpus_metrics")
def v04_corpus_metrics(spark, sf_dir):
    return rounded(rep.corpus_metrics(_cfs(spark, sf_dir)))


@register("v05_cluster_metrics")
def v05_cluster_metrics(spark, sf_dir):
    a = _artifacts(spark, sf_dir, ("clusters",))
    return rounded(rep.cluster_metrics(a["clusters"], silhouettes=ctx.silhouettes(a["labelled"], readers=a["readers"])))


@register("v06_shap_metrics")
def v06_shap_metrics(spark, sf_dir):
    return rep.shap_metrics(ctx.shap_table(spark, sf_dir))


@register("v07_rule_metrics")
def v07_rule_metrics(spark, sf_dir):
    a = _artifacts(spark, sf_dir, ("rules",))
    return rounded(rep.rule_metrics(a["rules"]))


@register("v08_coverage")
def v08_coverage(spark, sf_dir):
    return rounded(rep.coverage(_cfs(spark, sf_dir), ctx.shap_table(spark, sf_dir)))


@register("v09_model_metrics")
def v09_model_metrics(spark, sf_dir):
    return rounded(rep.model_metrics(ctx.metrics_table(spark, sf_dir), facts=ctx.facts_table(spark, sf_dir)))


@register("v10_report")
def v10_report(spark, sf_dir):
    """The assembled long report for every run."""
    return _report(spark, sf_dir, _artifacts(spark, sf_dir))


@register("v10_converged_report")
def v10_converged_report(spark, sf_dir):
    """V10 + V5 + S6-S8: the report of clusters that ten starts converged
    to, with rules and assignments stored and read back."""
    a = _artifacts(spark, sf_dir, steps=None)
    root = files.scratch_path(spark, "store")
    store.replace_run(a["rules"], root, "global_rules")
    store.replace_run(a["clusters"], root, "counterfactual_clusters")
    a["rules"] = store.read(spark, root, "global_rules").select(*a["rules"].columns)
    a["clusters"] = store.read(spark, root, "counterfactual_clusters").select(*a["clusters"].columns)
    return _report(spark, sf_dir, a)


def _report(spark, sf_dir, a):
    sections = {"run": rep.header(a["rules"]), "corpus": rep.corpus_metrics(a["cfs"]),
                "clusters": rep.cluster_metrics(a["clusters"], silhouettes=ctx.silhouettes(a["labelled"], readers=a["readers"])),
                "shap": rep.shap_metrics(a["shap"]), "rules": rep.rule_metrics(a["rules"]),
                "coverage": rep.coverage(a["cfs"], a["shap"]), "model": rep.model_metrics(a["metrics"], facts=ctx.facts_table(spark, sf_dir))}
    return rounded(rep.assemble(sections))



# ----------------------------------------------------------- preparation
from lodestar.operators import features as feat  # noqa: E402
from lodestar.operators import metrics as mt  # noqa: E402
from lodestar.operators import prepare as prep  # noqa: E402
from lodestar.sources import files, store  # noqa: E402
from lodestar.sources.tables import order_cases  # noqa: E402

LABELS = ("<=200K", ">200K")


@register("p04_label_target")
def p04_label_target(spark, sf_dir):
    """S1 + P1-P5: raw text cases through a headerless CSV, trimmed,
    label normalised and validated, binary target."""
    raw = files.raw_order_text(order_cases(spark, sf_dir))
    path = files.write_headerless_csv(raw, files.scratch_path(spark, "raw-orders"))
    df = files.read_headerless_csv(spark, path, files.RAW_COLUMNS)
    df = prep.trim_categoricals(df, ctx.SPEC.categorical)
    df = df.withColumn("label", prep.normalise_label(F.col("label")))
    df = prep.binary_target(prep.valid_labels(df, "label", LABELS), "label", ">200K")
    return df.select(F.trim("case_id").cast("bigint").alias("case_id"), "segment", "priority", "status", "target")


def _split(spark, sf_dir):
    return prep.stratified_split(ctx.clean_cases(spark, sf_dir), "case_id", "target", 0.2, 42)


@register("p06_stratified_split")
def p06_stratified_split(spark, sf_dir):
    """Stratified 80/20 split by hash rank (largest remainder, ceil)."""
    return _split(spark, sf_dir).select("case_id", "target", "is_test")


@register("p07_nested_split")
def p07_nested_split(spark, sf_dir):
    """The training part split again into tune / validation."""
    train = _split(spark, sf_dir).filter(~F.col("is_test")).drop("is_test")
    return prep.stratified_split(train, "case_id", "target", 0.2, 42, salt=prep.TUNE_SALT) \
        .select("case_id", "target", F.col("is_test").alias("is_validation"))


@register("p08_sample")
def p08_sample(spark, sf_dir):
    """P8 + P9: seeded sample of 200 cases, then selected by key."""
    cases = ctx.clean_cases(spark, sf_dir)
    ids = prep.sample_cases(cases, "case_id", 200, seed=42).select("case_id")
    chosen, _unknown = prep.select_instances(cases, "case_id", ids)
    return chosen.select("case_id", "target")


@register("p12_features")
def p12_features(spark, sf_dir):
    """P10-P13 + P19/P20: cleaned, reconciled, binned cases with the ratio."""
    df = feat.reconcile(feat.derive(order_cases(spark, sf_dir), ctx.SPEC), ctx.SPEC)
    return rounded(df.select("case_id", *ctx.SPEC.numeric, *ctx.SPEC.categorical, "price_band", "qty_band",
                             "urgency", "price_per_line"))


def _feature_model(spark, sf_dir):
    split = _split(spark, sf_dir)
    train = split.filter(~F.col("is_test"))
    return split, feat.fit_features(train, ctx.SPEC, scale=True)


@register("p15_feature_schema")
def p15_feature_schema(spark, sf_dir):
    """Output schema learned on training rows only."""
    _, fm = _feature_model(spark, sf_dir)
    return fm.schema_frame(spark)


@register("p16_encoded")
def p16_encoded(spark, sf_dir):
    """P14 + P16 + P18: every case encoded against the training schema."""
    split, fm = _feature_model(spark, sf_dir)
    enc = fm.transform(split, keep=True)
    n_num = len(fm.numeric)
    return rounded(enc.select("case_id", "is_test", F.size("features").alias("width"),
                              F.aggregate(F.slice("features", n_num + 1, fm.width), F.lit(0.0),
                                          lambda a, v: a + v).alias("n_hot"),
                              *[F.col(f"{c}_scaled") for c in fm.numeric]))


@register("p17_numeric_stats")
def p17_numeric_stats(spark, sf_dir):
    """Mean and sample std of every encoded numeric on training rows."""
    train = _split(spark, sf_dir).filter(~F.col("is_test"))
    return rounded(feat.numeric_stats(train, ctx.SPEC))


# ------------------------------------------------------------- metrics
@register("m08_accuracy_f1")
def m08_accuracy_f1(spark, sf_dir):
    """M7 + M8 of the scorecard against the target."""
    return rounded(mt.accuracy_f1(ctx.scored_cases(spark, sf_dir)))


@register("m09_roc_auc")
def m09_roc_auc(spark, sf_dir):
    """M9: tie-aware AUC from P(class 1), no global window."""
    return rounded(mt.roc_auc(ctx.scored_cases(spark, sf_dir)))


@register("m10_class_report")
def m10_class_report(spark, sf_dir):
    """Per-class and averaged precision/recall/f1/support, long."""
    return rounded(mt.class_report(ctx.scored_cases(spark, sf_dir)))


INTERCEPT_SHIFTS = [-1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0]


@register("m13_best_trial")
def m13_best_trial(spark, sf_dir):
    """M12 (scorecard form) + M13: one trial per intercept shift scored on
    every case, best accuracy (ties: lowest trial) and completed count."""
    cases = ctx.clean_cases(spark, sf_dir)
    z = ctx.SCORECARD.margin()
    shifts = F.array(*[F.lit(s) for s in INTERCEPT_SHIFTS])
    trials = (cases.select("target", F.posexplode(shifts).alias("trial", "shift"), z.alias("z"))
              .groupBy("trial").agg(F.avg((F.col("target") == ((F.col("z") + F.col("shift")) > 0).cast("int"))
                                           .cast("double")).alias("metric_value")))
    return rounded(mt.best_trial(trials, "metric_value", "maximize"))


# ------------------------------------------------------------- store
@register("s02_parquet_cache")
def s02_parquet_cache(spark, sf_dir):
    """Cleaned cases via a read-or-build parquet cache."""
    path = files.scratch_path(spark, "cases-cache")
    df = files.parquet_cache(spark, path, lambda: ctx.clean_cases(spark, sf_dir))
    return rounded(df.select("case_id", *ctx.SPEC.numeric, *ctx.SPEC.categorical, "target"))


@register("s03_store_round_trip")
def s03_store_round_trip(spark, sf_dir):
    """S3 + S4: counterfactuals and SHAP appended per run into the
    partitioned store, read back with partition pruning."""
    root = files.scratch_path(spark, "store")
    cfs = _cfs(spark, sf_dir)
    shap = ctx.shap_table(spark, sf_dir)
    for run_id, model_name, _, created_at in ctx.RUNS:
        store.append(cfs.filter(F.col("run_id") == run_id).drop("run_id", "model_name", "created_at"),
                     root, "counterfactuals", run_id, model_name, created_at)
        store.append(shap.filter(F.col("run_id") == run_id).drop("run_id", "model_name", "created_at"),
                     root, "shap_values", run_id, model_name, created_at)
    back = store.read(spark, root, "counterfactuals", run_id="run-a")
    n_shap = store.read(spark, root, "shap_values", run_id="run-a").groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n_shap"))
    return rounded(back.select("id", "run_id", "instance_id", "distance").join(n_shap, "instance_id", "left"))


@register("s05_metrics_store")
def s05_metrics_store(spark, sf_dir):
    """Numeric metrics only, long, per run."""
    root = files.scratch_path(spark, "store")
    wide = mt.accuracy_f1(ctx.scored_cases(spark, sf_dir)).withColumn("note", F.lit("scorecard"))
    for run_id, model_name, _, created_at in ctx.RUNS:
        store.append_metrics(wide, root, run_id, model_name, created_at)
    return rounded(store.read(spark, root, "metrics").select("run_id", "metric_name", "metric_value"))


@register("s08_rerun_rules")
def s08_rerun_rules(spark, sf_dir):
    """S6 + S7 + S8: clusters and rules stored; distilling a run twice
    replaces its partition instead of duplicating rows."""
    root = files.scratch_path(spark, "store")
    d = ctx.distilled(spark, sf_dir)
    # k rows, written twice
    rules = ctx.kept(ctx.rules_table(d["rules"]), "rules")
    for _ in range(2):
        store.replace_run(rules, root, "global_rules")
    lab = d["labelled"]
    for run_id, model_name, _, created_at in ctx.RUNS:
        store.append_clusters(lab.filter(F.col("run_id") == run_id).select("id", "instance_id", "cluster_id"),
                              root, run_id, model_name, created_at)
    back = store.read(spark, root, "global_rules")
    cl = store.read(spark, root, "counterfactual_clusters").groupBy("run_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("n_assigned"))
    return rounded(back.select("run_id", "cluster_id", "support", "quality_score").join(cl, ["run_id", "cluster_id"]))


@register("s09_surrogate_ids")
def s09_surrogate_ids(spark, sf_dir):
    """Consecutive surrogate ids after the max existing id (two passes,
    no global window); reported as count / distinct / min / max."""
    cfs = _cfs(spark, sf_dir).drop("id")
    with_ids = store.with_surrogate_ids(cfs, start_after=1000)
    return with_ids.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_distinct"),
                        F.min("id").alias("min_id"), F.max("id").alias("max_id"))


@register("s10_report_json")
def s10_report_json(spark, sf_dir):
    """The assembled report written as JSON and read back."""
    return files.write_report_json(v10_report(spark, sf_dir), files.scratch_path(spark, "report"))



# ------------------------------------------------------------- MLlib (rows)
from lodestar.operators import attribution as attr  # noqa: E402
from lodestar.operators import boosting as boost  # noqa: E402
from lodestar.operators import model as mdl  # noqa: E402
from lodestar.operators import tuning  # noqa: E402

def _forest(spark, sf_dir):
    split = ctx.materialise(_split(spark, sf_dir))
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    fm, model, scorer = mdl.fit(train, ctx.SPEC, "random_forest")
    return split, train, test, fm, model, scorer


@register("m01_random_forest")
def m01_random_forest(spark, sf_dir):
    """M1 + M4-M7 (+ M14 shape): forest fitted on the train split, scored on test."""
    split, train, test, fm, model, scorer = _forest(spark, sf_dir)
    return rounded(scorer.score(test).select("case_id", "target", "prediction", "p1"))


@register("m02_boosted_trees")
def m02_boosted_trees(spark, sf_dir):
    """M2: depth-wise regularised boosted trees with the default settings."""
    return _boosted(spark, sf_dir, "newton_depthwise")


def _boosted(spark, sf_dir, family):
    split = ctx.materialise(_split(spark, sf_dir))
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    _, _, scorer = boost.fit(train, ctx.SPEC, family)
    return rounded(scorer.score(test).select("case_id", "target", "prediction", "p1"))


@register("m03_leafwise_trees")
def m03_leafwise_trees(spark, sf_dir):
    """M3: leaf-wise boosted trees of 31 leaves."""
    return _boosted(spark, sf_dir, "newton_leafwise")


@register("m11_feature_importance")
def m11_feature_importance(spark, sf_dir):
    """Forest feature importances by name, descending."""
    _, _, _, fm, model, _ = _forest(spark, sf_dir)
    return rounded(mdl.importances(spark, fm, model))


# The search budget of the registered query: all trials of the operator.
TRIALS = 30


@register("m12_random_search")
def m12_random_search(spark, sf_dir):
    """M12 + M13 + M14: seeded random search on tune/validation, best
    trial refit on all training rows and scored on test (long rows)."""
    split = ctx.materialise(_split(spark, sf_dir))
    train = split.filter(~F.col("is_test")).drop("is_test")
    test = split.filter(F.col("is_test"))
    tv = ctx.kept(prep.stratified_split(train, "case_id", "target", 0.2, 42, salt=prep.TUNE_SALT), "tune")
    trials = ctx.materialise(mdl.random_search(tv.filter(~F.col("is_test")), tv.filter(F.col("is_test")), ctx.SPEC,
                                               "random_forest", n_trials=TRIALS, metric="f1"))
    best = mt.best_trial(trials).first()
    params = mdl.draw_params("random_forest", TRIALS)[best["best_trial"]]
    train, test = mdl.shared_rows(train, test, ctx.SPEC, "random_forest", params)
    _, _, scorer = mdl.fit(train, ctx.SPEC, "random_forest", params)
    final = mdl.evaluate(scorer, test)
    rows = [("trial", float(r["trial"]), r["metric_value"]) for r in trials.collect()] + \
           [("test_" + k, 0.0, float(v) if v is not None else None) for k, v in final.items()]
    return rounded(spark.createDataFrame(rows, "kind string, trial double, value double"))


@register("m12_adaptive_search")
def m12_adaptive_search(spark, sf_dir):
    """M12 + M13 + M14: 30 adaptive trials on tune/validation, best trial
    refit on all training rows and scored on test (long rows)."""
    split = ctx.materialise(_split(spark, sf_dir))
    train, test = split.filter(~F.col("is_test")).drop("is_test"), split.filter(F.col("is_test"))
    tv = prep.stratified_split(train, "case_id", "target", 0.2, 42, salt=prep.TUNE_SALT)
    goal = tuning.Objective(tv.filter(~F.col("is_test")), tv.filter(F.col("is_test")), ctx.SPEC, "newton_depthwise")
    trials = tuning.search(goal, TRIALS)
    _, _, scorer = boost.fit(train, ctx.SPEC, goal.family, tuning.best(trials).params)
    rows = [("stopped" if t.stopped else "trial", float(t.number), t.score) for t in trials] + \
           [("test_" + k, 0.0, float(v) if v is not None else None) for k, v in mdl.evaluate(scorer, test).items()]
    return rounded(spark.createDataFrame(rows, "kind string, trial double, value double"))


@register("m11_boosted_importance")
def m11_boosted_importance(spark, sf_dir):
    """M11 on the leaf-wise trees: each feature's share of the gain."""
    split = ctx.materialise(_split(spark, sf_dir))
    fm, model, _ = boost.fit(split.filter(~F.col("is_test")), ctx.SPEC, "newton_leafwise")
    rows = sorted(zip(fm.names, model.importances()), key=lambda r: (-r[1], r[0]))
    return rounded(spark.createDataFrame(rows, "feature string, importance double"))


@register("h5_tree_base")
def h5_tree_base(spark, sf_dir):
    """H5 for trees: per class, the expected probability of the forest that
    h1_tree_shap explains (base plus a case's values is its p1)."""
    _, _, _, _, model, _ = _forest(spark, sf_dir)
    base = attr.tree_base(attr.leaf_paths(mdl.forest_trees(spark, model)))
    return rounded(spark.createDataFrame([(0, 1.0 - base), (1, base)], "class int, base_value double"))


@register("h1_tree_shap")
def h1_tree_shap(spark, sf_dir):
    """H1 + H4-H6: exact path-dependent tree SHAP of the fitted forest for
    every test case, long form."""
    split, train, test, fm, model, scorer = _forest(spark, sf_dir)
    leaves = attr.leaf_paths(mdl.forest_trees(spark, model))
    enc = fm.transform(test, output="features")
    return rounded(attr.tree_shap(enc, leaves, fm.names))


@register("x11_fitted_model_search")
def x11_fitted_model_search(spark, sf_dir):
    """X4-X8 with the fitted forest as scorer (M6) over the shared sample
    of 100 test cases (P8)."""
    found, _ = _explained(spark, sf_dir)
    return rounded(found.select(*[c for c in FOUND_COLUMNS if c != "run_id"]))


@register("h1_explained_sample")
def h1_explained_sample(spark, sf_dir):
    """H1 of the same forest on the same sample."""
    _, shap = _explained(spark, sf_dir)
    return rounded(shap)


def _explained(spark, sf_dir, params=None, scale=False):
    """The explain run on a fitted model: one sample, the search and the
    attributions of it."""
    from lodestar.operators import search as S
    split = ctx.materialise(_split(spark, sf_dir))
    train, test = split.filter(~F.col("is_test")).drop("is_test"), split.filter(F.col("is_test")).drop("is_test")
    fm, model, scorer = mdl.fit(train, ctx.SPEC, "random_forest", params, scale=scale)
    sample = ctx.materialise(prep.sample_cases(test, "case_id", 100, seed=42))
    found = S.search(sample, ctx.SPEC, S.fit_context(train, ctx.SPEC), scorer, n_candidates=ctx.N_CANDIDATES, seed=42,
                     total_cfs=ctx.TOTAL_CFS)
    leaves = attr.leaf_paths(mdl.forest_trees(spark, model))
    return found, attr.tree_shap(fm.transform(sample, output="features"), leaves, fm.names)


@register("h3_permutation_shap")
def h3_permutation_shap(spark, sf_dir):
    """H3: sampled-permutation Shapley of the scorecard probability for
    every case and feature against a seeded sample of 100 rows."""
    cases = ctx.materialise(ctx.clean_cases(spark, sf_dir))
    background = prep.sample_cases(cases, "case_id", 100, seed=42)
    return rounded(attr.permutation_shap(cases, background, ctx.SCORECARD, list(ctx.SPEC.features),
                                         n_permutations=4, seed=42))


@register("h3_kernel_shap")
def h3_kernel_shap(spark, sf_dir):
    """H3: kernel SHAP of the scorecard over all coalitions, for the shared
    sample of 100 test cases (P8) against 50 training rows."""
    from lodestar.operators import kernel_shap as ks
    split = ctx.materialise(_split(spark, sf_dir))
    sample = prep.sample_cases(split.filter(F.col("is_test")), "case_id", 100, seed=42)
    background = ctx.materialise(prep.sample_cases(split.filter(~F.col("is_test")), "case_id", 50, seed=42))
    return rounded(ks.kernel_shap(ctx.materialise(sample), background, ctx.SCORECARD, list(ctx.SPEC.features)))


@register("x08_diverse_counterfactuals")
def x08_diverse_counterfactuals(spark, sf_dir):
    """X4 + X8: per run, every case's flipping candidates with superfluous
    changes taken back, five of them spread apart."""
    from lodestar.operators import diverse, search as S
    cases = ctx.kept(ctx.clean_cases(spark, sf_dir), "cases")
    sctx, facts, out = ctx.search_context(cases), S.case_facts(cases, ctx.SPEC), None
    for run_id, _, seed, _ in ctx.RUNS:
        part = diverse.search(cases, ctx.SPEC, sctx, ctx.SCORECARD, n_candidates=ctx.N_CANDIDATES, seed=seed,
                              total_cfs=ctx.TOTAL_CFS, facts=facts).withColumn("run_id", F.lit(run_id))
        out = part if out is None else out.unionByName(part)
    return rounded(out.select("run_id", "case_id", "cf_rank", "cand", "original_class", "target_class", "distance",
                              "n_changed", *ctx.SPEC.features))


def _embedding_points(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("vector"))


@register("c1_kmeans_mllib")
def c1_kmeans_mllib(spark, sf_dir):
    """C1 + C3 + C4 + C6 on the embeddings table: K-Means (k=10, ten
    k-means|| starts at once), sizes, inertia and both silhouettes."""
    from lodestar.operators import cluster as clu
    emb = ctx.materialise(_embedding_points(spark, sf_dir))
    fit = clu.kmeans(emb, 10, id_col="vec_id", seed=42, n_init=10, max_iter=300)
    lab = ctx.materialise(clu.assign(emb, fit.centres))
    both = {"silhouette": F.lit(clu.silhouette(lab).first()["silhouette"]),
            "silhouette_euclidean": F.lit(clu.euclidean_silhouette(lab).first()["silhouette"]),
            "inertia": F.lit(clu.inertia(lab).first()["inertia"])}
    return rounded(clu.sizes(lab).withColumns(both))


@register("c4_euclidean_silhouette")
def c4_euclidean_silhouette(spark, sf_dir):
    """C4: the Euclidean silhouette of the embeddings by their label."""
    from lodestar.operators import cluster as clu
    lab = _embedding_points(spark, sf_dir).where("label IS NOT NULL").withColumnRenamed("label", "cluster_id")
    return rounded(clu.euclidean_silhouette(lab))


@register("c7_k_sweep")
def c7_k_sweep(spark, sf_dir):
    """K from 2 to 10 on the embeddings: silhouette, inertia, min/max size."""
    from lodestar.operators import cluster as clu
    emb = ctx.materialise(_embedding_points(spark, sf_dir))
    return rounded(clu.k_sweep(emb, range(2, 11), id_col="vec_id", seed=42, n_init=10, max_iter=300))



@register("t01_streaming_scores")
def t01_streaming_scores(spark, sf_dir):
    """Streaming: orders stream -> stream-static joins -> clean -> score,
    drained with availableNow into parquet in the shared folder."""
    from lodestar.streaming import scoring as st
    out = files.scratch_path(spark, "stream-out")
    st.run_to_parquet(st.scored_order_stream(spark, sf_dir).select("case_id", "margin", "p1", "prediction", "target"),
                      out, out + "-ckpt")
    return rounded(spark.read.parquet(out))



# ------------------------------------------------------------ more operators
@register("q12_latest_stream")
def q12_latest_stream(spark, sf_dir):
    """Q12 as a stateful stream: all events, dealt to files that arrive one
    by one out of order; the state's latest value per (user, event type)."""
    from lodestar.streaming import latest as st
    keys = ["user_id", "event_type"]
    root = files.scratch_path(spark, "latest")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(*keys, F.col("ts").cast("timestamp").alias("ts"),
                                                               "event_id", "value")
    ev.repartition(4, "event_id").write.parquet(root + "/in")
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(root + "/in")
    changes = st.newest(source, keys, "ts", "event_id", "value")
    st.run(changes, root + "/out", root + "/check")
    found = st.latest(spark, root + "/out", keys, changes.schema)
    return rounded(found.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@register("x03_search_context")
def x03_search_context(spark, sf_dir):
    """Per numeric feature training bounds, range max(max-min, 1)
    and the permitted range used for draws."""
    from lodestar.operators import search as S
    sctx = S.fit_context(ctx.clean_cases(spark, sf_dir), ctx.SPEC)
    rows = [(c, sctx.bounds[c][0], sctx.bounds[c][1], sctx.ranges[c], sctx.permitted[c][0], sctx.permitted[c][1])
            for c in ctx.SPEC.numeric]
    # model-sized fitted state (one row per numeric feature)
    return rounded(spark.createDataFrame(rows, "feature string, lo double, hi double, feature_range double, "
                                               "permitted_lo double, permitted_hi double"))


@register("x06_feasibility_counts")
def x06_feasibility_counts(spark, sf_dir):
    """X5 + X6a-e: per run, how many candidates flip and pass each check."""
    from lodestar.operators import search as S
    cases = ctx.kept(ctx.clean_cases(spark, sf_dir), "cases")
    sctx, facts = S.fit_context(cases, ctx.SPEC), S.case_facts(cases, ctx.SPEC)
    out = None
    for run_id, _, seed, _ in ctx.RUNS:
        part = S.count_checks(cases, ctx.SPEC, sctx, ctx.SCORECARD, n_candidates=ctx.N_CANDIDATES, seed=seed,
                              facts=facts).withColumn("run_id", F.lit(run_id))
        out = part if out is None else out.unionByName(part)
    return out


@register("h5_base_value")
def h5_base_value(spark, sf_dir):
    """H5: expected margin of the linear explainer, f(E[x])."""
    from lodestar.operators import attribution as at
    cases = ctx.clean_cases(spark, sf_dir)
    means = at.background_means(cases, ctx.SCORECARD)
    return rounded(spark.createDataFrame([(at.base_value(ctx.SCORECARD, means),)], "base_value double"))


@register("m15_run_facts")
def m15_run_facts(spark, sf_dir):
    """Run facts (rows, split sizes, encoded width) as long rows."""
    split = ctx.materialise(_split(spark, sf_dir))
    counts = split.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).first()
    fm = feat.fit_features(split.filter(~F.col("is_test")), ctx.SPEC, scale=True)
    facts = {"n_rows": counts["n"], "n_test": counts["t"], "n_train": counts["n"] - counts["t"],
             "n_features": fm.width}
    return mt.run_facts("run-a", facts, spark)


@register("q10_parse_json")
def q10_parse_json(spark, sf_dir):
    """Q10: JSON object payloads parsed with a schema; a value that is not
    an object fails the query (events.props)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return explore.parse_json(ev, "props", ["event_id"]).select(
        "event_id", F.col("value")["k"].cast("bigint").alias("k"), F.size("value").alias("n_keys"))


@register("q10_parse_json_list")
def q10_parse_json_list(spark, sf_dir):
    """Q10: JSON list payloads (the stored rule conditions) parsed back."""
    text = store.rules_json(_artifacts(spark, sf_dir, ("rules",))["rules"])
    return explore.parse_json_list(text, "conditions", ["run_id", "cluster_id"]).select(
        "run_id", "cluster_id", F.array_join("value", " | ").alias("conditions"), F.size("value").alias("n_conditions"))


@register("q12_latest_event")
def q12_latest_event(spark, sf_dir):
    """Q12 on events: latest value per (user, event type) by (ts, id)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(ev.groupBy("user_id", "event_type").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts")))


@register("d01_document_features")
def d01_document_features(spark, sf_dir):
    """Genericity: the same cleaning, binning and one-hot encoding on the
    labelled documents (a second case table with other column roles)."""
    from lodestar.sources.tables import document_cases
    from lodestar.spec import DOCUMENT_CASES
    docs = document_cases(spark, sf_dir)
    fm = feat.fit_features(docs, DOCUMENT_CASES, scale=False)
    enc = fm.transform(docs)
    n_num = len(fm.numeric)
    return rounded(enc.select("case_id", "target", "length_band", F.size("features").alias("width"),
                              F.aggregate(F.slice("features", n_num + 1, fm.width), F.lit(0.0),
                                          lambda a, v: a + v).alias("n_hot")))


FLAGSHIP = "r08_rules"
