"""Shared building blocks of the registered queries on the order cases."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from lodestar.functions.columns import wide_id
from lodestar.operators import attribution, features
from lodestar.operators.scoring import ORDER_SCORECARD
from lodestar.sources.tables import order_cases
from lodestar.spec import ORDER_CASES

SPEC = ORDER_CASES
SCORECARD = ORDER_SCORECARD


def clean_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20 on the order cases: every numeric double (null -> 0), every
    categorical trimmed (null -> 'Unknown')."""
    return features.clean(order_cases(spark, sf_dir), SPEC)


def scored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SCORECARD.score(clean_cases(spark, sf_dir))


def linear_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 over every case, background = all cases."""
    cases = clean_cases(spark, sf_dir)
    means = attribution.background_means(cases, SCORECARD)
    return attribution.linear_shap(cases, SCORECARD, means)


# ------------------------------------------------------------------ runs
from pyspark.sql import functions as F  # noqa: E402

from lodestar.operators import search as cf_search  # noqa: E402
from lodestar.session import shared_dir  # noqa: E402
from lodestar.sources.files import stored  # noqa: E402


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the cluster's shared checkpoint folder: the
    result is reused by several jobs (fits, Lloyd steps) and survives
    executor loss without recomputing the search."""
    from pyspark import StorageLevel
    shared_dir(df.sparkSession)
    # persisted first so the eager checkpoint computes the plan once (its
    # count and the file write both read the persisted blocks)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored once as parquet under the shared folder: readers scan
    the columns they need, and the rows lie there compressed."""
    return stored(df, name)


from lodestar.operators import encode as enc  # noqa: E402
from lodestar.operators import rules as rl  # noqa: E402

ENC_NUMERIC = list(SPEC.actionable_numeric)
ENC_CATEGORICAL = list(SPEC.actionable_categorical)
K = 6
LLOYD_STEPS = 3




# Two explanation runs over the same cases (run_id, model_name, seed, created_at).
RUNS = (("run-a", "scorecard", 42, "2024-01-01 00:00:00"), ("run-b", "scorecard", 7, "2024-02-01 00:00:00"))
N_CANDIDATES = 64
TOTAL_CFS = 5


def search_context(cases: DataFrame) -> cf_search.SearchContext:
    return cf_search.fit_context(cases, SPEC)


def counterfactuals_found(spark: SparkSession, sf_dir: str, runs=RUNS, strict: bool = False,
                          cases: DataFrame | None = None) -> DataFrame:
    """X4-X8 for every run over every case: run columns + search output.
    The case table is stored once: the context fit and every run read it,
    and the join pipeline behind it must not run per run."""
    cases = kept(clean_cases(spark, sf_dir), "cases") if cases is None else cases
    sctx, facts = search_context(cases), cf_search.case_facts(cases, SPEC)
    out = None
    for run_id, model_name, seed, created_at in runs:
        found = cf_search.search(cases, SPEC, sctx, SCORECARD, n_candidates=N_CANDIDATES, seed=seed,
                                 total_cfs=TOTAL_CFS, strict=strict, facts=facts)
        found = found.withColumns({"run_id": F.lit(run_id), "model_name": F.lit(model_name),
                                   "created_at": F.lit(created_at).cast("timestamp")})
        out = found if out is None else out.unionByName(found)
    return out


# ------------------------------------------------------------ artifacts
from lodestar.operators import cluster as clu  # noqa: E402
def counterfactual_rows(spark: SparkSession, sf_dir: str, runs=RUNS) -> DataFrame:
    """The `counterfactuals` artifact (X9 records + provenance) with typed
    sides, which encoders read directly, and the rank that makes its id."""
    found = counterfactuals_found(spark, sf_dir, runs)
    feats = sorted(c for c in SPEC.features)
    return found.select(
        "model_name", "run_id", F.col("case_id").alias("instance_id"), "cf_rank",
        F.col("original_class").cast("int").alias("original_class"),
        F.col("target_class").cast("int").alias("target_class"),
        "distance", "created_at",
        F.struct(*[F.col(f"orig.{c}").alias(c) for c in feats]).alias("original"),
        F.struct(*[F.col(c) for c in feats]).alias("counterfactual"))


def with_id(rows: DataFrame) -> DataFrame:
    """The rows with their id, a wide hash of (model, run, case, rank):
    reproducible without any global numbering. A projection, as a stored
    hash does not compress."""
    return rows.withColumn("id", wide_id("model_name", "run_id", "instance_id", "cf_rank"))


def with_text(rows: DataFrame, *more: str) -> DataFrame:
    """The records with both sides as JSON text, too: a projection, so
    stored records need not hold the text and readers that do not ask for
    it make none. ``more``: further columns to keep."""
    opts = {"ignoreNullFields": "false"}
    return rows.select(*more, "id", "model_name", "run_id", "instance_id",
                       F.to_json("original", opts).alias("original_features"),
                       F.to_json("counterfactual", opts).alias("counterfactual_features"),
                       "original_class", "target_class", "distance", "created_at", "original", "counterfactual")


def counterfactual_table(spark: SparkSession, sf_dir: str, runs=RUNS, store: bool = False) -> DataFrame:
    """The `counterfactuals` artifact with JSON text and typed sides;
    ``store``: for several readers, searched once."""
    rows = counterfactual_rows(spark, sf_dir, runs)
    return with_text(with_id(kept(rows, "counterfactuals") if store else rows))


def parsed_records(spark: SparkSession, sf_dir: str, runs=RUNS) -> DataFrame:
    """E1 + E2 of the `counterfactuals` artifact's JSON text, both sides
    as structs of the encoded features, stored: the encoder's fits and its
    projection read them, and text is slow to parse."""
    text = with_text(with_id(counterfactual_rows(spark, sf_dir, runs)), "cf_rank").drop("original", "counterfactual")
    parsed = enc.read_pairs(text, ENC_NUMERIC, ENC_CATEGORICAL)
    return with_id(kept(parsed.select("model_name", "run_id", "instance_id", "cf_rank", "o_map", "c_map"), "parsed"))


def encoded_run(cfs: DataFrame, run_id: str):
    """E1-E10 on one run's stored records (parsed already, with typed
    sides or with JSON text)."""
    run = cfs.filter(F.col("run_id") == F.lit(run_id))
    read = "o_map" in cfs.columns
    parsed = run if read else enc.typed_pairs(run) if "original" in cfs.columns else enc.parse_pairs(run)
    encoder = enc.fit_encoder(parsed, ENC_NUMERIC, ENC_CATEGORICAL, absent=read)
    return encoder, encoder.transform(parsed)


def distil_run(cfs: DataFrame, run_id: str, k: int = K, steps: int | None = LLOYD_STEPS):
    """R15 for one run: encode -> K-Means -> labelled rows. ``steps``: so
    many Lloyd steps from one start (what SQL can follow); None: restarts,
    each until its centres stop moving."""
    encoder, encoded = encoded_run(cfs, run_id)
    # the sides stay in the records, and so does the encoding: a projection
    # on top of them is as fast to make as wide vectors are to read
    sides = ["original", "counterfactual", "o_map", "c_map", "original_features", "counterfactual_features"]
    rows = encoder.coded()
    if rows is None:
        points, make, encoded = encoded.drop(*sides), None, encoded.drop(*sides)
    else:
        # tasks make the vectors, from the values of both sides
        made = [*encoder.columns(), "tokens", "vector"]
        points = encoded.drop(*made).withColumns(encoder.side_columns()).drop(*sides)
        make = lambda df: encoder.from_sides(df)
    if steps is None:
        fit = clu.kmeans(points, k, rows=rows, make=make)
    else:
        first = clu.initial_centres(points, k, id_col="id", column="vector", seed=42, make=make)
        fit = clu.lloyd(points, first, steps=steps, rows=rows)
    # profiles, rules and reports all read the labelled rows; their vectors
    # are made of the stored columns again where they are asked for
    ids = "cf_rank" in cfs.columns
    points = points.drop("id") if ids else points
    if rows is None:
        labelled = kept(clu.assign(points, fit.centres, keep_vector=False), "labelled")
    else:
        labelled = kept(clu.assign_coded(points, fit.centres, rows), "labelled").withColumns(rows.fields())
    labelled = with_id(labelled) if ids else labelled
    return encoder, fit, labelled.withColumn("vector", encoder.vector())


def distilled(spark: SparkSession, sf_dir: str, runs=RUNS, steps: int | None = LLOYD_STEPS):
    """Per run: labelled rows, sizes, feature + transition profiles, rules."""
    rows = with_id(kept(counterfactual_rows(spark, sf_dir, runs), "counterfactuals"))
    parts = {"labelled": [], "sizes": [], "features": [], "transitions": [], "rules": []}
    keys, readers = ["model_name", "run_id"], {}
    for run_id, model_name, _, created_at in runs:
        encoder, fit, labelled = distil_run(rows, run_id, steps=steps)
        readers[run_id] = encoder.coded() and replace(encoder.coded(), stored=True)
        sizes = rl.cluster_sizes(labelled, keys)
        feats = rl.feature_profile(labelled, ENC_NUMERIC, ENC_CATEGORICAL, keys)
        trans = rl.transition_profile(labelled, keys)
        rules = rl.rule_quality(rl.extract_rules(sizes, feats, trans, ENC_NUMERIC, keys))
        rules = rules.withColumn("created_at", F.lit(created_at).cast("timestamp"))
        for name, df in (("labelled", labelled), ("sizes", sizes), ("features", feats),
                         ("transitions", trans), ("rules", rules)):
            parts[name].append(df)
    out = {}
    for name, dfs in parts.items():
        u = dfs[0]
        for d in dfs[1:]:
            u = u.unionByName(d, allowMissingColumns=name == "labelled")
        out[name] = u
    out["readers"] = readers
    out["counterfactuals"] = with_text(rows)
    return out


from lodestar.operators import metrics as mt  # noqa: E402


def shap_table(spark: SparkSession, sf_dir: str, runs=RUNS) -> DataFrame:
    """The `shap_values` artifact: linear SHAP of every explained case per run."""
    long = linear_shap(spark, sf_dir)
    out = None
    for run_id, model_name, _, created_at in runs:
        part = long.withColumns({"model_name": F.lit(model_name), "run_id": F.lit(run_id),
                                 "created_at": F.lit(created_at).cast("timestamp")})
        out = part if out is None else out.unionByName(part)
    return out.withColumn("id", wide_id("model_name", "run_id", "instance_id", "feature_name")).select(
        "id", "model_name", "run_id", "instance_id", "feature_name", "feature_value", "shap_value", "created_at")


METRIC_NAMES = ("accuracy", "f1", "roc_auc", "n_cases")


def metrics_table(spark: SparkSession, sf_dir: str, runs=RUNS) -> DataFrame:
    """The `metrics` artifact (S5 shape): numeric metrics per run, long."""
    # scored once for the three aggregates
    scored = materialise(scored_cases(spark, sf_dir).select("target", "prediction", "p1"))
    af = mt.accuracy_f1(scored)
    auc = mt.roc_auc(scored)
    n = scored.agg(F.count(F.lit(1)).cast("double").alias("n_cases"))
    wide = af.withColumn("k", F.lit(1)).join(auc.withColumn("k", F.lit(1)), "k").join(n.withColumn("k", F.lit(1)), "k")
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric_name"), F.lit(i).alias("ord"),
                                                    F.col(m).cast("double").alias("metric_value"))
                                           for i, m in enumerate(METRIC_NAMES)])).alias("e")).select("e.*")
    out = None
    for run_id, model_name, _, created_at in runs:
        part = long.withColumns({"model_name": F.lit(model_name), "run_id": F.lit(run_id),
                                 "created_at": F.lit(created_at).cast("timestamp")})
        out = part if out is None else out.unionByName(part)
    return out.withColumn("id", wide_id("model_name", "run_id", "metric_name")).select("id", "model_name", "run_id", "metric_name", "metric_value", "created_at")


def silhouettes(labelled: DataFrame, runs=RUNS, readers: dict | None = None) -> DataFrame:
    """(run_id, silhouette_sq_euclidean) of the stored assignment.
    ``readers``: per run, what reads the stored rows without making their
    vectors (``distilled``)."""
    out = None
    for run_id, *_ in runs:
        part = clu.silhouette(labelled.filter(F.col("run_id") == run_id), rows=(readers or {}).get(run_id)).select(
            F.lit(run_id).alias("run_id"), F.col("silhouette").alias("silhouette_sq_euclidean"))
        out = part if out is None else out.unionByName(part)
    return out


def facts_table(spark: SparkSession, sf_dir: str, runs=RUNS) -> DataFrame:
    """The run facts that the report reads: (run_id, key, value)."""
    from lodestar.operators import prepare as prep
    split = prep.stratified_split(clean_cases(spark, sf_dir), SPEC.key, SPEC.target, 0.2, 42)
    n = split.agg(F.count_if("is_test").cast("string").alias("test_rows"),
                  F.count_if(~F.col("is_test")).cast("string").alias("train_rows"))
    run = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("run_id"), F.lit(r[1]).alias("model_class")) for r in runs]))
    each = n.withColumn("r", run).select("train_rows", "test_rows", "r.*")
    facts = {"model_class": F.col("model_class"), "stage": F.lit("explain"), "train_rows": F.col("train_rows"),
             "test_rows": F.col("test_rows"), "feature_count": F.lit(str(len(SCORECARD.dummies())))}
    return each.select("run_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"))
                                                     for k, v in facts.items()])).alias("f")).select("run_id", "f.*")


def cluster_table(labelled: DataFrame) -> DataFrame:
    """The `counterfactual_clusters` artifact."""
    return labelled.select(F.col("id").alias("counterfactual_id"), "model_name", "run_id", "instance_id",
                           F.col("cluster_id").cast("int").alias("cluster_id"), "created_at") \
        .withColumn("id", F.col("counterfactual_id"))


def rules_table(rules: DataFrame) -> DataFrame:
    """The `global_rules` artifact."""
    return rules.select(wide_id("model_name", "run_id", F.col("cluster_id").cast("int")).alias("id"),
                        "model_name", "run_id", F.col("cluster_id").cast("int").alias("cluster_id"), "conditions",
                        "support", F.col("share").alias("support_share"), "avg_distance", "quality_score", "created_at")
