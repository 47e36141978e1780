"""Counterfactual search as one distributed generate -> score -> validate ->
top-k job (X1-X10).

Plan shape: cases are exploded into ``n_candidates`` rows in place (no
join), every draw is a hash of (case, candidate, seed) so the candidate
set never depends on partitioning, the scorer is Column arithmetic or a
model transform, and the only shuffle is the per-case top-k window on
the case key. Input cases that are already hash-partitioned on the key
(as the order case table is, after its last join) need no shuffle at
all: explode keeps the child partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from lodestar.functions.columns import all_of, hash_base, sum_columns, with_uniform_draws
from lodestar.operators import candidates as cand
from lodestar.operators.features import collect_bounded
from lodestar.operators.scoring import Scorecard
from lodestar.sources.tables import level_map
from lodestar.spec import CaseSpec


@dataclass
class SearchContext:
    """Training-derived search state (X1-X3): small, model-sized."""

    ranges: dict  # numeric -> max(max - min, 1.0)
    bounds: dict  # numeric -> (min, max)
    permitted: dict  # numeric -> (lo, hi) used by the range check (X6e)
    domains: dict  # categorical -> sorted training values


def fit_context(train: DataFrame, spec: CaseSpec) -> SearchContext:
    """X1-X3 in one aggregate pass plus one distinct pass for domains."""
    nums = [c for c in spec.numeric if c in train.columns]
    aggs = []
    for i, c in enumerate(nums):
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    row = train.agg(*aggs).first() if aggs else None
    ranges, bounds = {}, {}
    for i, c in enumerate(nums):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None or hi is None:
            ranges[c] = 1.0
            continue
        ranges[c] = max(float(hi) - float(lo), 1.0)
        bounds[c] = (float(lo), float(hi))
    permitted = {c: tuple(map(float, spec.permitted.get(c, bounds.get(c, (0.0, 0.0))))) for c in nums}
    cats = [c for c in spec.actionable_categorical if c in train.columns]
    domains = {c: [] for c in cats}
    if cats:
        long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v"))
                                                for c in cats])).alias("kv")).select("kv.*").distinct()
        for r in sorted(collect_bounded(long, what="category domain"), key=lambda r: (r["f"], r["v"])):
            domains[r["f"]].append(r["v"])
    return SearchContext(ranges=ranges, bounds=bounds, permitted=permitted, domains=domains)


def generate_candidates(cases: DataFrame, spec: CaseSpec, ctx: SearchContext, n_candidates: int = 64,
                        seed: int = 42, features_to_vary=None, permitted_range=None,
                        max_varied: int = 3) -> DataFrame:
    """``n_candidates`` rows per case. Candidate ``c`` varies
    1 + c % max_varied of the actionable features (those with the
    smallest selection draws); a numeric gets a uniform draw in its
    permitted range, a categorical a uniform pick from its training
    domain. Frozen and other features keep the original value. The
    original row rides along as the struct ``orig``."""
    key = spec.key
    vary = list(features_to_vary or spec.actionable)
    unknown = [f for f in vary if f not in spec.features]
    if unknown:
        raise ValueError(f"unknown features to vary: {unknown}")
    ranges = dict(ctx.permitted)
    ranges.update({k: tuple(map(float, v)) for k, v in (permitted_range or {}).items()})
    feats = [c for c in spec.features if c in cases.columns]
    base = cases.select(key, *feats, F.struct(*[F.col(c) for c in feats]).alias("orig"),
                        *[c for c in ("original_class",) if c in cases.columns])
    exploded = base.withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))
    d = len(vary)
    # draws and selection flags are materialised as columns first so the
    # hash chain is computed once per candidate, not once per reference
    exploded = with_uniform_draws(exploded, [key, "cand", seed], [f"__u{i}" for i in range(2 * d)])
    sel = [F.col(f"__u{i}") for i in range(d)]
    val = [F.col(f"__u{d + i}") for i in range(d)]
    n_varied = F.lit(1) + F.col("cand") % F.lit(max_varied)
    flags = {}
    for i in range(d):
        earlier = [((sel[j] < sel[i]) | ((sel[j] == sel[i]) & F.lit(j < i))).cast("int") for j in range(d) if j != i]
        rank = sum_columns(earlier) if earlier else F.lit(0)
        flags[f"__v{i}"] = rank < n_varied
    exploded = exploded.withColumns(flags)
    new = {}
    for i, f in enumerate(vary):
        varied = F.col(f"__v{i}")
        if f in spec.numeric:
            lo, hi = ranges.get(f, (0.0, 0.0))
            drawn = F.lit(lo) + val[i] * F.lit(hi - lo)
            if f in spec.integral:
                drawn = F.round(drawn, 0)
            new[f] = F.when(varied, drawn).otherwise(F.col(f))
        else:
            domain = ctx.domains.get(f) or []
            if not domain:
                continue
            arr = F.array(*[F.lit(v) for v in domain])
            pick = F.element_at(arr, (F.floor(val[i] * F.lit(len(domain))) + 1).cast("int"))
            new[f] = F.when(varied, pick).otherwise(F.col(f))
    helpers = [f"__u{i}" for i in range(2 * d)] + [f"__v{i}" for i in range(d)]
    return exploded.withColumns(new).drop(*helpers)


def reconcile_candidates(df: DataFrame, spec: CaseSpec) -> DataFrame:
    """P19 on candidates: dependent := lookup[source], unmapped keeps old."""
    exprs = {dep: F.coalesce(level_map(m)[F.col(src)], F.col(dep))
             for dep, (src, m) in spec.dependent.items() if dep in df.columns and src in df.columns}
    return df.withColumns(exprs) if exprs else df


def feasibility_checks(spec: CaseSpec, ctx: SearchContext, orig: str = "orig") -> dict[str, Column]:
    """X6a-X6e as named boolean Columns on (flat counterfactual, struct original)."""
    o = lambda c: F.col(f"{orig}.{c}")
    checks = {}
    checks["frozen_unchanged"] = all_of([F.col(c).eqNullSafe(o(c)) for c in spec.frozen])
    dep = []
    for d, (src, m) in spec.dependent.items():
        expected = level_map(m)[F.col(src)]
        dep.append(expected.isNull() | (F.col(d) == expected))
    checks["dependent_consistent"] = all_of(dep)
    ordc = []
    for c, m in spec.ordinal.items():
        lm = level_map(m)
        ordc.append(F.coalesce(lm[F.col(c)] >= lm[o(c)], F.lit(True)))
    checks["ordinal_not_decreasing"] = all_of(ordc)
    checks["allowed_destination"] = all_of(
        [F.coalesce(~F.col(c).isin(list(vals)), F.lit(True)) for c, vals in spec.forbidden.items()])
    # the training-derived default range, whatever range the caller drew from
    rng = []
    for c, (lo, hi) in ctx.permitted.items():
        if c not in spec.actionable:
            continue
        rng.append((F.col(c) >= F.lit(float(lo))) & (F.col(c) <= F.lit(float(hi))))
    checks["within_permitted"] = all_of(rng)
    return checks


def feasible(spec: CaseSpec, ctx: SearchContext, orig: str = "orig") -> Column:
    return all_of(list(feasibility_checks(spec, ctx, orig).values()))


def distance(spec: CaseSpec, ctx: SearchContext, orig: str = "orig") -> Column:
    """Mean over numeric (|diff| / training range; dependents skipped)
    and categorical (0/1 changed) terms, frozen features included."""
    terms = []
    for c in spec.distance_numeric:
        terms.append(F.abs(F.col(c) - F.col(f"{orig}.{c}")) / F.lit(ctx.ranges.get(c, 1.0)))
    for c in spec.categorical:
        terms.append((~F.col(c).eqNullSafe(F.col(f"{orig}.{c}"))).cast("double"))
    return sum_columns(terms) / F.lit(float(len(terms)))


def top_k(candidates: DataFrame, key: str, k: int = 5, ok: str | None = None) -> DataFrame:
    """The k nearest valid candidates per case (distance, candidate no).

    Validity is an ordering key of the window and is filtered *after*
    it: a predicate above a window cannot be pushed below it, so the
    candidate expressions are never re-inlined into a pushed filter, and
    ``rank <= k`` lets Spark place a partial WindowGroupLimit before the
    shuffle (at most k rows per case leave a map task)."""
    order = ([F.col(ok).desc()] if ok else []) + [F.col("distance"), F.col("cand")]
    w = Window.partitionBy(key).orderBy(*order)
    ranked = candidates.withColumn("cf_rank", F.row_number().over(w))
    cond = F.col("cf_rank") <= k
    return ranked.filter(cond & F.col(ok)) if ok else ranked.filter(cond)


# Candidate rows per task the search aims for (partitions are sized for
# the candidates, of which a case has ``n_candidates``).
CANDIDATES_PER_PARTITION = 1_000_000
BATCH_CANDIDATES_PER_PARTITION = 4_000_000


def candidate_partitions(cases: DataFrame, n_candidates: int, n: int | None = None,
                         per: int = CANDIDATES_PER_PARTITION) -> int:
    spark = cases.sparkSession
    n = cases.count() if n is None else n
    par = spark.sparkContext.defaultParallelism
    return max(2 * par, -(-n * n_candidates // per))


@dataclass
class CaseFacts:
    """What a search needs to know of its cases before it starts."""

    rows: int
    repeated: bool  # several rows have one key
    holes: bool  # a feature is null


def case_facts(cases: DataFrame, spec: CaseSpec) -> CaseFacts:
    feats = [c for c in spec.features if c in cases.columns]
    hole = F.lit(False)
    for c in feats:
        hole = hole | F.col(c).isNull()
    per = cases.groupBy(spec.key).agg(F.count(F.lit(1)).alias("n"), F.count_if(hole).alias("holes"))
    row = per.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("holes").alias("holes")).first()
    return CaseFacts(row["n"] or 0, (row["most"] or 0) > 1, (row["holes"] or 0) > 0)


def in_batches(cases: DataFrame, spec: CaseSpec, scorer, vary: list, facts: CaseFacts) -> bool:
    """The cases and the scorer are such that candidates can be arrays:
    a scorecard, every feature there, no null, numbers double."""
    types = {f.name: f.dataType for f in cases.schema.fields}
    return (isinstance(scorer, Scorecard) and not facts.holes
            and all(isinstance(types.get(c), DoubleType) for c in spec.numeric)
            and all(isinstance(types.get(c), StringType) for c in spec.categorical)
            and all(c in spec.features for c, *_ in (*scorer.numeric, *scorer.categorical))
            and all(f in spec.features for f in vary))


def candidate_plan(spec: CaseSpec, ctx: SearchContext, scorer, n_candidates: int, seed: int, features_to_vary=None,
                   permitted_range=None, max_varied: int = 3) -> cand.Candidates:
    ranges = dict(ctx.permitted)
    ranges.update({k: tuple(map(float, v)) for k, v in (permitted_range or {}).items()})
    return cand.Candidates(spec, ranges, dict(ctx.permitted), dict(ctx.ranges), dict(ctx.domains), scorer,
                           list(spec.features), list(features_to_vary or spec.actionable), n_candidates, seed, max_varied)


def _with_base(cases: DataFrame, spec: CaseSpec, scorer) -> DataFrame:
    """The cases' key, features, class and the hash of the key."""
    scored = scorer.score(cases).withColumn("original_class", F.col("prediction"))
    return scored.select(spec.key, "original_class", *spec.features, hash_base([spec.key]).alias("__base"))


def _search_in_batches(cases: DataFrame, plan: cand.Candidates, total_cfs: int, desired, strict: bool,
                       repeated: bool, thin: int | None = None) -> DataFrame:
    """A task keeps the nearest candidates of each case and hands on one
    row per case with the list of them. Rows of one key are in one
    partition; where a key repeats, a window over the kept candidates of
    all its rows chooses again. ``thin``: all valid candidates have up to
    so many changes taken back, and those that lie apart are kept instead
    of the nearest (``diverse.search``; keys that do not repeat)."""
    import numpy as np
    import pyarrow as pa
    spec = plan.spec
    feats = list(spec.features)
    new = [f for f in feats if f in plan.vary or f in spec.dependent]
    source = _with_base(cases, spec, plan.scorer)
    item = StructType([StructField("cf_rank", IntegerType()), StructField("cand", IntegerType()),
                       StructField("target_class", IntegerType()), StructField("distance", DoubleType()),
                       StructField("flipped", BooleanType())]
                      + [StructField(f"new_{f}", DoubleType() if f in spec.numeric else StringType()) for f in new])
    keep = [c for c in source.columns if c != "__base"]
    schema = StructType([*source.select(*keep).schema.fields, StructField("found", ArrayType(item))])

    def run(batches):
        for batch in batches:
            for part, own in plan.slices(batch):
                s, drawn, cls, hit = plan.judged(part, own, desired)
                ok = (drawn & hit if strict else drawn) & plan.feasible(s, own)
                distance = np.broadcast_to(plan.distance(s, own), ok.shape)
                rows, at, ranks = cand.nearest(distance, ok, total_cfs) if thin is None else (*np.nonzero(ok), None)
                cls, hit, distance = (x[rows, at] for x in (cls, hit, distance))
                s = s.rows((rows, at))
                if thin is not None:
                    s, distance = plan.thinned(s, own.rows(rows), cls[:, None], distance[:, None], thin)
                    ranks = plan.spread(s, rows, distance, total_cfs) - 1
                    kept = np.nonzero(ranks >= 0)[0]
                    rows, at, ranks, cls, hit, distance = (x[kept] for x in (rows, at, ranks, cls, hit, distance[:, 0]))
                    s = s.rows(kept)
                parts = [pa.array((ranks + 1).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(cls),
                         pa.array(distance), pa.array(hit)]
                for f in new:
                    parts.append(pa.array(s.numeric[f][:, 0]) if f in s.numeric else pa.DictionaryArray.from_arrays(
                        pa.array(s.codes[f][:, 0]), pa.array(s.values[f], pa.string())).cast(pa.string()))
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=part.num_rows))]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names=item.names))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], found], names=schema.names)

    each = source.mapInArrow(run, schema).select(
        spec.key, "original_class", F.struct(*[F.col(c) for c in feats]).alias("orig"), F.explode("found").alias("f"))
    rank = F.col("f.cf_rank")
    if repeated:
        rank = F.row_number().over(Window.partitionBy(spec.key).orderBy("f.distance", "f.cand"))
    best = each.withColumn("cf_rank", rank)
    if repeated:
        best = best.where(F.col("cf_rank") <= total_cfs)
    return best.select(spec.key, "cf_rank", "f.cand", "original_class", "f.target_class", "f.distance", "orig",
                       *[F.col(f"f.new_{c}" if c in new else f"orig.{c}").alias(c) for c in feats], "f.flipped")


def count_checks(cases: DataFrame, spec: CaseSpec, ctx: SearchContext, scorer, n_candidates: int = 64, seed: int = 42,
                 facts: CaseFacts | None = None) -> DataFrame:
    """X5 + X6a-e: how many candidates there are, flip and pass each check."""
    import numpy as np
    import pyarrow as pa
    names = list(feasibility_checks(spec, ctx))
    columns = ["n_candidates", "n_flipped", *[f"n_{name}" for name in names]]
    plan = candidate_plan(spec, ctx, scorer, n_candidates, seed)
    if not in_batches(cases, spec, scorer, plan.vary, facts or case_facts(cases, spec)):
        scored = scorer.score(cases).withColumn("original_class", F.col("prediction")).drop("margin", "p1", "prediction")
        cands = scorer.score(reconcile_candidates(generate_candidates(scored, spec, ctx, n_candidates, seed), spec))
        return cands.agg(F.count(F.lit(1)).alias("n_candidates"),
                         F.count_if(F.col("prediction") != F.col("original_class")).alias("n_flipped"),
                         *[F.count_if(c).alias(f"n_{name}") for name, c in feasibility_checks(spec, ctx).items()])

    def run(batches):
        total = np.zeros(len(columns), dtype=np.int64)
        for batch in batches:
            for part, own in plan.slices(batch):
                s, _, _, hit = plan.judged(part, own, "opposite")
                checks = plan.checks(s, own)
                total += [hit.size, hit.sum(), *[np.broadcast_to(checks[n], hit.shape).sum() for n in names]]
        yield pa.RecordBatch.from_arrays([pa.array([int(t)], pa.int64()) for t in total], names=columns)

    parts = _with_base(cases, spec, scorer).mapInArrow(run, ", ".join(f"{c} long" for c in columns))
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def search(cases: DataFrame, spec: CaseSpec, ctx: SearchContext, scorer, n_candidates: int = 64,
           seed: int = 42, total_cfs: int = 5, desired="opposite", strict: bool = False,
           features_to_vary=None, permitted_range=None, max_varied: int = 3,
           partitions: int | None = None, facts: CaseFacts | None = None, thin: int | None = None) -> DataFrame:
    """X4-X8 end to end on cleaned cases.

    Output: key, cf_rank, cand, original_class, target_class, distance,
    ``orig`` struct, flat counterfactual features, ``flipped``.
    A candidate counts if it has the desired class as it was drawn. It is
    then reconciled (P19) and scored again: target_class is the class of
    the stored counterfactual and ``flipped`` says whether that is still
    the desired one; ``strict`` keeps only those (G5).

    With a scorecard, candidates are arrays inside a task and only the
    chosen ones become rows; with any other scorer they are rows.
    ``thin`` is ``diverse.search``'s: it knows where it can be asked for.
    """
    key = spec.key
    facts = facts or case_facts(cases, spec)
    plan = candidate_plan(spec, ctx, scorer, n_candidates, seed, features_to_vary, permitted_range, max_varied)
    if in_batches(cases, spec, scorer, plan.vary, facts):
        n_parts = partitions or candidate_partitions(cases, n_candidates, facts.rows, BATCH_CANDIDATES_PER_PARTITION)
        return _search_in_batches(cases.repartition(n_parts, key), plan, total_cfs, desired, strict, facts.repeated, thin)
    if thin is not None:
        raise ValueError("changes are taken back in arrays only; see diverse.search")
    # Hash-partition the (small) case table by key, sized for the exploded
    # volume: explode keeps this partitioning, so the per-case window
    # below needs no shuffle of the candidates at all.
    n_parts = partitions or candidate_partitions(cases, n_candidates, facts.rows)
    cases = cases.repartition(n_parts, key)
    scored = scorer.score(cases).withColumn("original_class", F.col("prediction")).drop(
        "margin", "p1", "prediction")
    cands = generate_candidates(scored, spec, ctx, n_candidates=n_candidates, seed=seed,
                                features_to_vary=features_to_vary, permitted_range=permitted_range,
                                max_varied=max_varied)
    want = (F.lit(1) - F.col("original_class")) if desired == "opposite" else F.lit(int(desired))
    drawn = scorer.score(cands).withColumn("__drawn", F.col("prediction") == want).drop("margin", "p1", "prediction")
    cands = scorer.score(reconcile_candidates(drawn, spec))
    flipped = F.col("prediction") == want
    ok = F.col("__drawn") & feasible(spec, ctx)
    feats = [c for c in spec.features if c in cases.columns]
    cands = cands.withColumns({"flipped": flipped, "__ok": ok & flipped if strict else ok,
                               "distance": distance(spec, ctx)})
    best = top_k(cands, key, total_cfs, ok="__ok")
    return best.select(key, "cf_rank", "cand", "original_class", F.col("prediction").alias("target_class"),
                       "distance", "orig", *feats, "flipped")


def uncovered(cases: DataFrame, counterfactuals: DataFrame, key: str) -> DataFrame:
    """Cases without any counterfactual (kept out, not failed). Both
    sides grow with the cases, and Spark's guess of what a search returns
    is far too low, so the join is one that never sends a side to the driver."""
    covered = counterfactuals.select(key).distinct().hint("merge")
    return cases.select(key).join(covered, key, "left_anti")


def to_records(found: DataFrame, spec: CaseSpec) -> DataFrame:
    """JSON records with sorted keys, nulls kept."""
    feats = sorted(c for c in spec.features if c in found.columns)
    opts = {"ignoreNullFields": "false"}
    return found.select(
        F.col(spec.key).alias("instance_id"), "cf_rank",
        F.to_json(F.struct(*[F.col(f"orig.{c}").alias(c) for c in feats]), opts).alias("original_features"),
        F.to_json(F.struct(*[F.col(c) for c in feats]), opts).alias("counterfactual_features"),
        F.col("original_class").cast("int").alias("original_class"),
        F.col("target_class").cast("int").alias("target_class"),
        "distance")
