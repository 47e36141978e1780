"""Sparse and diverse counterfactuals (X4, X8 beyond the nearest k).

``thin`` takes changes back: of the features that a counterfactual
changes, the one whose return leaves it nearest to the case goes back to
the case's value, as long as the class stays flipped and all feasibility
checks hold; and again, until none can. ``spread`` picks k of a case's
counterfactuals: the nearest first, then always the one farthest from
those picked (largest least distance; ties: nearer to the case, then the
candidate number); equal ones are picked once.

Both work on the search's partitioning by case: variants are exploded in
place, choices are windows over one case's candidates, of which there are
at most ``n_candidates``. So neither shuffles and no group is unbounded.
With a scorecard ``search`` does the same on arrays inside the search's
tasks (``candidates.Candidates.thinned`` and ``spread``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators import search as S
from lodestar.spec import CaseSpec


def changed(spec: CaseSpec, names) -> Column:
    """How many of the features differ from the case's."""
    return sum((~F.col(c).eqNullSafe(F.col(f"orig.{c}"))).cast("int") for c in names)


def thin(found: DataFrame, spec: CaseSpec, ctx: S.SearchContext, scorer, rounds: int | None = None) -> DataFrame:
    """``found`` (a strict search's output) with as few changes as can be
    reached, distance and target_class anew. ``rounds``: at most so many
    changes are taken back (default: all but one of the actionable)."""
    feats = [c for c in spec.features if c in found.columns]
    vary = [c for c in spec.actionable if c in feats and c not in spec.dependent]
    key, row = spec.key, [spec.key, "cand"]
    out = found.select(*row, "original_class", "target_class", "distance", "orig", *feats)
    for _ in range(len(vary) - 1 if rounds is None else rounds):
        # variant -1 keeps the row; variant i returns feature i if it is changed
        options = F.array(F.lit(-1), *[F.when(~F.col(c).eqNullSafe(F.col(f"orig.{c}")), F.lit(i)) for i, c in enumerate(vary)])
        each = out.withColumn("__i", F.explode(F.filter(options, lambda i: i.isNotNull())))
        back = each.withColumns({c: F.when(F.col("__i") == i, F.col(f"orig.{c}")).otherwise(F.col(c)) for i, c in enumerate(vary)})
        scored = scorer.score(S.reconcile_candidates(back, spec))
        fine = (F.col("prediction") == F.col("target_class")) & S.feasible(spec, ctx)
        scored = scored.withColumns({"__fine": fine & (F.col("__i") >= 0), "distance": S.distance(spec, ctx)})
        best = Window.partitionBy(*row).orderBy(F.desc("__fine"), F.when(F.col("__fine"), F.col("distance")).otherwise(
            F.col("__i").cast("double")), "__i")
        out = scored.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(
            *row, "original_class", "target_class", "distance", "orig", *feats)
    return out


def spread(found: DataFrame, spec: CaseSpec, ctx: S.SearchContext, k: int = 5) -> DataFrame:
    """At most k rows per case, numbered in the order picked (cf_rank)."""
    feats = [c for c in spec.features if c in found.columns]
    out = found.withColumns({"cf_rank": F.lit(0), "__apart": F.lit(float("inf"))})
    for r in range(1, k + 1):
        order = Window.partitionBy(spec.key).orderBy(F.col("cf_rank") > 0, F.desc("__apart"), "distance", "cand")
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumns({"__first": F.row_number().over(order),
                               "__picked": F.first(F.struct(*feats)).over(whole)})
        new = (F.col("__first") == 1) & (F.col("cf_rank") == 0) & (F.col("__apart") > 0)
        out = out.withColumns({"cf_rank": F.when(new, F.lit(r)).otherwise(F.col("cf_rank")),
                               "__apart": F.least("__apart", S.distance(spec, ctx, "__picked"))})
    return out.where("cf_rank > 0").drop("__first", "__picked", "__apart")


def search(cases: DataFrame, spec: CaseSpec, ctx: S.SearchContext, scorer, n_candidates: int = 64, seed: int = 42,
           total_cfs: int = 5, max_varied: int = 3, facts: S.CaseFacts | None = None) -> DataFrame:
    """The search with all flipping candidates of a case thinned and k of
    them spread apart; n_changed counts the features that differ.

    Where the search has its candidates as arrays, they are thinned and
    spread as arrays, too, and only the picked ones become rows; cases
    whose key repeats compete by it, so they go row by row."""
    facts = facts or S.case_facts(cases, spec)
    options = {"n_candidates": n_candidates, "seed": seed, "strict": True, "max_varied": max_varied}
    arrays = S.in_batches(cases, spec, scorer, list(spec.actionable), facts)
    once, rest = (cases, None) if arrays else (None, cases)
    if arrays and facts.repeated:
        often = cases.groupBy(F.col(spec.key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
        same = F.col(spec.key).eqNullSafe(F.col("__key"))
        once, rest = cases.join(often, same, "left_anti"), cases.join(often, same, "left_semi")
    parts = []
    if once is not None:
        parts.append(S.search(once, spec, ctx, scorer, total_cfs=total_cfs, thin=max_varied - 1,
                              facts=S.CaseFacts(facts.rows, False, False), **options))
    if rest is not None:
        pool = S.search(rest, spec, ctx, scorer, total_cfs=n_candidates, facts=facts, **options)
        parts.append(spread(thin(pool, spec, ctx, scorer, max_varied - 1), spec, ctx, total_cfs))
    feats = [c for c in spec.features if c in parts[-1].columns]
    columns = [spec.key, "cand", "original_class", "target_class", "distance", "orig", *feats, "cf_rank"]
    picked = parts[0].select(*columns)
    for part in parts[1:]:
        picked = picked.unionByName(part.select(*columns))
    return picked.withColumn("n_changed", changed(spec, feats))
