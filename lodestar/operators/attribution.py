"""Feature attributions (SHAP) as DataFrame jobs.

* H2 linear SHAP: phi_i = w_i (x_i - mean_i), background means from one
  aggregate pass.
* H1 tree SHAP for tree models: exact and path-dependent, looked up on
  Arrow batches in tables of each leaf's values.
* H3 model-agnostic sampled-permutation Shapley: (case, permutation,
  prefix) rows scored in one batch and averaged per (case, feature).
* H6 every explainer emits the long form (case, feature, value, shap).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lodestar.functions.columns import uniform_draws
from lodestar.operators.scoring import Scorecard

SHAP_SCHEMA = "instance_id bigint, feature_name string, feature_value double, shap_value double"


def background_means(background: DataFrame, scorecard: Scorecard) -> dict:
    """Mean encoded value of every scorecard feature (one aggregate)."""
    dummies = scorecard.dummies()
    row = background.agg(*[F.avg(c).alias(f"m{i}") for i, (_, c) in enumerate(dummies)]).first()
    return {name: float(row[f"m{i}"] or 0.0) for i, (name, _) in enumerate(dummies)}


def base_value(scorecard: Scorecard, means: dict) -> float:
    """H5 for the linear explainer: f(E[x]) on the margin scale."""
    z = float(scorecard.intercept)
    for c, w, center in scorecard.numeric:
        z += float(w) * (means[c] - float(center))
    for c, values in scorecard.categorical:
        for v, w in values:
            z += float(w) * means[f"{c}_{v}"]
    return z


def linear_shap(cases: DataFrame, scorecard: Scorecard, means: dict, key: str = "case_id") -> DataFrame:
    """H2 + H6: long rows (instance_id, feature_name, feature_value, shap_value)."""
    weights = dict(scorecard.weights())
    entries = []
    for name, value in scorecard.dummies():
        entries.append(F.struct(F.lit(name).alias("feature_name"), value.alias("feature_value"),
                                (F.lit(weights[name]) * (value - F.lit(means[name]))).alias("shap_value")))
    return (cases.select(F.col(key).alias("instance_id"), F.explode(F.array(*entries)).alias("e"))
            .select("instance_id", "e.feature_name", "e.feature_value", "e.shap_value"))


def class_output(shap: DataFrame, class_index: int, n_outputs: int = 2) -> DataFrame:
    """H4: one class output of a binary explainer. The long form explains
    class 1; class 0 has the opposite contributions. An index outside the
    outputs, or an explainer of another width, is an error."""
    if n_outputs != 2:
        raise ValueError(f"expected 2 class outputs, found {n_outputs}")
    if not 0 <= class_index < n_outputs:
        raise ValueError(f"class index {class_index} outside 0..{n_outputs - 1}")
    return shap if class_index == 1 else shap.withColumn("shap_value", -F.col("shap_value"))


# --------------------------------------------------------------------------
# H3: sampled-permutation Shapley for any scorer.
# --------------------------------------------------------------------------

def permutation_shap(cases: DataFrame, background: DataFrame, scorer, features: list[str],
                     n_permutations: int = 8, seed: int = 42, key: str = "case_id",
                     output: str = "p1", background_key: str = "case_id") -> DataFrame:
    """H3: Shapley values by sampled permutations against one background row.

    For case x, permutation pi and reference row r (a background row
    drawn per permutation), the coalition after step j takes features
    pi[0..j] from x and the rest from r. Marginal of pi[j] =
    f(step j) - f(step j-1). All (case, permutation, step) rows are
    scored in one distributed batch, then averaged per (case, feature).
    The background is the caller's reference table, used whole: numbered
    in hash order and joined by number (pass a sample of it where a model
    is explained against few rows). H6: feature_value is the value as a
    double, null for text.
    """
    from pyspark.sql.window import Window
    d = len(features)
    types = {f.name: f.dataType for f in cases.schema.fields}
    if background_key not in background.columns:
        raise ValueError(f"background needs a key column {background_key!r}")
    bg = (background.withColumn("__u", uniform_draws([background_key, seed, 4], 1)[0])
          .select(*[F.col(c).alias(f"bg__{c}") for c in features], "__u", F.col(background_key).alias("__bk")))
    bg = bg.withColumn("bg_idx", F.row_number().over(Window.orderBy("__u", "__bk"))).drop("__u", "__bk")
    n_bg = bg.count()
    if n_bg == 0:
        raise ValueError("empty background")
    perms = cases.select(F.col(key), *features).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
    draws = uniform_draws([key, "perm", seed], d + 1)
    perms = perms.withColumn("bg_idx", (F.floor(draws[0] * F.lit(n_bg)) + 1).cast("int"))
    # permutation order = features sorted by their draw
    order = F.array_sort(F.array(*[F.struct(draws[i + 1].alias("u"), F.lit(i).alias("i")) for i in range(d)]))
    perms = perms.withColumn("order", F.transform(order, lambda s: s["i"]))
    perms = perms.join(bg, "bg_idx", "inner")
    steps = perms.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    # feature i is taken from x when its position in the order is < step
    pos = {i: F.array_position(F.col("order"), F.lit(i)) - 1 for i in range(d)}
    values = F.array(*[F.col(c).cast("double") if isinstance(types[c], NumericType) else F.lit(None).cast("double")
                       for c in features]).alias("values")
    mixed = steps.select(key, "perm", "step", "order", values,
                         *[F.when(pos[i] < F.col("step"), F.col(c)).otherwise(F.col(f"bg__{c}")).alias(c)
                           for i, c in enumerate(features)])
    scored = scorer.score(mixed).select(key, "perm", "step", "order", "values", F.col(output).alias("f"))
    w = Window.partitionBy(key, "perm").orderBy("step")
    marg = (scored.withColumn("prev", F.lag("f").over(w)).filter(F.col("step") > 0)
            .withColumn("feature_idx", F.element_at("order", F.col("step")))
            .withColumn("feature_value", F.element_at("values", F.col("feature_idx") + 1))
            .withColumn("marginal", F.col("f") - F.col("prev")))
    names = F.array(*[F.lit(c) for c in features])
    return (marg.groupBy(key, "feature_idx").agg(F.avg("marginal").alias("shap_value"),
                                                 F.max("feature_value").alias("feature_value"))
            .select(F.col(key).alias("instance_id"), F.element_at(names, F.col("feature_idx") + 1).alias("feature_name"),
                    "feature_value", "shap_value"))


# --------------------------------------------------------------------------
# H1: exact path-dependent tree SHAP as a DataFrame job.
# --------------------------------------------------------------------------

def _leaf_paths_from_nodes(nodes) -> list[dict]:
    """Turn one tree's node list into leaf paths with per-feature
    (lo, hi, z) where z is the product of cover fractions of the splits
    on that feature along the path."""
    by_id = {n["id"]: n for n in nodes}
    out = []

    def walk(nid, bounds, zs, order):
        n = by_id[nid]
        if n["left"] < 0:
            out.append({"value": n["value"], "path": [(f, bounds[f][0], bounds[f][1], zs[f]) for f in order]})
            return
        f, thr, cover = n["feature"], n["threshold"], n["cover"]
        for child, lo_hi in ((n["left"], (None, thr)), (n["right"], (thr, None))):
            c = by_id[child]
            frac = c["cover"] / cover if cover > 0 else 0.0
            b = dict(bounds)
            lo, hi = b.get(f, (-math.inf, math.inf))
            if lo_hi[1] is not None:
                hi = min(hi, lo_hi[1])
            else:
                lo = max(lo, lo_hi[0])
            b[f] = (lo, hi)
            z = dict(zs)
            z[f] = z.get(f, 1.0) * frac
            walk(child, b, z, order if f in order else order + [f])

    walk(0, {}, {}, [])
    return out


def _shapley_weights(d: int) -> list[float]:
    return [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]


def _leaf_groups(leaves: list[dict]) -> list[tuple]:
    """Leaves by path length as packed arrays (features, lo, hi, z,
    weight * value)."""
    import numpy as np
    by_depth: dict = {}
    for leaf in leaves:
        if leaf["path"]:
            by_depth.setdefault(len(leaf["path"]), []).append(leaf)
    out = []
    for _, group in sorted(by_depth.items()):
        parts = [np.array([[p[i] for p in leaf["path"]] for leaf in group]) for i in range(4)]
        out.append((parts[0].astype(int), *parts[1:], np.array([leaf["weight"] * leaf["value"] for leaf in group])))
    return out


# Rows x leaves that are expanded at once.
SHAP_ROWS, SHAP_LEAVES = 256, 64


def _add_phi(phi, X, feats, lo, hi, z, value) -> None:
    """Add the exact path-dependent SHAP of leaves of one path length for
    a batch of rows to ``phi`` (rows x features)."""
    import numpy as np
    n, d = X.shape[0], feats.shape[1]
    xv = X[:, feats]  # rows x leaves x path
    o = ((xv > lo) & (xv <= hi)).astype(float)
    # coefficients of prod_j (z_j + o_j t), lowest degree first
    poly = np.zeros((n, feats.shape[0], d + 1))
    poly[:, :, 0] = 1.0
    for j in range(d):
        step = poly * z[None, :, j, None]
        step[:, :, 1:] += poly[:, :, :-1] * o[:, :, j, None]
        poly = step
    w = np.array(_shapley_weights(d))
    for i in range(d):
        zi, on = z[:, i], o[:, :, i] != 0
        # without factor i: o_i = 1 divides from the top, o_i = 0 by z_i
        top = np.zeros_like(poly)
        for k in range(d, 0, -1):
            top[:, :, k - 1] = poly[:, :, k] - (top[:, :, k] * zi if k < d else 0.0)
        low = np.divide(poly, zi[None, :, None], out=np.zeros_like(poly), where=zi[None, :, None] != 0)
        q = np.where(on[:, :, None], top[:, :, :d], low[:, :, :d])
        part = value * (o[:, :, i] - zi) * (q @ w)
        np.add.at(phi.T, feats[:, i], part.T)


# Paths of up to so many features are tabulated; rows and table cells at once.
TABLE_DEPTH, TABLE_ROWS, TABLE_CELLS = 12, 1 << 13, 1 << 21
# Rows that share the tables of a task.
SHARED_ROWS = 1 << 16


def _shap_tables(z, value):
    """SHAP of leaves of one path length d (``z``: leaves x d) for each set
    of conditions that can hold along the path: leaves x d x 2^d, bit i of
    the set for position i.

    The Shapley weight k! (d-1-k)! / d! is the integral of s^k (1-s)^(d-1-k)
    over [0, 1], so position i has v (o_i - z_i) times the integral of the
    product of z_j (1-s) + o_j s over the others, of degree d - 1: a Gauss
    rule of d / 2 points is exact."""
    import numpy as np
    n, d = z.shape
    s, w = np.polynomial.legendre.leggauss((d + 1) // 2)
    s, w = (s + 1.0) / 2.0, w / 2.0
    off = z[:, :, None] * (1.0 - s)
    on = off + s
    prod = np.ones((n, 1, len(s)))
    for j in range(d):
        prod = np.concatenate([prod * off[:, None, j], prod * on[:, None, j]], axis=1)
    # z_i times the product without factor i is the whole one by 1 - s
    out = np.empty((n, d, 1 << d))
    without = -value[:, None] * (prod @ (w / (1.0 - s)))
    for i in range(d):
        held = (prod @ (w / on[:, i])[:, :, None])[:, :, 0] * (value * (1.0 - z[:, i]))[:, None]
        out[:, i] = np.where((np.arange(1 << d) >> i) & 1, held, without)
    return out


def _add_tabulated(phi, ranks, feats, lo, hi, z, value) -> None:
    """``_add_phi`` by tables, for ``phi`` and ``ranks`` as features x rows.
    ``lo`` and ``hi`` are ranks of thresholds."""
    import numpy as np
    n, d = phi.shape[1], feats.shape[1]
    step = max(1, TABLE_CELLS // ((2 * d) << d))
    for c in range(0, len(value), step):
        some = slice(c, c + step)
        tables = _shap_tables(z[some], value[some])
        paths = list(zip(feats[some].tolist(), lo[some].tolist(), hi[some].tolist(), tables))
        for r in range(0, n, TABLE_ROWS):
            rows = slice(r, r + TABLE_ROWS)
            part = ranks[:, rows]
            total, found = phi[:, rows], np.empty(part.shape[1])
            for fs, los, his, table in paths:
                code = np.zeros(part.shape[1], dtype=np.intp)
                # eight conditions make a byte
                for o in range(0, d, 8):
                    byte = np.zeros(part.shape[1], dtype=np.uint8)
                    for j in range(min(d, o + 8) - 1, o - 1, -1):
                        x = part[fs[j]]
                        byte += byte
                        byte |= (x > los[j]) & (x <= his[j])
                    code += byte if not o else byte.astype(np.intp) << o
                for f, column in zip(fs, table):
                    total[f] += np.take(column, code, out=found, mode="clip")


def _ranked(groups: list[tuple], n_features: int) -> tuple[list, list]:
    """(thresholds per feature, groups with ranks of thresholds for
    bounds): x > lo and x <= hi hold for a value if they do for the number
    of thresholds below it."""
    import numpy as np
    seen: list[set] = [set() for _ in range(n_features)]
    for feats, lo, hi, _, _ in groups:
        for bound in (lo, hi):
            for f, t in set(zip(feats.ravel().tolist(), bound.ravel().tolist())):
                seen[f].add(t)
    cuts = [np.array(sorted(t for t in ts if math.isfinite(t))) for ts in seen]
    out = []
    for feats, lo, hi, z, value in groups:
        at = [np.empty(feats.shape, dtype=np.int64) for _ in range(2)]
        for f in np.unique(feats):
            mine = feats == f
            # of no bound: above all ranks, or below
            at[0][mine] = np.where(np.isinf(lo[mine]), -1, np.searchsorted(cuts[f], lo[mine]))
            at[1][mine] = np.where(np.isinf(hi[mine]), len(cuts[f]), np.searchsorted(cuts[f], hi[mine]))
        out.append((feats, *at, z, value))
    return cuts, out


def _value_ranks(X, cuts: list):
    """Features x rows: how many thresholds are below each value; -1 where
    no condition holds (NaN, minus infinity)."""
    import numpy as np
    kind = np.int8 if max((len(c) for c in cuts), default=0) < 127 else np.int32
    out = np.empty((len(cuts), len(X)), dtype=kind)
    for f, c in enumerate(cuts):
        x = X[:, f]
        out[f] = np.where(x > -math.inf, np.searchsorted(c, x, side="left"), -1)
    return out


def tree_shap(cases: DataFrame, leaves: list[dict], feature_names: list[str], vector_col: str = "features",
              key: str = "case_id") -> DataFrame:
    """H1 + H6: exact path-dependent tree SHAP, long form.

    The leaf paths are model-sized (independent of the data) and travel
    as one broadcast of packed arrays; rows stream through ``mapInArrow``.
    A leaf's values depend on a row only by which conditions of its path
    hold, so they are tabulated once for ``SHARED_ROWS`` rows and looked
    up; for paths too long for that the closed-form polynomial is
    evaluated for many rows and leaves of one length at a time.
    Output is long (instance, feature, value, shap).
    """
    import numpy as np
    import pyarrow as pa
    n_features = len(feature_names)
    names = pa.array(list(feature_names), pa.string())
    groups = _leaf_groups(leaves)
    cuts, short = _ranked([g for g in groups if g[0].shape[1] <= TABLE_DEPTH], n_features)
    shared = cases.sparkSession.sparkContext.broadcast((cuts, short, [g for g in groups if g[0].shape[1] > TABLE_DEPTH]))

    def explained(keys, X):
        cuts, short, long = shared.value
        phi = np.zeros((n_features, len(X)))
        ranks = _value_ranks(X, cuts)
        for group in short:
            _add_tabulated(phi, ranks, *group)
        phi = np.ascontiguousarray(phi.T)
        for r in range(0, len(X) if long else 0, SHAP_ROWS):
            rows = slice(r, r + SHAP_ROWS)
            for feats, lo, hi, z, value in long:
                for c in range(0, len(value), SHAP_LEAVES):
                    part = slice(c, c + SHAP_LEAVES)
                    _add_phi(phi[rows], X[rows], feats[part], lo[part], hi[part], z[part], value[part])
        for r in range(0, len(X), TABLE_ROWS):
            rows = slice(r, r + TABLE_ROWS)
            n = len(X[rows])
            yield pa.RecordBatch.from_arrays([
                keys[rows].take(pa.array(np.repeat(np.arange(n), n_features))),
                names.take(pa.array(np.tile(np.arange(n_features), n))),
                pa.array(X[rows].reshape(-1)), pa.array(phi[rows].reshape(-1))],
                names=["instance_id", "feature_name", "feature_value", "shap_value"])

    def run(batches):
        keys, parts, held = [], [], 0
        for batch in batches:
            if batch.num_rows:
                keys.append(batch.column(0))
                parts.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                held += batch.num_rows
            if held >= SHARED_ROWS:
                yield from explained(pa.concat_arrays(keys), np.concatenate(parts))
                keys, parts, held = [], [], 0
        if held:
            yield from explained(pa.concat_arrays(keys), np.concatenate(parts))

    cases = cases.select(F.col(key).cast("bigint"), F.col(vector_col).cast("array<double>"))
    # a row is much work for its size
    cores = cases.sparkSession.sparkContext.defaultParallelism
    if cases.rdd.getNumPartitions() < cores:
        cases = cases.repartition(cores)
    return cases.mapInArrow(run, SHAP_SCHEMA)


def leaf_paths(trees: list[tuple[float, list[dict]]]) -> list[dict]:
    """Flatten [(tree_weight, nodes)] into leaf dicts (weight, value, path)."""
    out = []
    for tw, nodes in trees:
        for p in _leaf_paths_from_nodes(nodes):
            out.append({"weight": float(tw), "value": float(p["value"]),
                        "path": [(int(f), float(lo), float(hi), float(zz)) for f, lo, hi, zz in p["path"]]})
    return out


def tree_base(leaves: list[dict]) -> float:
    """H5 for trees: sum over leaves of w * v * prod z."""
    total = 0.0
    for leaf in leaves:
        prod = 1.0
        for _, _, _, zz in leaf["path"]:
            prod *= zz
        total += leaf["weight"] * leaf["value"] * prod
    return total


