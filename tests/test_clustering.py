"""K-Means from many starts and the Euclidean silhouette, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import cluster as clu

SMALL = "/root/testdata/sf0.001"


def points(spark, x, partitions=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                                 "id long, vector array<double>").repartition(partitions)


def blobs(n=240, k=4, seed=1):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=(n // k, 3)) * 0.2 + rng.normal(size=3) * 4 for _ in range(k)])


def plain_lloyd(x, centres, steps=300):
    for _ in range(steps):
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        moved = np.array([x[at == j].mean(axis=0) if (at == j).any() else centres[j] for j in range(len(centres))])
        if np.allclose(moved, centres, atol=1e-12):
            break
        centres = moved
    return centres, ((x - moved[at]) ** 2).sum()


def test_all_starts_equal_plain_lloyd_from_their_seeds(spark):
    x = blobs()
    starts = [(3, 1), (4, 2), (4, 3), (6, 4)]
    many = clu.Restarts(points(spark, x), starts)
    seeds = many.seeds()
    assert [len(s) for s in seeds] == [3, 4, 4, 6]
    for s in seeds:
        assert all((x == c).all(axis=1).any() for c in s) and len({tuple(c) for c in s}) == len(s)
    for s, (cost, fit) in zip(seeds, many.fit()):
        centres, inertia = plain_lloyd(x, s)
        assert fit.converged and np.allclose(fit.centres, centres) and cost == pytest.approx(inertia)


def test_best_start_finds_the_blobs(spark):
    x = blobs()
    fit = clu.kmeans(points(spark, x), 4, n_init=5)
    got = clu.assign(points(spark, x), fit.centres)
    sizes = sorted(r["count"] for r in got.groupBy("cluster_id").count().collect())
    assert sizes == [60, 60, 60, 60]
    truth = sum(((x[i:i + 60] - x[i:i + 60].mean(axis=0)) ** 2).sum() for i in range(0, 240, 60))
    assert clu.inertia(got).first()[0] == pytest.approx(truth)


def test_seeds_do_not_depend_on_partitions(spark):
    x = blobs(seed=7)
    a, b = (clu.Restarts(points(spark, x, p), [(4, 5), (5, 6)]).seeds() for p in (1, 6))
    assert all(np.array_equal(s, t) for s, t in zip(a, b))


def test_seeding_beats_hash_order_on_uneven_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 2)) * 0.05, *[np.full((4, 2), 5.0 * j) + rng.normal(size=(4, 2)) * 0.05
                                                            for j in range(1, 6)]])
    df = points(spark, x)
    good = sum(cost for cost, _ in clu.Restarts(df, [(6, s) for s in range(4)]).fit())
    plain = 0.0
    for s in range(4):
        fit = clu.lloyd(df, clu.initial_centres(df, 6, seed=s))
        plain += clu.inertia(clu.assign(df, fit.centres)).first()[0]
    assert good < plain


def test_few_distinct_points(spark):
    x = [[0.0, 0.0]] * 40 + [[1.0, 0.0]] * 3 + [[0.0, 2.0]]
    (cost, fit), = clu.Restarts(points(spark, x), [(3, 1)]).fit()
    assert cost == 0.0 and sorted(map(tuple, fit.centres)) == [(0.0, 0.0), (0.0, 2.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        clu.kmeans(points(spark, x), 4)
    with pytest.raises(ValueError):
        clu.kmeans(points(spark, x), 1)
    with pytest.raises(ValueError):
        clu.kmeans(points(spark, x[:2]), 3)


def plain_silhouette(x, labels):
    out = []
    for i, c in enumerate(labels):
        d = {k: [math.dist(x[i], x[j]) for j in range(len(x)) if j != i and labels[j] == k] for k in set(labels)}
        if not d[c]:
            out.append(0.0)
            continue
        a, b = np.mean(d[c]), min(np.mean(v) for k, v in d.items() if k != c)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


def labelled(spark, x, labels, partitions=3):
    return spark.createDataFrame([([float(v) for v in r], int(c)) for r, c in zip(x, labels)],
                                 "vector array<double>, cluster_id int").repartition(partitions)


def test_six_row_fixture(spark):
    x = [[5 / 7, 0.0, 0, 0, 0], [6 / 7, 0.0, 0, 0, 0], [1.0, 0.0, 0, 0, 0], [0.0, 0.5, 1, 1, 1], [0.0, 0.75, 1, 1, 1],
         [0.0, 1.0, 1, 1, 1]]
    got = clu.euclidean_silhouette(labelled(spark, x, [0, 0, 0, 1, 1, 1])).first()[0]
    assert got == pytest.approx(plain_silhouette(x, [0, 0, 0, 1, 1, 1]))


def test_euclidean_silhouette(spark, monkeypatch):
    monkeypatch.setattr(clu, "TILE_ROWS", 16)
    monkeypatch.setattr(clu, "LOT_TILES", 2)
    rng = np.random.default_rng(4)
    x = np.concatenate([blobs(120, 4, 9), [[50.0, 1.0, 1.0]], np.zeros((5, 3)), np.zeros((3, 3))])
    labels = [*rng.integers(0, 4, 120).tolist(), 9, *[2] * 5, *[3] * 3]
    got = clu.euclidean_silhouette(labelled(spark, x, labels)).first()[0]
    assert got == pytest.approx(plain_silhouette(x, labels), abs=1e-7)
    assert math.isnan(clu.euclidean_silhouette(labelled(spark, x, [1] * len(x))).first()[0])
    same = clu.euclidean_silhouette(labelled(spark, np.ones((6, 2)), [0, 0, 0, 1, 1, 1])).first()[0]
    assert same == 0.0


def test_sweep_fits_every_k_at_once(spark):
    df = points(spark, blobs()).cache()
    rows = {r.k: r for r in clu.k_sweep(df, range(2, 6), n_init=3).collect()}
    assert sorted(rows) == [2, 3, 4, 5]
    assert max(rows.values(), key=lambda r: r.silhouette).k == 4
    assert rows[4].min_size == rows[4].max_size == 60
    assert rows[2].inertia > rows[3].inertia > rows[4].inertia > rows[5].inertia
    got = clu.assign(df, clu.best_of_k(df, [3], n_init=3)[3].centres)
    assert got.agg(F.sum("sq_distance")).first()[0] == pytest.approx(rows[3].inertia)
