"""What keeps a query within limits on large tables: no side of a join at
the driver, texts parsed once, rows read as often as needed and no more."""

from pyspark.sql import functions as F

from lodestar.operators import search as S


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_covered_cases_are_never_broadcast(spark):
    cases = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (None,)], "case_id long")
    found = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (None, 1)], "case_id long, cf_rank int")
    left = S.uncovered(cases, found, "case_id")
    assert sorted(left.collect(), key=str) == [(3,), (3,), (None,)]
    assert "Broadcast" not in executed(left)


def test_clustering_matrix_parses_each_text_once(spark, monkeypatch):
    from lodestar.operators import encode as enc
    from lodestar.plans import context as ctx
    parsed = []
    monkeypatch.setattr(ctx, "kept", lambda df, name, kept=ctx.kept: parsed.append((name, df)) or kept(df, name))
    rows = ctx.parsed_records(spark, "/root/testdata/sf0.001", ctx.RUNS[:1])
    encoder, encoded = ctx.encoded_run(rows, "run-a")
    # the stored sides are structs, and what is made of them reads no text
    assert [n for n, _ in parsed] == ["cases", "parsed"]
    assert "id" not in parsed[-1][1].columns
    assert "json" not in encoded._jdf.queryExecution().optimizedPlan().toString()
    text = ctx.counterfactual_table(spark, "/root/testdata/sf0.001", ctx.RUNS[:1]).drop("original", "counterfactual")
    want, again = ctx.encoded_run(text, "run-a")
    assert (encoder.ranges, encoder.vocabulary) == (want.ranges, want.vocabulary)
    assert sorted(encoded.select("id", "vector").collect()) == sorted(again.select("id", "vector").collect())


def test_read_pairs_is_the_lenient_parse(spark):
    from pyspark.errors import PySparkException
    import pytest
    from lodestar.operators import encode as enc
    texts = [('{"x": 5, "c": "A"}', '{"x": " 7.5 ", "c": null}'), ('{"x": null, "c": " A b"}', '{"x": "1d", "c": 3}'),
             ('{"c": {"y": 1}}', '{"x": "-2e1"}'), ('{"x": [1], "c": "A", "z": 1}', '{}')]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, original_features string, counterfactual_features string")
    by_map = enc.parse_pairs(df)
    read = enc.read_pairs(df, ["x"], ["c"])
    found = [enc.fit_encoder(p, ["x"], ["c"], absent=a) for p, a in ((by_map, False), (read, True))]
    assert found[0].ranges == found[1].ranges == {"x": 27.5} and found[0].vocabulary == found[1].vocabulary
    vectors = [sorted(e.transform(p).select("id", "vector", "tokens").collect()) for e, p in zip(found, (by_map, read))]
    assert vectors[0] == vectors[1]
    # a key that is not there counts for no range, a null that is there counts as 0
    far = spark.createDataFrame([('{"x": 50}', '{"x": 60}'), ('{"c": "A"}', '{"x": 70}')], "original_features string, counterfactual_features string")
    assert enc.fit_encoder(enc.read_pairs(far, ["x"], ["c"]), ["x"], ["c"], absent=True).ranges == {"x": 20.0}
    for bad in ("[1]", "no", None):
        broken = spark.createDataFrame([(bad, "{}")], "original_features string, counterfactual_features string")
        with pytest.raises(PySparkException):
            enc.read_pairs(broken, ["x"], ["c"]).select("o_map", "c_map").collect()


def pairs(spark):
    import math
    from lodestar.operators import encode as enc
    values = [0.0, 1.0, 1.0 + 1e-7, -3.5, math.nan, math.inf, None]
    words = ["A", " A b", "A_b", None, "None", " C"]
    rows = [(i, (values[i % 7], float(i % 3), words[i % 6], "x"), (values[i * 5 % 7], 1.0, words[i * i % 6], "xy"[i % 2])) for i in range(84)]
    side = "struct<n:double,m:double,c:string,d:string>"
    df = enc.typed_pairs(spark.createDataFrame(rows, f"id long, original {side}, counterfactual {side}"))
    return df, enc.fit_encoder(df, ["n", "m"], ["c", "d"])


def same(a, b):
    import numpy as np
    return np.array_equal(np.asarray(a, dtype=float), np.asarray(b, dtype=float), equal_nan=True)


def test_vectors_made_in_tasks_are_the_encoders(spark):
    import numpy as np
    from dataclasses import replace
    df, encoder = pairs(spark)
    rows = encoder.coded()
    points = df.select("id", "o_map", "c_map").withColumns(encoder.side_columns())
    want = {r["id"]: r for r in encoder.transform(df).collect()}
    batch = points.toArrow().combine_chunks().to_batches()[0]
    x, where, table = rows.read([batch.column(c) for c in rows.columns])
    ids = batch.column("id").to_pylist()
    assert len(table) < len(x) and same(np.concatenate([x, table[where]], axis=1), [want[i]["vector"] for i in ids])
    made = {r["id"]: r["vector"] for r in encoder.from_sides(points.drop("o_map", "c_map")).collect()}
    assert all(same(made[i], want[i]["vector"]) for i in ids)
    # stored rows: deltas and the pattern, from which flags and tokens come
    from lodestar.operators import cluster as clu
    centres = [[0.0] * encoder.width, [1.0] * encoder.width]
    stored = clu.assign_coded(points.drop("o_map", "c_map").repartition(3), centres, rows)
    for r in stored.withColumns(rows.fields()).collect():
        w = want[r["id"]]
        assert all(same([r[c]], [w[c]]) for c in encoder.columns()) and r["tokens"] == w["tokens"]
    back = stored.toArrow().combine_chunks().to_batches()[0]
    again = replace(rows, stored=True)
    x, where, table = again.read([back.column(c) for c in again.columns])
    assert same(np.concatenate([x, table[where]], axis=1), [want[i]["vector"] for i in back.column("id").to_pylist()])
    # too large a vocabulary for codes
    assert replace(encoder, vocabulary=[str(i) for i in range(501)]).coded() is None


def test_clusters_of_coded_rows_are_those_of_vectors(spark):
    import numpy as np
    from dataclasses import replace
    from lodestar.operators import cluster as clu
    from lodestar.operators import encode as enc
    finite = " AND ".join(f"coalesce(NOT isnan({s}.n) AND abs({s}.n) < 9, true)" for s in ("o_map", "c_map"))
    df = pairs(spark)[0].where(finite)
    encoder = enc.fit_encoder(df, ["n", "m"], ["c", "d"])
    rows, encoded = encoder.coded(), encoder.transform(df).select("id", "vector").cache()
    points = df.select("id", *[c.alias(n) for n, c in encoder.side_columns().items()]).cache()
    first = clu.initial_centres(encoded, 3)
    assert clu.initial_centres(points, 3, make=encoder.from_sides) == first
    slow, fast = clu.lloyd(encoded, first, 4), clu.lloyd(points, first, 4, rows=rows)
    assert np.allclose(slow.centres, fast.centres, atol=1e-12)
    for n_init in (1, 3):
        a, b = clu.kmeans(encoded, 3, n_init=n_init), clu.kmeans(points, 3, n_init=n_init, rows=rows, make=encoder.from_sides)
        assert a.steps == b.steps and np.allclose(a.centres, b.centres, atol=1e-12)
    a, b = clu.assign(encoded, slow.centres), clu.assign_coded(points, slow.centres, rows)
    key = lambda r: r["id"]
    for u, v in zip(sorted(a.collect(), key=key), sorted(b.collect(), key=key), strict=True):
        assert (u["id"], u["cluster_id"]) == (v["id"], v["cluster_id"]) and abs(u["sq_distance"] - v["sq_distance"]) < 1e-12
    want, got = clu.silhouette(a).first()[0], clu.silhouette(b, rows=replace(rows, stored=True)).first()[0]
    assert abs(want - got) < 1e-12


def test_distillation_makes_no_vectors(spark, monkeypatch):
    from lodestar.operators import cluster as clu
    from lodestar.plans import context as ctx
    read = []
    monkeypatch.setattr(clu.Vectors, "read", lambda *a: read.append(a) or 1 / 0)
    monkeypatch.setattr(clu, "_matrix", lambda *a: read.append(a) or 1 / 0)
    d = ctx.distilled(spark, "/root/testdata/sf0.001", ctx.RUNS[:1])
    assert d["rules"].count() == ctx.K
    assert d["readers"]["run-a"].stored
    assert ctx.silhouettes(d["labelled"], ctx.RUNS[:1], d["readers"]).count() == 1 and not read


def test_first_centres_make_vectors_of_the_list_only(spark):
    from lodestar.operators import cluster as clu
    points = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("v"))
    made = []

    def make(df):
        made.append(df.count())
        return df.withColumn("vector", F.array("v"))

    assert clu.initial_centres(points, 3, make=make) == clu.initial_centres(make(points), 3)
    assert made[0] == 3 * clu.FIRST_POINTS


def test_signatures_make_no_value_text(spark):
    from lodestar.operators import explore
    rows = [((1.0, "a", None), (1.0, "b", 2)), ((2.0, "a", None), (3.0, "a", None)), ((None, "a", 1), (None, None, 1))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "id long, original struct<n:double,c:string,x:long>, counterfactual struct<n:double,c:string,y:long>")
    got = df.select("id", explore.signature(df).alias("s"))
    assert [r["s"] for r in sorted(got.collect())] == [["c", "y"], ["n"], ["c", "x", "y"]]
    want = df.select("id", F.transform(explore._changes(df, union_keys=True), lambda x: x["feature"]).alias("s"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert "decimal" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_store_is_written_with_zstd(spark, tmp_path):
    import glob
    from lodestar.sources import store
    df = spark.createDataFrame([(1, "m", "r")], "id long, model_name string, run_id string")
    store.append(df, str(tmp_path), "a")
    store.replace_run(df, str(tmp_path), "b")
    for table in "ab":
        (file,) = glob.glob(f"{tmp_path}/{table}/**/*.parquet", recursive=True)
        assert file.endswith(".zstd.parquet")
        assert store.read(spark, str(tmp_path), table).count() == 1
