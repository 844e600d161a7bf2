import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strataspan.functions.scripts import dominant_script, length_bucket, script_counts
from strataspan.functions.strings import distances, mean_similarity
from strataspan.operators import controls, curves, density, manifests, orthography, outputs, partitions, schedule, spectrum, texts
from strataspan.plans.identity import Task, stable_hash
from strataspan.sources.store import RunPolicy, Store

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows_of(frame):
    def cell(v):
        if v is None or isinstance(v, float) and v != v or str(v) == "<NA>":
            return "null"
        return repr(float(v) + 0.0) if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.CORE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = entry.CORE_QUERIES[name](spark, sf).toPandas(), duck.execute(entry.CORE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", ["os_cluster_sampled", "projection_rho"])
def test_query_without_sql_runs(spark, sf, name):
    assert entry.CORE_QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1 and set(entry.oracle_sql()) <= set(entry.queries())


# ---- strings and scripts


@pytest.mark.parametrize("x, y, d", [
    ("shoulder", "shoulders", 1 / 9), ("shoulder", "Schulter", 0.375), ("shoulders", "Schulter", 4 / 9), ("abc", "abd", 1 / 6), ("ab", "ba", 1), ("Straße", "STRASSE", 0), ("", "a", 1), ("", "", 0)])
def test_distance_goldens(x, y, d):
    assert distances([x, y], [y, x]) == pytest.approx([d, d])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=6), st.text("abc", max_size=6)), min_size=1, max_size=5))
def test_distance_is_symmetric_and_bounded(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    d = distances(a, b)
    assert (d == distances(b, a)).all() and ((0 <= d) & (d <= 1)).all() and (distances(a, a) == 0).all()


def test_mean_similarity_and_subsamples():
    assert mean_similarity(["shoulder", "shoulders", "Schulter"]) == pytest.approx(0.6898148148)
    many = [f"token{k}" for k in range(513)]
    assert orthography.replayable_score(many) == orthography.replayable_score(many[::-1])
    with pytest.raises(ValueError):
        orthography.replayable_score(["one"])


def test_scripts(spark):
    words = [("shoulder", "Latin"), ("肩", "Han"), ("плеч", "Cyrillic"), ("a1", "Latin"), ("aй", "Mixed"), ("1 ", "Other"), ("", "Other"), (None, "Other")]
    df = spark.createDataFrame(words, "t string, want string")
    assert df.where(~dominant_script(F.col("t")).eqNullSafe(F.col("want"))).count() == 0
    assert df.where("t = 'a1'").select(script_counts(F.col("t"))).first()[0] == [("Latin", 1), ("Other", 1)]
    got = [r[0] for r in spark.createDataFrame([("", 0), ("ab", 1), ("abc", 2), ("abcde", 3), ("abcdef", 4), ("a" * 10, 5), ("a" * 11, 6)], "t string, k int").orderBy("k").select(length_bucket(F.col("t"))).collect()]
    assert got == ["1-2", "1-2", "3-5", "3-5", "6-10", "6-10", "11+"]


# ---- spectrum


def test_elbows_and_smoothing():
    assert spectrum.select_elbows(np.array([0, 5, 0, 4, 0, 3, 0.0]), 2, 3) == [1, 5]
    assert spectrum.select_elbows(np.array([0, 5, 0, 4, 0.0]), 0, 1) == []
    assert np.diff([0, 1, 4, 9, 16], 2).tolist() == [2, 2, 2]
    y = np.arange(20.0) ** 2
    assert np.allclose(spectrum.savitzky_golay(y, 7, 2), y)
    assert spectrum.savitzky_golay(np.array([1.0, 2.0]), 7, 2).tolist() == [1, 2]
    assert spectrum.peaks(np.array([0, 1, 1, 1, 0, 2, 1])).tolist() == [2, 5]
    assert spectrum.peaks(np.array([0, 5, 4, 4.5, 0, 3, 2.9, 3.2, 0]), 1.0).tolist() == [1, 7] and spectrum.savitzky_golay(y, 40, 2).shape == y.shape
    with pytest.raises(ValueError):
        spectrum.select_elbows(np.zeros(3), -1, 0)


def test_thresholds_clamp_and_check(spark):
    s = spark.createDataFrame([(k, k + 1, v**0.5, v) for k, v in enumerate((4.0, 3.0, 2.0, 1.0))], "idx int, scale int, value double, energy double")
    got = {r["threshold"]: r["scale"] for r in spectrum.at_thresholds(s, (0.35, 0.6, 0.85, 0.95)).collect()}
    assert got == {0.35: 1, 0.6: 2, 0.85: 3, 0.95: 4}
    with pytest.raises(ValueError):
        spectrum.at_thresholds(s, (0.5, 0.5))
    assert {r["scale"]: r["sources"] for r in spectrum.candidate_scales(s, 4, (0.35, 0.6), (2, 3), True).collect()} == {1: "energy", 2: "energy;manual", 3: "manual", 4: "full_dimension"}
    for kind in ({"manual": (9,)}, {"include_full": True}):
        with pytest.raises(Exception, match="not on the axis"):
            spectrum.candidate_scales(s, 5, **kind).collect()
    with pytest.raises(ValueError):
        spectrum.candidate_scales(s, 4, combine="all")


def test_projections(spark, sf):
    rows = spectrum.matrix(spark, sf)
    x = np.array([r["features"] for r in rows.orderBy("row_id").collect()], float)
    s = spectrum.singular_values(spark, sf).toPandas()
    assert np.allclose(s.singular_value, np.linalg.svd(x, compute_uv=False), atol=1e-6)
    pca = np.array([r["scores"] for r in spectrum.full_pca_scores(spark, sf).orderBy("row_id").collect()])
    assert np.allclose(np.linalg.norm(pca, axis=1), np.linalg.norm(x - x.mean(0), axis=1))
    low = np.array([r["scores"] for r in spectrum.randomized_pca_scores(spark, sf).orderBy("row_id").collect()])
    best = pca[:, :16].var(0).sum()
    assert low.shape[1] == 16 and 0.85 * best <= low.var(0).sum() <= best * (1 + 1e-9)
    q = spectrum.orthogonal_basis(20, 3)
    assert np.allclose(q.T @ q, np.eye(20))
    y = np.array([r["scores"] for r in spectrum.random_projection_scores(spark, sf).orderBy("row_id").collect()])
    assert np.allclose(((y[:50, None] - y[None, :50]) ** 2).sum(-1), ((x[:50, None] - x[None, :50]) ** 2).sum(-1), atol=1e-9)


# ---- statistics


def test_curve_goldens(spark):
    pairs = spark.createDataFrame([("same", k, float(r), float(t)) for k, r, t in zip((2, 4, 8, 16), (1, 2, 3, 4), (1, 2, 4, 3))] + [("far", k, float(r), float(t)) for k, r, t in zip((2, 4, 8, 16), (1, 2, 3, 4), (2, 4, 8, 6))]
                                  + [("flat", k, 1.0, float(k)) for k in (2, 4)], "p string, scale int, r double, t double")
    got = {r["p"]: r for r in curves.pair_statistics(pairs, ["p"]).collect()}
    assert got["same"]["mae"] == 0.5 and got["same"]["r2"] == pytest.approx(0.6) and got["same"]["pearson"] == pytest.approx(0.8) and got["same"]["spearman"] == pytest.approx(0.8)
    assert got["far"]["mae"] == 2.5 and got["far"]["r2"] == pytest.approx(-5.8)
    assert got["flat"]["pearson"] is None and got["flat"]["r2"] is None


def test_alignment(spark):
    a = spark.createDataFrame([(2, 1.0), (4, 2.0)], "scale int, value double")
    b = spark.createDataFrame([(2, 1.0), (4, 2.0), (8, 3.0)], "scale int, value double")
    assert curves.align(a, b, "intersection").count() == 2 and curves.unmatched(a, b).collect() == [(8, "target")]
    assert curves.align(a, b, "reference").orderBy("scale").collect() == [(2, 1.0, 1.0), (4, 2.0, 2.0)] == curves.align(a, a, "exact").orderBy("scale").collect()
    for x, y, how in ((b, a, "reference"), (a, b, "exact"), (b, a, "exact"), (a.union(a), b, "intersection")):
        with pytest.raises(Exception, match="lacks width 8|width twice"):
            curves.align(x, y, how).collect()
    with pytest.raises(ValueError):
        curves.align(a, b.where("scale = 8"), "intersection")
    with pytest.raises(ValueError):
        curves.align(a, b, "nearest")


def test_a_query_means_one_curve(spark):
    rows = [("s", "m", "e", "mean", None, 2, 1.0), ("s", "m", "e", "mean", None, 4, 2.0), ("s", "m", "e", "mean", 1, 2, 3.0), ("u", "m", "e", "mean", 1, 2, 3.0), ("s", "m", "f", "mean", None, 2, 1.0), ("s", "m", "f", "mean", None, 2, 5.0)]
    m = spark.createDataFrame(rows, "space_name string, partition_method string, metric string, aggregation string, seed long, scale int, value double")
    assert curves.strict_curve(m, "e", "mean").orderBy("scale").collect() == [(2, 1.0), (4, 2.0)]
    for args, what in ((("g", "mean"), "no curve"), (("e", "mean", 1), "ambiguous"), (("f", "mean"), "twice")):
        with pytest.raises(Exception, match=what):
            curves.strict_curve(m, *args).collect()
    key = ["metric", "aggregation"]
    assert manifests.exactly_one(m.where("metric = 'e' AND seed IS NULL"), F.col("scale") == 4, key).first()["value"] == 2.0
    for df, c in ((m.where("metric = 'f'"), F.col("scale") == 2), (m.where("metric = 'e'"), F.col("scale") == 8)):
        with pytest.raises(Exception, match="not one row"):
            manifests.exactly_one(df, c, key).collect()
    with pytest.raises(Exception, match="found twice"):
        manifests.united([m, m], ["metric", "scale"]).collect()
    flags = spark.createDataFrame([(" True ",), ("FALSE",)], "t string")
    assert [r[0] for r in flags.select(manifests.boolean(F.col("t"))).collect()] == [True, False]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("1",)], "t string").select(manifests.boolean(F.col("t"))).collect()


def test_permutation_p_by_all_orders(spark):
    import itertools

    rng = np.random.default_rng(4)
    shapes = {"a": rng.random((6, 2)), "b": rng.random((6, 2))}, {"a": rng.random((6, 2)), "b": np.ones((6, 2))}
    rows = [(g, k, f"f{f}", float(r[g][k, f]), float(t[g][k, f])) for r, t in [shapes] for g in r for k in range(6) for f in range(2)]
    df = spark.createDataFrame(rows, "g string, scale int, feature string, r double, t double")
    got = {r["g"]: r for r in curves.permutation_pvalues(df, ["g"], 20_000).collect()}
    rank = lambda m: np.array(__import__("pandas").Series(m.reshape(-1)).rank())
    r, t = shapes[0]["a"], shapes[1]["a"]
    observed = abs(np.corrcoef(rank(r), rank(t))[0, 1])
    every = [abs(np.corrcoef(rank(r), rank(t[list(p)]))[0, 1]) >= observed - 1e-12 for p in itertools.permutations(range(6))]
    assert got["a"]["p"] == pytest.approx(np.mean(every), abs=0.01) and got["a"]["n_draws"] == 20_000
    assert got["b"]["p"] is None  # a constant target
    again = curves.permutation_pvalues(df.repartition(3), ["g"], 20_000).where("g = 'a'").first()["p"]
    assert again == got["a"]["p"] and curves.permutation_pvalues(df.where("g = 'c'"), ["g"], 10).count() == 0


def test_pearson_of_large_close_values(spark):
    rng = np.random.default_rng(2)
    x, y = 1e8 + 0.001 * rng.integers(0, 9, 9), 1e8 + 0.001 * rng.integers(0, 9, 9)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert df.agg(curves.safe_corr("x", "y")).first()[0] == pytest.approx(np.corrcoef(x - 1e8, y - 1e8)[0, 1], abs=1e-3)
    assert df.select("x", F.lit(1.0).alias("y")).agg(curves.safe_corr("x", "y")).first()[0] is None


# ---- schedules and saved results


def test_controls_keep_sizes_and_tokens(spark, sf):
    text = schedule.tokens(spark, sf)
    base = schedule.nearest_partitions(schedule.labelled_matrix(spark, sf), {"baseline": 1.0})
    kept = base.where("cluster_id >= 0").toPandas()
    moved = schedule.seeded_controls(base, text, (1, 2)).toPandas()
    bucket = {r["token_id"]: r["bucket"] for r in text.collect()}
    assert len(bucket) == base.select("token_id").distinct().count()
    for (source, seed, scale), f in moved.groupby(["source", "seed", "scale"]):
        own = kept[kept.scale == scale]
        assert sorted(f.token_id) == sorted(own.token_id) and f.cluster_id.value_counts().to_dict() == own.cluster_id.value_counts().to_dict()
        if source == "length_bucket":
            count = lambda d: d.assign(b=d.token_id.map(bucket)).groupby(["cluster_id", "b"]).size().to_dict()
            assert count(f) == count(own)
    one = moved[(moved.source == "permutation") & (moved.scale == 8)]
    assert len(set(map(tuple, (g.sort_values("token_id").cluster_id.tolist() for _, g in one.groupby("seed"))))) == 2


def test_nearest_partitions_by_plain_distances(spark, sf):
    rows = schedule.labelled_matrix(spark, sf).toPandas().sort_values("row_id")
    x, label = np.array(rows.features.tolist(), float), rows.label.to_numpy()
    names = [0, *sorted(set(label[label > 0]))]
    centre = np.array([x.mean(0) if k == 0 else x[label == k].mean(0) for k in names])
    got = schedule.nearest_partitions(schedule.labelled_matrix(spark, sf), {"a": 1.0, "b": 0.9}).toPandas()
    for (source, scale), f in got.groupby(["source", "scale"]):
        d = ((x[:, None, :scale] - centre[None, :, :scale]) ** 2).sum(-1)
        d[:, 0] *= {"a": 1.0, "b": 0.9}[source]
        assert (f.sort_values("token_id").cluster_id.to_numpy() == np.array(names)[d.argmin(1)] - 1).all()


def test_nearest_partitions_block_by_block(spark, sf, monkeypatch):
    rows = schedule.labelled_matrix(spark, sf)
    both = rows.withColumn("seed", F.lit(1)).unionByName(rows.withColumn("seed", F.lit(2)).withColumn("features", F.transform("features", lambda x: -x)))
    sorted_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want, seeded = sorted_rows(schedule.nearest_partitions(rows, {"a": 1.0, "b": 0.9})), sorted_rows(schedule.nearest_partitions(both, {"a": 1.0}))
    monkeypatch.setattr(schedule, "CENTRE_BYTES", 1500)  # a few means a block
    assert sorted_rows(schedule.nearest_partitions(rows, {"a": 1.0, "b": 0.9})) == want
    assert sorted_rows(schedule.nearest_partitions(both, {"a": 1.0})) == seeded
    plain = {(r[2], r[3]): r[4] for r in want if r[0] == "a"}
    assert all(plain[r[2], r[3]] == r[4] for r in seeded)  # turning all signs changes no distance
    assert schedule.nearest_partitions(rows, {"a": 1.0}, (128,)).count() == 0 and schedule.nearest_partitions(rows.where("row_id < 0"), {"a": 1.0}).count() == 0


def test_metric_schedule_by_plain_scores(spark, sf):
    got = {(r["source"], r["scale"], r["metric"], r["aggregation"]): r["value"] for r in schedule.metric_schedule(spark, sf).where("source = 'baseline'").collect()}
    text = {r["token_id"]: r for r in schedule.tokens(spark, sf).collect()}
    base = schedule.nearest_partitions(schedule.labelled_matrix(spark, sf), {"baseline": 1.0}).where("scale = 8 AND cluster_id >= 0").toPandas()
    groups = [[text[t] for t in f.token_id] for _, f in base.groupby("cluster_id")]
    similar = [mean_similarity([r["token_str"] for r in g]) for g in groups if len(g) > 1]
    entropy = []
    for g in groups:
        p = np.unique([r["script"] for r in g], return_counts=True)[1] / len(g)
        entropy.append(-(p * np.log(p)).sum())
    for metric, values in (("similarity", similar), ("script", entropy)):
        assert got["baseline", 8, metric, "mean"] == pytest.approx(np.mean(values)) and got["baseline", 8, metric, "std"] == pytest.approx(np.std(values), abs=1e-8)
        assert got["baseline", 8, metric, "count"] == len(values)


def test_subsamples_rank_few_rows_and_lose_none(spark, monkeypatch):
    """A large cluster, one whose rows all have the same hash (so that too few of them may be below the bound), a small one."""
    from strataspan.operators import orthography

    seen = []
    monkeypatch.setattr(orthography, "settled", lambda df, *at: seen.append(df) or df, raising=False)
    rows = spark.range(3000).selectExpr("id AS token_id", "1L AS cluster_id", "substr(sha2(cast(id AS string), 256), 1, 7) AS token_str")
    rows = rows.union(spark.range(600).selectExpr("7L", "2L", "'same'")).union(spark.range(5).selectExpr("id", "3L", "concat('t', id)"))
    got = {r["cluster_id"]: r["score"] for r in orthography.sampled_similarity(rows).collect()}
    drawn = rows.where("cluster_id = 1").selectExpr("token_id", "token_str", f"explode(transform(sequence(1, 10), d -> struct(d, xxhash64({orthography.SEED}, d, token_id) AS h))) AS x").toPandas()
    tries = [sorted((x["h"], i, t) for i, t, x in zip(drawn.token_id, drawn.token_str, drawn.x) if x["d"] == d)[:128] for d in range(1, 11)]
    assert got[1] == pytest.approx(np.mean([mean_similarity([t for _, _, t in f]) for f in tries])) and got[2] == 1.0 and got[3] == pytest.approx(0.75)
    # what was ranked first: full subsamples of the large cluster, the small cluster, and what of the other lies below the bound
    first = {(r["cluster_id"], r["draw"]): r["count"] for r in seen[0].groupBy("cluster_id", "draw").count().collect()}
    assert all(first[1, d] == 128 for d in range(1, 11)) and first[3, 0] == 5 and 0 < seen[1].count() < 10 and seen[1].where("cluster_id <> 2").isEmpty()


def test_reports_refuse_what_does_not_fit(spark):
    rows = [("c", s, m, a, k, float(k), float(k * s + 1)) for s in (1, 2) for m in ("script", "length") for a in ("mean", "std") for k in (2, 4, 8)]
    pairs = spark.createDataFrame(rows, "source string, seed long, metric string, aggregation string, scale int, r double, t double")
    one = schedule.seed_records(pairs, ["source", "seed"]).orderBy("seed").first()
    assert one["n_dims"] == 3 and one["script_mean_rho"] == one["joint_mean_rho"] == 1.0
    with pytest.raises(Exception, match="differ in their widths"):
        schedule.seed_records(pairs.where("NOT (metric = 'script' AND scale = 8)"), ["source", "seed"]).collect()
    assert schedule.strict_comparison(pairs, 3, 2).count() == 4
    for n, k in ((4, 2), (3, 3)):
        with pytest.raises(Exception, match="unexpected widths or seeds"):
            schedule.strict_comparison(pairs, n, k).collect()
    with pytest.raises(ValueError):
        schedule.composed(pairs, ["seed"], {"script": 0.0})
    wide = spark.createDataFrame([("script", "mean", 2, 1.0), ("script", "std", 2, 0.1), ("length", "mean", 2, 1.0), ("length", "std", 2, 0.2)], "metric string, aggregation string, scale int, value double")
    assert schedule.merged_summary(wide).first()["script_std"] == 0.1
    for bad in (wide.where("metric = 'script'"), wide.withColumn("value", -F.col("value")), wide.union(wide)):
        with pytest.raises(Exception, match="do not merge"):
            schedule.merged_summary(bad).collect()


def test_inputs_that_do_not_fit(spark):
    text = spark.createDataFrame([(1, "a"), (2, "b")], "token_id long, token_str string")
    rows = spark.createDataFrame([(1, 0, None), (2, 0, "own"), (3, 1, "c")], "token_id long, cluster_id long, token_str string")
    assert sorted(texts.standardised(rows, text).collect()) == [(1, 0, "a"), (2, 0, "own"), (3, 1, "c")]
    with pytest.raises(Exception, match="no text for token 3"):
        texts.standardised(rows.withColumn("token_str", F.lit(None).cast("string")), text).collect()
    good = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row_id long, features array<double>")
    assert texts.coerced(good).agg(F.max("n_columns")).first()[0] == 2
    for row in ((2, [1.0]), (2, [1.0, float("nan")]), (2, [1.0, None])):
        with pytest.raises(Exception, match="does not fit the matrix: 2"):
            texts.coerced(good.union(spark.createDataFrame([row], good.schema))).collect()
    part = lambda *rows: spark.createDataFrame(rows, "token_id long, cluster_id long, probability float")
    assert partitions.strict_partition(part((0, -1, 0.5), (1, 0, 1.0))).count() == 2 == partitions.strict_partition(part((0, -1, None), (1, 0, None))).count()
    for rows in (((0, 0, None), (2, 0, None)), ((0, 0, None), (0, 0, None)), ((0, 0, 0.1), (1, 0, None)), ((0, 0, 1.5),), ((0, -2, 0.5),)):
        with pytest.raises(Exception, match="contract"):
            partitions.strict_partition(part(*rows)).collect()
    parts = spark.createDataFrame([("s", None, 2, 1, 0), ("s", None, 2, 2, 0)], "source string, seed long, scale int, token_id long, cluster_id long")
    assert schedule.case_study(parts, text, text.where("token_id = 1")).first()["content"] == "a b"
    with pytest.raises(Exception, match="asked for twice"):
        schedule.case_study(parts, text, text.union(text)).collect()


def test_case_study_deals_long_contents_to_tasks(spark, monkeypatch):
    """Forty asked tokens of one cluster with a content of 1,200 bytes or so: no task returns all of them."""
    monkeypatch.setattr(schedule, "CONTENT_BYTES", 8000, raising=False)
    text = spark.range(160).select(F.col("id").alias("token_id"), F.concat(F.lit("token"), F.col("id").cast("string")).alias("token_str"))
    parts = text.select(F.lit("s").alias("source"), F.lit(None).cast("long").alias("seed"), F.lit(2).alias("scale"), "token_id", F.when(F.col("token_id") == 0, -1).otherwise(3).cast("long").alias("cluster_id"))
    both = parts.unionByName(parts.withColumn("seed", F.lit(5).cast("long")))
    rows = schedule.case_study(both, text, text.where("token_id % 4 = 0").select("token_id")).withColumn("task", F.spark_partition_id()).collect()
    content = " ".join(sorted(f"token{i}" for i in range(1, 160)))
    assert sorted((r["seed"] or 0, r["token_id"], r["size"], r["content"]) for r in rows) == [(s, i, 159 if i else 0, content if i else "") for s in (0, 5) for i in range(0, 160, 4)]
    held = {}
    for r in rows:
        held[r["task"]] = held.get(r["task"], 0) + len(r["content"])
    assert max(held.values()) <= 4 * 8000 < sum(held.values()) / 2


def test_case_study_holds_repeated_contents_once(spark, monkeypatch, tmp_path):
    """Three clusters with contents of 600 KB, which no compression shortens, for forty asked tokens each: files hold a
    content once for each chunk, and however small the chunks, eight copies of it are shuffled at most."""
    long = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{k}")), 256) for k in range(32)])
    text = spark.range(900).select(F.col("id").alias("token_id"), long.alias("token_str"))
    parts = text.select(F.lit("s").alias("source"), F.lit(None).cast("long").alias("seed"), F.lit(2).alias("scale"), "token_id", (F.col("token_id") % 3).alias("cluster_id"))
    saved, save = {}, schedule.settled
    monkeypatch.setattr(schedule, "settled", lambda df, folder, name: saved.setdefault(name, []).append(save(df, folder, name)) or saved[name][-1])
    asked = text.where("token_id < 120").select("token_id")
    schedule.case_study(parts, text, asked).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    contents = {k: " ".join(sorted(r["token_str"] for r in text.where(f"token_id % 3 = {k}").collect())) for k in range(3)}
    assert [tuple(r) for r in out.groupBy("cluster_id", "content").agg(F.count("*").alias("n")).orderBy("cluster_id").collect()] == [(k, contents[k], 40) for k in range(3)]
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6 * sum(map(len, contents.values())) / 3
    monkeypatch.setattr(schedule, "CONTENT_BYTES", 8000)
    assert schedule.case_study(parts, text, asked).agg(F.sum(F.length("content"))).first()[0] == 40 * sum(map(len, contents.values()))
    assert saved["sizes"][-1].agg(F.max("chunks")).first()[0] == 8


def test_bundles_and_layouts(spark, sf):
    from strataspan.sources.store import shared_folder

    root = shared_folder(spark, "test")
    outputs.write_bundles(spectrum.matrix(spark, sf), (4, 8), root)
    assert outputs.check_bundle(spark, f"{root}/scale=4", 4).first()["n_features"] == 4
    with pytest.raises(Exception, match="do not fit"):
        outputs.check_bundle(spark, f"{root}/scale=4", 8).collect()
    spark.range(2).write.parquet(f"{root}/s")
    with pytest.raises(FileExistsError):
        outputs.publish(spark, f"{root}/s", f"{root}/scale=8")
    lost = spark.createDataFrame([("r", 2, 5)], "run_id string, scale int, n_total long")
    assert outputs.control_names(lost, 3).first()["partition_path"] == "controls/seed3/r"


def test_p_values():
    assert curves.t_two_sided(0.8, 4) == pytest.approx(0.2)
    assert curves.t_two_sided(0.5, 12) == pytest.approx(0.0979, abs=1e-4)
    assert curves.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    for r in (-0.9, 0.3, 0.7):  # the closed form of four degrees of freedom, which the SQL has
        assert curves.t_two_sided(r, 6) == pytest.approx(1 - abs(r) * (3 - r * r) / 2)


def test_permutations(spark, sf):
    r = controls.permutation_invariants(spark, sf).first().asDict()
    assert all(r.values())


# ---- partitions


def test_adjusted_information_of_equal_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(partitions, "partition_b", lambda s, d: partitions.partition(s, d).select("token_id", "cluster_id"))
    assert partitions.adjusted_rand(spark, sf).first()[0] == 1.0 and partitions.adjusted_mutual_information(spark, sf).first()[0] == 1.0


def test_density_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.05, (30, 3)), rng.normal(4, 0.05, (25, 3)), rng.uniform(-20, 20, (6, 3))])

    def labels(points):
        df = spark.createDataFrame([(int(k), [float(v) for v in p]) for k, p in enumerate(points)], "row_id long, x array<double>")
        return np.array([r["cluster_id"] for r in density.density_partition(df).orderBy("token_id").collect()])

    got = labels(x)
    assert set(got[:30]) == {0} and set(got[30:55]) == {1} and (got[55:] == -1).sum() >= 4
    turned = labels(x @ spectrum.orthogonal_basis(3, 1))
    assert (turned == got).all()
    tree = density.read_hierarchy(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.array([4]), 5)
    assert tree[0].tolist() == [-1]


# ---- plumbing


def test_configuration_hashes():
    assert Task("a", "m", "s", 4, "baseline").key != Task("a", "m", "s", 4, "x", "control", 1).key
    for bad in ((0, "x"), (4, "x", None, 1)):
        with pytest.raises(ValueError):
            Task("a", "m", "s", *bad)
    assert stable_hash({"a": 1, "b": [2]}) == stable_hash({"b": [2], "a": 1})
    with pytest.raises(ValueError):
        stable_hash({"a": float("nan")})


def test_store_policies(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t")
    a, b = spark.range(3), spark.range(5)
    assert s.write("k", a, {"v": 1}).count() == 3
    with pytest.raises(FileExistsError):
        s.write("k", b, {"v": 1})
    assert s.write("k", b, {"v": 1}, RunPolicy("resume")).count() == 3
    with pytest.raises(ValueError):
        s.write("k", b, {"v": 2}, RunPolicy("resume"))
    assert s.write("k", b, {"v": 2}, RunPolicy("replace")).count() == 5
    assert s.has("k") and not s.has("other")
    assert len([x for x in os.listdir(tmp_path / "t" / "k") if x.startswith("data-")]) == 1
    with pytest.raises(FileNotFoundError):
        s.read("other")


def test_npy_source(spark, tmp_path):
    from strataspan.sources import npy

    npy.register(spark)
    x = np.random.default_rng(0).normal(size=(3000, 5)).astype(np.float64)
    np.save(tmp_path / "m.npy", x)
    df = spark.read.format("npy").option("width", 3).load(f"file://{tmp_path}/m.npy")
    got = np.array([r["features"] for r in df.orderBy("row_id").collect()])
    assert got.shape == (3000, 3) and np.allclose(got, x[:, :3], atol=1e-6)
