import os
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.functions.scripts import dominant_script, script_counts, script_ranges
from strataspan.operators import protocols, randomized, runs, scripts
from strataspan.operators.vocabularies import vocabulary_entropy
from strataspan.sources import npz
from strataspan.sources.manifested import read_manifested
from strataspan.sources.store import RunPolicy, shared_folder
from strataspan.sources.tasks import TaskFailures, TaskStore
from strataspan.sources.vocabularies import read_vocabulary, with_texts

KEY = T.StructType().add("name", "string").add("seed", "long")
ROWS = T.StructType().add("x", "long")


def plan_of(df):
    return df._jdf.queryExecution().toString()


# ---- manifests


@pytest.fixture
def manifest(spark, tmp_path):
    for run in ("a", "b", "c"):
        (tmp_path / "runs").mkdir(exist_ok=True)
        (tmp_path / "runs" / f"{run}.csv").write_text("token_id,cluster_id\n" + "".join(f"{k},{ord(run)}\n" for k in range(3)))
    (tmp_path / "summary.csv").write_text("run_id,scale,seed,file\na,4,,runs/a.csv\nb,8,1,runs/b.csv\nc,16,2,runs/c.csv\n")
    return f"file://{tmp_path}/summary.csv"


SHAPE = "run_id string, scale int, seed long, token_id long, cluster_id int"


def test_filters_on_runs_choose_files(spark, manifest, tmp_path):
    rows = lambda: read_manifested(spark, manifest, SHAPE, pathcolumn="file", key="run_id")
    assert rows().count() == 9
    assert "Filter (" in rows().where("token_id = 2")._jdf.queryExecution().executedPlan().toString()
    os.remove(tmp_path / "runs" / "b.csv")  # whatever opens it fails
    one = rows().where("run_id = 'c'")
    assert sorted(map(tuple, one.collect())) == [("c", 16, 2, k, 99) for k in range(3)] and one.rdd.getNumPartitions() == 1
    assert "Filter (" not in one._jdf.queryExecution().executedPlan().toString()  # the source has taken it over
    for keep in ("scale > 8", "seed IS NULL", "run_id IN ('a', 'c')", "NOT run_id = 'b'", "seed <=> 2", "scale >= 16 OR token_id < 0"):
        if "OR" not in keep:
            assert "b" not in {r["run_id"] for r in rows().where(keep).collect()}
    assert rows().where("seed <> 1").count() == 3  # a null seed is neither
    assert rows().where("run_id = 'a' AND token_id = 2").count() == 1
    assert rows().where("run_id = 'nothing'").count() == 0
    with pytest.raises(Exception, match="b.csv|No such|not found|FileNotFound"):
        rows().where("run_id = 'b'").collect()


def test_a_run_with_two_summary_rows_is_an_error(spark, manifest, tmp_path):
    with open(tmp_path / "summary.csv", "a") as f:
        f.write("a,32,,runs/c.csv\n")
    with pytest.raises(Exception, match="several rows for"):
        read_manifested(spark, manifest, SHAPE, pathcolumn="file", key="run_id").where("run_id = 'c'").collect()


def test_manifest_of_parquet_infers_and_checks_columns(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.range(5).select("id", (F.col("id") * 2).alias("twice")).repartition(2).write.parquet(f"{root}/data/one")
    spark.createDataFrame([("one", "data/one")], "run string, path string").write.parquet(f"{root}/manifest")
    rows = read_manifested(spark, f"{root}/manifest", root=root)
    assert rows.columns == ["run", "path", "id", "twice"] and rows.agg(F.sum("twice")).first()[0] == 20
    with pytest.raises(Exception, match="lacks"):
        read_manifested(spark, f"{root}/manifest", "run string, other long", root=root).collect()


# ---- tasks


def tasks(spark, names, version="1"):
    return spark.createDataFrame([(n, s, version) for n in names for s in (None, 1)], "name string, seed long, config_hash string")


class Counting:
    """Rows of the pending tasks, and which they were."""

    def __init__(self, fails=()):
        self.seen, self.fails = [], fails

    def __call__(self, pending):
        self.seen.append(sorted(r["name"] for r in pending.where("seed IS NULL").collect()))
        error = F.when(F.col("name").isin(*self.fails or ["-"]) & (F.col("x") == 1), F.lit("bad luck"))
        return pending.select("name", "seed", F.explode(F.when(F.col("name") == "empty", F.array().cast("array<long>")).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).alias("x")).withColumn("error", error)


def test_finished_tasks_are_reused(spark, tmp_path):
    store, count = TaskStore(spark, f"file://{tmp_path}/t", KEY, ROWS), Counting()
    first = store.run(tasks(spark, "ab"), count)
    assert first.counts == {"computed": 4, "reused": 0, "failed": 0}
    second = store.run(tasks(spark, "abcd"), count, RunPolicy("resume"))
    assert count.seen == [["a", "b"], ["c", "d"]] and second.counts == {"computed": 4, "reused": 4, "failed": 0}
    assert store.rows().count() == 80 and store.rows().where("name = 'c' AND seed IS NULL").count() == 10
    assert {(r["name"], r["status"]) for r in second.records.collect()} == {("a", "reused"), ("b", "reused"), ("c", "computed"), ("d", "computed")}
    third = store.run(tasks(spark, "abcd"), count, RunPolicy("resume"))
    assert third.counts["reused"] == 8 and len(count.seen) == 2  # nothing to do, nothing called
    with pytest.raises(FileExistsError):
        store.run(tasks(spark, "ax"), count)
    with pytest.raises(ValueError, match="another configuration"):
        store.run(tasks(spark, "a", "2"), count, RunPolicy("resume"))
    with pytest.raises(ValueError, match="planned twice"):
        store.run(tasks(spark, "zz"), count)
    replaced = store.run(tasks(spark, "ab", "2"), count, RunPolicy("replace"))
    assert replaced.counts["computed"] == 4 and store.rows().count() == 80
    assert {r["config_hash"] for r in store.manifest().where("name = 'a'").collect()} == {"2"}
    assert store.vacuum() == 1 and store.rows().count() == 80  # the first run's rows are all replaced


def test_failed_tasks_are_reported_and_tried_again(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/t", KEY, ROWS)
    with pytest.raises(TaskFailures) as e:
        store.run(tasks(spark, ["a", "b", "empty"]), Counting(["b"]))
    assert e.value.report.counts == {"computed": 2, "reused": 0, "failed": 4}
    assert {r["name"]: r["reason"] for r in e.value.report.records.where("status = 'failed'").collect()} == {"b": "bad luck", "empty": "no rows"}
    assert {r["name"] for r in store.rows().collect()} == {"a"}
    later = store.run(tasks(spark, ["a", "b"]), Counting(), RunPolicy("resume"))
    assert later.counts == {"computed": 2, "reused": 2, "failed": 0}


def test_saved_rows_are_checked(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/t", KEY, ROWS)
    store.run(tasks(spark, "a"), Counting())
    entry = store.manifest().where("seed = 1").first()
    path = f"{store.path}/{entry['path']}"
    spark.range(10).select((F.col("id") + (F.col("id") == 3).cast("long")).alias("x"), F.lit(None).cast("string").alias("error")).coalesce(1).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="not those of the manifest"):
        store.run(tasks(spark, "ab"), Counting(), RunPolicy("resume"))
    with pytest.raises(ValueError, match="lack"):
        store.run(tasks(spark, "c"), lambda pending: pending.select("name", "seed", F.lit("text").alias("x")))
    assert not TaskStore(spark, f"file://{tmp_path}/new", KEY, ROWS).manifest().count()


def test_metric_runs_read_pending_partitions_only(spark, sf):
    stages = runs.Stages(spark, sf, shared_folder(spark, "stages"))
    stages.make_partitions(runs.tasks_of(spark, (4, 8), controls=()))
    with pytest.raises(TaskFailures):  # partitions of width 16 are not there
        stages.make_metrics(runs.tasks_of(spark, (4, 16), controls=()))
    gone = stages.partitions.manifest().where("scale = 4 AND source = 'baseline'").first()["path"]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{stages.partitions.path}/{gone}")
    fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(fs_path, True)
    report = stages.make_metrics(runs.tasks_of(spark, (4, 8), controls=()), RunPolicy("resume"))
    assert report.counts == {"computed": 3, "reused": 3, "failed": 0}


# ---- spectra by sketches


def decaying(n, d, seed=1):
    rng = np.random.default_rng(seed)
    u, v = np.linalg.qr(rng.normal(size=(n, d)))[0], np.linalg.qr(rng.normal(size=(d, d)))[0]
    return u * (10.0 * 0.7 ** np.arange(d)) @ v.T + 0.5


def as_rows(spark, x, parts=5):
    return spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "row_id long, features array<double>").repartition(parts)


@pytest.mark.parametrize("centred", [False, True])
def test_sketches_find_the_exact_values(spark, centred):
    x = decaying(300, 40)
    rows = as_rows(spark, x, 20)  # two levels of the tree
    c = x - x.mean(0) if centred else x
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    for sketch in randomized.randomized_svd(rows, [(3, 1), (3, 2), (10, 1)], centred, rounds=3):
        assert np.allclose(sketch.values, s[: sketch.scale], atol=1e-6 * s[0]) and sketch.total == pytest.approx((c * c).sum())
        assert np.allclose(np.abs((sketch.axes * vt[: sketch.scale].T).sum(0)), 1, atol=1e-6)
        assert (sketch.axes[np.abs(sketch.axes).argmax(0), range(sketch.scale)] > 0).all()
    scores = randomized.project_all(rows, [sketch]).orderBy("row_id").collect()
    assert np.allclose([r["features"] for r in scores], (x - sketch.mean) @ sketch.axes, atol=1e-4)


def test_small_values_survive(spark):
    """What a matrix of squares would round away: singular values down to 1e-10 of the largest."""
    rng = np.random.default_rng(3)
    u, v = np.linalg.qr(rng.normal(size=(200, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    want = 10.0 ** -np.arange(0, 12, 2)
    (sketch,) = randomized.randomized_svd(as_rows(spark, u * want @ v.T), [(6, 5)])
    assert np.allclose(np.log10(sketch.values[:5]), np.log10(want[:5]), atol=1e-3)


def test_sketch_rules(spark, monkeypatch):
    rows = as_rows(spark, decaying(30, 8))
    for bad in ([(9, 1)], [(0, 1)], [(2, 1), (2, 1)]):
        with pytest.raises(ValueError):
            randomized.randomized_svd(rows, bad)
    want = [s.values for s in randomized.randomized_svd(rows, [(2, 1), (8, 1)])]
    monkeypatch.setattr(randomized, "GROUP_BYTES", 1)  # each task by itself
    assert all(np.allclose(a, s.values) for a, s in zip(want, randomized.randomized_svd(rows, [(2, 1), (8, 1)])))
    low_rank = as_rows(spark, np.outer(np.arange(1.0, 21), np.ones(8)))
    (one,) = randomized.randomized_svd(low_rank, [(3, 1)])
    assert one.values[0] == pytest.approx(np.sqrt(8 * (np.arange(1, 21) ** 2).sum())) and np.allclose(one.values[1:], 0, atol=1e-9)
    assert randomized.randomized_svd(rows, []) == []


# ---- scripts of all of Unicode


def test_every_script_has_its_ranges(spark):
    ranges = script_ranges(spark)
    assert ranges.starts[0] == 0 and (np.diff(ranges.starts) > 0).all() and len(ranges.names) > 140
    named = {"A": "Latin", "ж": "Cyrillic", "肩": "Han", "ᚠ": "Runic", "Ꭰ": "Cherokee", "𐌀": "Old_Italic", "ߊ": "Nko", "ꦀ": "Javanese", "ⲁ": "Coptic", "1": "Other", "́": "Other", "\U000E0FFF": "Other", "é": "Latin"}
    got = {c: ranges.names[ranges.of(np.array([ord(c)]))[0]] for c in named}
    assert got == named
    # names of characters tell their scripts, too
    for word, script in (("CHEROKEE", "Cherokee"), ("GEORGIAN", "Georgian"), ("GOTHIC", "Gothic"), ("TIFINAGH", "Tifinagh"), ("OGHAM", "Ogham")):
        chars = [c for c in range(0x110000) if unicodedata.name(chr(c), "").startswith(f"{word} LETTER")]
        assert chars and {ranges.names[k] for k in ranges.of(np.array(chars))} == {script}


def test_counts_of_texts(spark):
    texts = [("aж", "Mixed", {"Latin": 1, "Cyrillic": 1}), ("ᚠᚢ1", "Runic", {"Runic": 2, "Other": 1}), ("𐌀𐌁a", "Old_Italic", {"Old_Italic": 2, "Latin": 1}), ("a1", "Latin", {"Latin": 1, "Other": 1}),
             ("", "Other", {"Other": 1}), (None, "Other", {"Other": 1}), ("1aж", "Mixed", {"Latin": 1, "Cyrillic": 1, "Other": 1}), ("12", "Other", {"Other": 2})]
    df = spark.createDataFrame([(t, w) for t, w, _ in texts], "t string, want string").repartition(3)
    got = {r["t"]: (r["s"], {x["script"]: x["n"] for x in r["c"]}) for r in df.select("t", dominant_script(F.col("t")).alias("s"), script_counts(F.col("t")).alias("c")).collect()}
    assert got == {t: (w, c) for t, w, c in texts}
    assert df.where("t = '-'").select(dominant_script(F.col("t"))).count() == 0


def test_wide_counts_have_the_scripts_there_are(spark):
    counts = spark.createDataFrame([(0, "Runic", 3), (0, "Old_Italic", 1), (1, "Runic", 2), (-1, "Gothic", 5)], "cluster_id long, script string, n long")
    wide = scripts.wide_counts(counts)
    assert wide.columns == ["cluster_id", "gothic", "old_italic", "runic"] and sorted(map(tuple, wide.collect())) == [(0, 0, 1, 3), (1, 0, 0, 2)]


def test_the_vocabulary_is_counted_once(spark, sf):
    shape = scripts.vocabulary_counts(spark, sf)
    assert "documents" not in plan_of(shape) and shape.where("cluster_id = -1").count() > 0


# ---- vocabularies


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_vocabulary_of_a_json_file(spark, file):
    from tokenizers import Tokenizer

    path = f"/opt/tokenizers/{file}"
    want = Tokenizer.from_file(path)
    got = read_vocabulary(spark, path).orderBy("token_id").collect()
    assert [r["token_id"] for r in got] == list(range(want.get_vocab_size())) and len({r["piece"] for r in got}) == len(got)
    assert all(r["piece"] == want.id_to_token(r["token_id"]) for r in got)
    specials = [r["token_str"] for r in got if r["special"]]
    assert "<|endoftext|>" in specials and len(specials) <= 2
    for r in got[::97]:
        assert r["token_str"].strip() == want.decode([r["token_id"]], skip_special_tokens=False).removesuffix("</w>").strip()


def test_vocabularies_of_other_files(spark):
    a, b = (read_vocabulary(spark, f"/opt/tokenizers/byte_bpe_50k.{x}", "token_id long, token_str string") for x in ("json", "tiktoken"))
    assert a.join(b.withColumnRenamed("token_str", "other"), "token_id").where("token_str <> other").count() == 0
    pieces = {r["token_id"]: r for r in read_vocabulary(spark, "/opt/tokenizers/piece_bpe_32k.model").collect()}
    assert len(pieces) == 32_000 and [k for k, r in pieces.items() if r["special"]] == [0, 1, 2]
    with pytest.raises(Exception, match="is none of"):
        read_vocabulary(spark, "/opt/tokenizers/README.md").collect()


def test_ids_are_pushed_down(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    rows = read_vocabulary(spark, path, "token_id long, token_str string", rangeids="1000")
    assert rows.rdd.getNumPartitions() == 51
    few = rows.where("token_id >= 2000 AND token_id < 3500")
    assert few.rdd.getNumPartitions() == 2 and few.count() == 1500 and rows.where("token_id IN (5, 50256)").count() == 2
    ids = spark.createDataFrame([(5,), (7,)], "token_id long")
    assert with_texts(ids, rows).count() == 2
    with pytest.raises(Exception, match="no text for token 60000"):
        with_texts(ids.union(spark.createDataFrame([(60_000,)], "token_id long")), rows).collect()


def test_vocabulary_entropy_by_plain_counts(spark, sf):
    from tokenizers import Tokenizer

    from strataspan.sources.tables import partition

    want, ranges = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json"), script_ranges(spark)
    import pyarrow as pa

    text = lambda i: want.decode([i], skip_special_tokens=False)
    kinds = len(set(ranges.dominant(pa.array([text(i) for i in range(want.get_vocab_size())])).to_pylist()))
    rows = partition(spark, sf).where("cluster_id >= 0").toPandas()
    got = {r["cluster_id"]: r for r in vocabulary_entropy(spark, sf).collect()}
    assert set(got) == set(rows.cluster_id)
    for c, f in rows.groupby("cluster_id"):
        n = np.unique(ranges.dominant(pa.array([text(i) for i in f.token_id])).to_pylist(), return_counts=True)[1] / len(f)
        h = -(n * np.log(n)).sum()
        assert got[c]["cluster_size"] == len(f) and got[c]["h"] == pytest.approx(h, abs=1e-6) and got[c]["h_norm"] == pytest.approx(h / np.log(kinds), abs=1e-6)


# ---- array files


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_arrays_of_numpy_are_read(spark, tmp_path, save):
    rng = np.random.default_rng(0)
    arrays = {"idx": np.arange(1000), "value": rng.random(1000), "x": rng.random((1000, 3)).astype(np.float32), "name": np.array([f"n{k}é" for k in range(1000)]), "ok": np.arange(1000) % 2 == 0}
    save(tmp_path / "a.npz", **arrays, metadata_json=np.array('{"kind": "test"}'), scalar=np.array(3.0))
    npz.register(spark)
    path = f"file://{tmp_path}/a.npz"
    rows = spark.read.format("npz").option("partbytes", "4000").load(path)
    assert dict(rows.dtypes) == {"idx": "bigint", "value": "double", "x": "array<float>", "name": "string", "ok": "boolean"}
    assert rows.rdd.getNumPartitions() == 1 if save is np.savez_compressed else rows.rdd.getNumPartitions() > 5
    got = rows.orderBy("idx").toPandas()
    assert (got.value == arrays["value"]).all() and np.allclose(got.x.tolist(), arrays["x"]) and got.name.tolist() == arrays["name"].tolist() and got.ok.tolist() == arrays["ok"].tolist()
    one = spark.read.format("npz").schema("value double").load(path)
    assert one.agg(F.sum("value")).first()[0] == pytest.approx(arrays["value"].sum()) and npz.metadata_of(path) == {"kind": "test"}
    with pytest.raises(Exception, match="lacks"):
        spark.read.format("npz").schema("other double").load(path).collect()
    save(tmp_path / "b.npz", a=np.zeros(3), b=np.zeros(4))
    with pytest.raises(Exception, match="different lengths"):
        spark.read.format("npz").load(f"file://{tmp_path}/b.npz").collect()


def test_arrays_round_trip(spark, tmp_path):
    npz.register(spark)
    rows = spark.range(500).select("id", (F.col("id") / 7).alias("v"), F.array("id", F.col("id") + 1).alias("x"), F.col("id").cast("string").alias("t")).repartitionByRange(4, "id").sortWithinPartitions("id")
    for single in ("true", "false"):
        path = f"file://{tmp_path}/out-{single}"
        rows.write.format("npz").option("single", single).option("meta.made", "here").mode("append").save(path)
        back = spark.read.format("npz").load(path)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect())) and npz.metadata_of(path) == {"made": "here"}
        with pytest.raises(Exception, match="FileExists|out-"):
            rows.write.format("npz").mode("append").save(path)
        rows.where("id < 5").write.format("npz").option("single", single).mode("overwrite").save(path)
        assert spark.read.format("npz").load(path).count() == 5
    with np.load(tmp_path / "out-true") as z:
        assert z["x"].shape == (5, 2) and z["id"].tolist() == list(range(5))
    assert not [n for n in os.listdir(tmp_path) if n.startswith(".staging")]


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    npz.register(spark)
    bad = spark.range(100).repartition(4).select("id", F.when(F.col("id") != 57, F.col("id")).alias("v"))
    with pytest.raises(Exception, match="no nulls"):
        bad.write.format("npz").mode("append").save(f"file://{tmp_path}/out")
    assert os.listdir(tmp_path) == []


# ---- protocols


def test_metrics_need_names_and_share_a_scan(spark, sf):
    text = spark.createDataFrame([(0, "aa"), (1, "b"), (2, "cccc"), (3, "d")], "token_id long, token_str string")
    parts = spark.createDataFrame([("s", None, 2, 0, 0), ("s", None, 2, 1, 0), ("s", None, 2, 2, 1), ("s", None, 2, 3, -1)], "source string, seed long, scale int, token_id long, cluster_id long")
    longest = protocols.Metric("letters", ("token_str",), lambda v: {c: 1 for t in v["token_str"] for c in set(t)}, lambda sums, n, kinds: {"kinds": len(sums), "share": len(sums) / kinds}, lambda tokens: tokens.count())
    rows = protocols.evaluate(parts, text, [protocols.MEAN_LENGTH, longest])
    got = {(r["cluster_id"], r["metric"], r["component"]): (r["size"], r["value"]) for r in rows.collect()}
    assert got == {(0, "mean_length", "mean"): (2, 1.5), (0, "mean_length", "std"): (2, 0.5), (0, "letters", "kinds"): (2, 2.0), (0, "letters", "share"): (2, 0.5),
                   (1, "mean_length", "mean"): (1, 4.0), (1, "mean_length", "std"): (1, 0.0), (1, "letters", "kinds"): (1, 1.0), (1, "letters", "share"): (1, 0.25)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "collect_list" in plan  # one pass for the parts of all metrics, one to finish them
    with pytest.raises(ValueError):
        protocols.evaluate(parts, text, [longest, longest])


def test_providers_refuse_what_they_lack(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, 2.0])], "row_id long, features array<double>")
    wide = spark.createDataFrame([("plain", None, 3)], "source string, seed long, scale int")
    with pytest.raises(Exception, match="no width 3"):
        protocols.Prefix(rows).load(wide).collect()
    with pytest.raises(KeyError):
        protocols.InMemory({}).load(wide)
    store = TaskStore(spark, f"file://{tmp_path}/r", wide.schema, protocols.REPRESENTATION_ROWS)
    with pytest.raises(FileNotFoundError):
        protocols.Saved(store).load(wide)


def test_strategies_keep_sizes_and_groups(spark):
    text = spark.range(40).select(F.col("id").alias("token_id"), F.concat(F.lit("b"), (F.col("id") % 3).cast("string")).alias("bucket"), F.lit("Latin").alias("script"))
    parts = spark.range(40).select(F.lit(2).alias("scale"), F.col("id").alias("token_id"), (F.col("id") % 5 - 1).alias("cluster_id"))
    out = protocols.permute(parts, text, {"global": (), "length_bucket": ("bucket",), "both": ("bucket", "script")}, (1, 2)).join(text, "token_id").toPandas()
    plain = parts.where("cluster_id >= 0").join(text, "token_id").toPandas()
    for (source, _), f in out.groupby(["source", "seed"]):
        assert sorted(f.token_id) == sorted(plain.token_id) and f.cluster_id.value_counts().to_dict() == plain.cluster_id.value_counts().to_dict()
        if source != "global":
            assert f.groupby(["cluster_id", "bucket"]).size().to_dict() == plain.groupby(["cluster_id", "bucket"]).size().to_dict()
    assert out.groupby("seed").apply(lambda f: tuple(f.sort_values("token_id").cluster_id), include_groups=False).nunique() == 2


# ---- nearest rows


@pytest.mark.parametrize("cell, block", [(1024, 2048), (8, 2048), (20, 7)])
def test_nearest_rows_against_all_distances(spark, monkeypatch, cell, block):
    from strataspan.operators import density

    monkeypatch.setattr(density, "CELL", cell)
    monkeypatch.setattr(density, "BLOCK", block)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(1, 5)) + 0.05 * rng.normal(size=(40, 5)) for _ in range(4)] + [np.ones((12, 5)), 9 * rng.normal(size=(8, 5))])  # groups, equal rows and rows far away
    rows = spark.createDataFrame([(int(k), r.tolist()) for k, r in enumerate(x)], "row_id long, x array<double>").repartition(4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in density.nearest(rows, 3).collect():
        got.setdefault(r["row_id"], []).append((r["d"], r["other"]))
    assert len(got) == len(x)
    for k, near in got.items():
        assert np.allclose(sorted(v for v, _ in near), np.sort(d[k])[:3], atol=1e-6)
        assert len({o for _, o in near}) == 3 and all(abs(d[k, o] - v) < 1e-6 for v, o in near)
    assert density.nearest(rows.where("row_id < 0"), 3).count() == 0
    few = density.nearest(rows.where("row_id < 2"), 3)
    assert few.count() == 2  # one other row each


def test_far_cells_are_not_visited(spark, monkeypatch, tmp_path):
    from strataspan.operators import density

    monkeypatch.setattr(density, "CELL", 40)
    rng = np.random.default_rng(1)
    x = np.concatenate([100 * k + 0.1 * rng.normal(size=(40, 4)) for k in range(10)])
    rows = spark.createDataFrame([(int(k), r.tolist()) for k, r in enumerate(x)], "row_id long, x array<double>")
    seen = []
    settle = density._settle
    monkeypatch.setattr(density, "_settle", lambda df: seen.append(settle(df)) or seen[-1])
    assert density.nearest(rows, 3).count() == 1200
    assert seen[1].count() < 400 * 5  # of ten cells


@pytest.mark.parametrize("listed", [16, 4])
def test_spanning_tree_against_plain_prim(spark, monkeypatch, listed):
    """Groups far apart, of which lists of neighbours leave every one alone, and equal rows, more than a list has."""
    from strataspan.operators import density

    monkeypatch.setattr(density, "LISTED", listed)
    monkeypatch.setattr(density, "CELL", 20)
    rng = np.random.default_rng(11)
    x = np.concatenate([50 * k + rng.normal(size=(30, 3)) for k in range(4)] + [np.full((25, 3), 7.0), rng.normal(size=(60, 3))])
    rows = spark.createDataFrame([(int(k), r.tolist()) for k, r in enumerate(x)], "row_id long, x array<double>")
    tree = [(r["d"], r["a"], r["b"]) for r in density.spanning_tree(rows, 5).collect()]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, 4]
    m = np.maximum(d, np.maximum(core[:, None], core[None]))
    labels, want = np.arange(len(x)), []
    for v, a, b in sorted((m[a, b], a, b) for a in range(len(x)) for b in range(a + 1, len(x))):  # Kruskal, ties by ids
        if labels[a] != labels[b]:
            labels[labels == labels[b]] = labels[a]
            want.append((v, a, b))
    assert len(tree) == len(x) - 1 and np.allclose(sorted(t[0] for t in tree), [w[0] for w in want])
    assert {t[1:] for t in tree} == {w[1:] for w in want}


def test_rows_meet_once_for_each_crowd(spark, monkeypatch):
    """Rows that nothing tells apart: what is sent grows with the rows, not with rows times cells."""
    from strataspan.operators import density

    rng, sent = np.random.default_rng(2), {}
    monkeypatch.setattr(density, "CELL", 8)
    for n in (400, 1600):
        rows = spark.createDataFrame([(k, rng.normal(size=24).tolist()) for k in range(n)], "row_id long, x array<double>")
        meet = density._meetings
        monkeypatch.setattr(density, "_meetings", lambda found, visitors, own, run, shape: sent.update({n: sum(len(r["regions"]) for r in visitors.select("regions").collect()) + n * found.crowds}) or meet(found, visitors, own, run, shape))
        assert density.nearest(rows, 4).count() == 4 * n
        monkeypatch.setattr(density, "_meetings", meet)
    assert sent[1600] <= 1.1 * 4 * sent[400]


def test_rows_beyond_the_vocabulary(spark, tmp_path):
    from strataspan.operators.vocabularies import vocabulary_similarity

    last = 50_257
    rows = [(i, [1.0, 0.0], 2 + (i >= last)) for i in range(last - 3, last + 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["cluster_id"]: r for r in vocabulary_entropy(spark, str(tmp_path)).collect()}
    known = {r[0] for r in read_vocabulary(spark, "/opt/tokenizers/byte_bpe_50k.json", "token_id long").collect()}
    beyond = sum(i not in known for i, _, _ in rows)
    assert beyond >= 1 and sum(r["cluster_size"] for r in got.values()) == 6
    alike = {r["cluster_id"]: r for r in vocabulary_similarity(spark, str(tmp_path)).collect()}
    assert sum(r["cluster_size"] for r in alike.values()) == 6 and alike[2]["score"] == 1.0


def test_metrics_of_a_partition_that_is_all_noise(spark, tmp_path):
    from strataspan.operators import runs

    stages = runs.Stages.__new__(runs.Stages)
    stages.spark, stages.path = spark, f"file://{tmp_path}"
    stages.text = spark.createDataFrame([(0, "a", "Latin", "1-2"), (1, "b", "Latin", "1-2")], "token_id long, token_str string, script string, bucket string")
    stages.partitions = runs.TaskStore(spark, f"{stages.path}/partitions", runs.TASK_KEY, runs.PARTITION_ROWS)
    stages.metrics = runs.TaskStore(spark, f"{stages.path}/metrics", runs.TASK_KEY, runs.METRIC_ROWS)
    tasks = runs.tasks_of(spark, (2, 4), controls=()).where("source = 'baseline'")
    parts = spark.createDataFrame([("baseline", None, k, i, -1 if k == 4 else 0) for k in (2, 4) for i in (0, 1)], "source string, seed long, scale int, token_id long, cluster_id long")
    stages.partitions.run(tasks, lambda pending: parts)
    assert stages.make_metrics(tasks).counts == {"computed": 2, "reused": 0, "failed": 0}
    wide = runs.tasks_of(spark, (runs.TOO_WIDE,), controls=()).where("source = 'baseline'")
    again = stages.make_metrics(tasks.unionByName(wide), runs.RunPolicy("resume"), stop_on_error=False)
    assert again.counts == {"computed": 0, "reused": 2, "failed": 1}
    assert {r["scale"] for r in stages.metrics.rows().collect()} == {2}
