"""Results as saved tables: path layouts, manifests, run summaries, bundles of arrays and spectra, each written and read back.

A table of tasks is laid out in folders by source, seed and scale, so that one task is read without the others. Tables
become visible when they are whole: bundles are written to a staging folder that is renamed at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.operators.curves import r6
from strataspan.operators.schedule import (
    _METRICS, _PARTS, _TASKS, MARGINS, TASK, category_entropies, labelled_matrix, nearest_partitions, partition_schedule, tokens,
)
from strataspan.operators.spectrum import _S, moments, orthogonal_basis, principal_axes, project, spectrum
from strataspan.plans.registry import query
from strataspan.sources import npz
from strataspan.sources.store import check_schema, settled, shared_folder
from strataspan.sources.tables import SCALES, SPECTRUM_SQL, matrix

LAYOUT = ("source", "seed", "scale")
PARTITION_MANIFEST = ("analysis_id", "model_name", "space_name", "scale", "source", "seed_type", "seed", "method", "partition_path", "n_tokens", "n_clusters", "n_noise", "noise_fraction", "config_hash", "reused")
REPRESENTATION_MANIFEST = (
    "analysis_id", "model_name", "space_name", "scale", "source", "seed_type", "seed", "builder", "matrix_path", "components_path", "explained_ratio_path", "mean_path", "metadata_path",
    "n_samples", "n_features", "config_hash", "reused")


def task_path(root: str, source: str, seed: int | None, scale: int) -> str:
    """The folder of one task."""
    return f"{root}/source={source}/seed={'none' if seed is None else seed}/scale={scale}"


def path_of(root: str):
    """The same as a column."""
    return F.concat_ws("/", F.lit(root), F.concat(F.lit("source="), "source"), F.concat(F.lit("seed="), F.coalesce(F.col("seed").cast("string"), F.lit("none"))), F.concat(F.lit("scale="), F.col("scale").cast("string")))


def write_tasks(rows: DataFrame, root: str) -> None:
    """Rows of many tasks in the folders of their tasks, a few files each."""
    laid = rows.withColumn("seed", F.coalesce(F.col("seed").cast("string"), F.lit("none")))
    laid.repartition(*[F.col(c) for c in LAYOUT]).write.partitionBy(*LAYOUT).parquet(root)


def read_task(spark: SparkSession, root: str, source: str, seed: int | None, scale: int, schema: T.StructType) -> DataFrame:
    """One task's rows: only its folder is read; the columns must be those wanted."""
    return check_schema(spark.read.parquet(task_path(root, source, seed, scale)), schema)


def publish(spark: SparkSession, staging: str, final: str) -> None:
    """Rename a finished folder to its name; a name that is taken is an error."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(staging).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(fs_path(final)):
        raise FileExistsError(final)
    if not fs.rename(fs_path(staging), fs_path(final)):
        raise OSError(f"{staging} could not be renamed")


def partition_manifest(parts: DataFrame, root: str) -> DataFrame:
    """One row for each task of (source, seed, scale, token_id, cluster_id); a fraction that does not fit its counts, or a
    task twice, cannot come about, as all are counted here."""
    noise = F.count(F.when(F.col("cluster_id") < 0, 1))
    n = F.count(F.lit(1))
    rows = parts.groupBy(*TASK).agg(n.alias("n_tokens"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"), noise.alias("n_noise"), (noise / n).alias("noise_fraction"))
    key = F.concat_ws("|", F.lit("tables"), F.lit("embeddings"), "source", F.coalesce(F.col("seed").cast("string"), F.lit("none")), F.col("scale").cast("string"))
    return rows.select(
        F.lit("tables").alias("analysis_id"), F.lit("embeddings").alias("model_name"), F.lit("prefix").alias("space_name"), "scale", "source",
        F.when(F.col("seed").isNotNull(), "control").alias("seed_type"), "seed", F.lit("nearest_mean").alias("method"), path_of(root).alias("partition_path"),
        "n_tokens", "n_clusters", "n_noise", "noise_fraction", F.sha2(key, 256).alias("config_hash"), F.lit(False).alias("reused"))


_MANIFEST_SQL = """SELECT 'tables' AS analysis_id, 'embeddings' AS model_name, 'prefix' AS space_name, CAST(scale AS INT) AS scale, source, CASE WHEN seed IS NOT NULL THEN 'control' END AS seed_type, CAST(seed AS VARCHAR) AS seed, 'nearest_mean' AS method,
'parts/source=' || source || '/seed=' || coalesce(CAST(seed AS VARCHAR), 'none') || '/scale=' || scale AS partition_path, count(*) AS n_tokens, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS n_clusters,
count(*) FILTER (WHERE cluster_id < 0) AS n_noise, round(count(*) FILTER (WHERE cluster_id < 0) / count(*), 6) AS noise_fraction, sha256('tables|embeddings|' || source || '|' || coalesce(CAST(seed AS VARCHAR), 'none') || '|' || scale) AS config_hash, FALSE AS reused FROM task_ GROUP BY source, seed, scale"""


@query("partition_manifest", _TASKS + _MANIFEST_SQL)
def partition_manifest_query(spark, sf_dir):
    """The manifest of all partitions and controls, in its fifteen columns, counted from the folders it names."""
    folder = shared_folder(spark, "outputs")
    write_tasks(partition_schedule(spark, sf_dir, settled(tokens(spark, sf_dir), folder, "tokens"), folder), f"{folder}/parts")
    saved = spark.read.schema("token_id long, cluster_id long, source string, seed string, scale int").parquet(f"{folder}/parts")
    parts = saved.withColumn("seed", F.when(F.col("seed") != "none", F.col("seed").cast("long")))
    return partition_manifest(parts, "parts").withColumn("noise_fraction", r6("noise_fraction")).withColumn("seed", F.col("seed").cast("string")).select(*PARTITION_MANIFEST)


_BASELINE = {"baseline": 1.0, **{f"stability_{m}": m for m in MARGINS}}


@query("task_layout", f"WITH {_PARTS} SELECT source, CAST(scale AS INT) AS scale, CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS n, CAST(sum(token_id) AS BIGINT) AS ids FROM part_ WHERE source = 'baseline' AND scale = 8 GROUP BY ALL")
def task_layout(spark, sf_dir):
    """All partitions saved in the folders of their tasks; the one of width 8 read by its path alone."""
    root = shared_folder(spark, "outputs") + "/parts"
    parts = nearest_partitions(labelled_matrix(spark, sf_dir), _BASELINE)
    write_tasks(parts, root)
    one = read_task(spark, root, "baseline", None, 8, T.StructType([T.StructField("token_id", T.LongType()), T.StructField("cluster_id", T.LongType())]))
    return one.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_id").alias("ids")).select(F.lit("baseline").alias("source"), F.lit(8).alias("scale"), "cluster_id", "n", "ids")


@query("metric_output", _METRICS + ", d_ AS (SELECT scale, metric, cluster_id, size, h, h_norm FROM hn_ WHERE source = 'baseline') SELECT CAST(scale AS INT) AS scale, metric, count(*) AS n_details, round(avg(h), 6) AS mean_h, round(stddev_pop(h), 6) + 0.0 AS std_h, round(avg(h_norm), 6) AS mean_h_norm, CAST(sum(size) AS BIGINT) AS n_tokens FROM d_ GROUP BY scale, metric")
def metric_output(spark, sf_dir):
    """A detail table of each metric, and the summary that is made of what was saved; the summary is written last."""
    folder = shared_folder(spark, "outputs")
    text = settled(tokens(spark, sf_dir), folder, "tokens")
    base = nearest_partitions(labelled_matrix(spark, sf_dir), {"baseline": 1.0})
    category_entropies(base, text).drop("source", "seed").write.partitionBy("metric").parquet(f"{folder}/details")
    details = spark.read.parquet(f"{folder}/details")
    summary = details.groupBy("scale", "metric").agg(F.count(F.lit(1)).alias("n_details"), r6(F.avg("h")).alias("mean_h"), (r6(F.stddev_pop("h")) + 0.0).alias("std_h"), r6(F.avg("h_norm")).alias("mean_h_norm"), F.sum("size").alias("n_tokens"))
    return settled(summary, folder, "summary")


@query("control_output", _TASKS + "SELECT source, CAST(seed AS BIGINT) AS seed, CAST(scale AS INT) AS scale, count(*) AS n_rows, CAST(sum(token_id * (cluster_id + 1)) AS BIGINT) AS digest, sha256('baseline|' || scale) AS from_partition, sha256(source || '|' || seed || '|' || scale) AS config_hash FROM task_ WHERE seed IS NOT NULL GROUP BY source, seed, scale")
def control_output(spark, sf_dir):
    """Permuted partitions saved by task, with what they were made of."""
    folder = shared_folder(spark, "outputs")
    parts = partition_schedule(spark, sf_dir, settled(tokens(spark, sf_dir), folder, "tokens"), folder).where("seed IS NOT NULL")
    write_tasks(parts, f"{folder}/controls")
    back = spark.read.schema("token_id long, cluster_id long, source string, seed long, scale int").parquet(f"{folder}/controls")
    rows = back.groupBy(*TASK).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("token_id") * (F.col("cluster_id") + 1)).alias("digest"))
    scale, seed = F.col("scale").cast("string"), F.col("seed").cast("string")
    return rows.withColumn("from_partition", F.sha2(F.concat_ws("|", F.lit("baseline"), scale), 256)).withColumn("config_hash", F.sha2(F.concat_ws("|", "source", seed, scale), 256))


@query("run_summaries", f"WITH {_PARTS} SELECT source || '_dim' || scale AS run_id, CAST(scale AS INT) AS scale, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS n_clusters_excl_noise, count(*) FILTER (WHERE cluster_id < 0) AS n_noise, count(*) AS n_total, round(count(*) FILTER (WHERE cluster_id < 0) / count(*), 6) AS noise_ratio, 'runs/' || source || '_dim' || scale AS partition_path FROM part_ GROUP BY source, scale")
def run_summaries(spark, sf_dir):
    """A summary record for each run, found again by the run's id, with the path of its partition."""
    parts = nearest_partitions(labelled_matrix(spark, sf_dir), _BASELINE)
    noise = F.count(F.when(F.col("cluster_id") < 0, 1))
    rows = parts.groupBy("source", "scale").agg(F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters_excl_noise"), noise.alias("n_noise"), F.count(F.lit(1)).alias("n_total"), r6(noise / F.count(F.lit(1))).alias("noise_ratio"))
    run = F.concat("source", F.lit("_dim"), F.col("scale").cast("string"))
    return rows.select(run.alias("run_id"), "scale", "n_clusters_excl_noise", "n_noise", "n_total", "noise_ratio", F.concat(F.lit("runs/"), run).alias("partition_path"))


def control_names(summary: DataFrame, seed: int) -> DataFrame:
    """Summary rows under the name of a control; a run that lacks a new path is an error."""
    new = summary.select("run_id", F.concat(F.lit(f"controls/seed{seed}/"), "run_id").alias("new_path"))
    lost = F.raise_error(F.concat(F.lit("no path for "), F.col("run_id")))
    return summary.join(new, "run_id", "left").select(F.concat("run_id", F.lit(f"_permuted_seed{seed}")).alias("run_id"), "scale", "n_total", F.coalesce("new_path", lost).alias("partition_path"))


@query("control_names", f"WITH {_PARTS} SELECT source || '_dim' || scale || '_permuted_seed42' AS run_id, CAST(scale AS INT) AS scale, count(*) AS n_total, 'controls/seed42/' || source || '_dim' || scale AS partition_path FROM part_ GROUP BY source, scale")
def control_names_query(spark, sf_dir):
    return control_names(run_summaries(spark, sf_dir), 42)


# ---- arrays


def write_bundles(rows: DataFrame, scales: tuple[int, ...], root: str) -> None:
    """The principal scores of each width with components, explained shares and mean, through a staging folder.

    The axes are fitted once and the full scores saved once; a width is a prefix of both."""
    spark = rows.sparkSession
    axes, values, mean = principal_axes(*moments(rows))
    scores = settled(project(rows, axes, mean), shared_folder(spark, "scores"), "full")
    for scale in scales:  # a folder each, which a rename makes visible
        staging = f"{root}/scale={scale}.staging"
        scores.select("row_id", F.slice("scores", 1, scale).cast("array<float>").alias("features")).write.parquet(f"{staging}/matrix")
        arrays = [("component", k, axes[:, k].tolist()) for k in range(scale)] + [("explained_ratio", 0, (values[:scale] / max(values.sum(), 1e-300)).tolist()), ("mean", 0, mean.tolist())]
        spark.createDataFrame(arrays, "name string, k int, x array<double>").coalesce(1).write.parquet(f"{staging}/arrays")
        publish(spark, staging, f"{root}/scale={scale}")


def check_bundle(spark: SparkSession, path: str, scale: int) -> DataFrame:
    """(scale, n_samples, n_features, n_columns, explained): a bundle whose parts do not fit one another is an error."""
    arrays = spark.read.parquet(f"{path}/arrays")
    shape = spark.read.parquet(f"{path}/matrix").agg(F.count(F.lit(1)).alias("n_samples"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"), F.count_distinct("row_id").alias("ids"))
    of = lambda n, c: F.max(F.when(F.col("name") == n, c))
    have = arrays.agg(F.count(F.when(F.col("name") == "component", 1)).alias("k"), of("component", F.size("x")).alias("d"), of("mean", F.size("x")).alias("m"), of("explained_ratio", F.size("x")).alias("e"),
                      F.max(F.when(F.col("name") == "explained_ratio", F.aggregate("x", F.lit(0.0), lambda a, x: a + x))).alias("explained"))
    ok = (F.col("lo") == scale) & (F.col("hi") == scale) & (F.col("ids") == F.col("n_samples")) & (F.col("k") == scale) & (F.col("e") == scale) & (F.col("m") == F.col("d"))
    return shape.join(have).select(F.when(ok, F.lit(scale)).otherwise(F.raise_error("the bundle's parts do not fit").cast("int")).alias("scale"), "n_samples", F.col("hi").alias("n_features"), F.col("d").alias("n_columns"), r6("explained").alias("explained"))


_CENTRED = SPECTRUM_SQL.replace("sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)) AS v", "sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)) - sum(CAST(a.v AS DOUBLE)) * sum(CAST(b.v AS DOUBLE)) / count(*) AS v")
@query("representation_bundles", f"WITH RECURSIVE {_CENTRED}, w_ AS (SELECT unnest([{', '.join(map(str, SCALES))}]) AS w) SELECT CAST(w AS INT) AS scale, (SELECT count(*) FROM embeddings) AS n_samples, CAST(w AS INT) AS n_features, (SELECT n FROM size_) AS n_columns, round((SELECT sum(energy) FROM sp WHERE scale <= w) / (SELECT sum(energy) FROM sp), 6) AS explained FROM w_")
def representation_bundles(spark, sf_dir):
    """Bundles of all widths, written, renamed and checked."""
    root, out = shared_folder(spark, "outputs"), None
    write_bundles(matrix(spark, sf_dir), SCALES, root)
    for scale in SCALES:
        one = check_bundle(spark, f"{root}/scale={scale}", scale)
        out = one if out is None else out.unionByName(one)
    return out


@query("representation_manifest", f"""SELECT 'tables' AS analysis_id, 'embeddings' AS model_name, 'pca' AS space_name, CAST(w AS INT) AS scale, 'full_pca' AS source, CAST(NULL AS VARCHAR) AS seed_type, CAST(NULL AS VARCHAR) AS seed, 'gram' AS builder, 'pca/scale=' || w || '/matrix' AS matrix_path, 'pca/scale=' || w || '/arrays' AS components_path,
'pca/scale=' || w || '/arrays' AS explained_ratio_path, 'pca/scale=' || w || '/arrays' AS mean_path, 'pca/scale=' || w || '/metadata' AS metadata_path, (SELECT count(*) FROM embeddings) AS n_samples, CAST(w AS BIGINT) AS n_features, sha256('tables|embeddings|full_pca|' || w) AS config_hash, FALSE AS reused FROM (SELECT unnest([{', '.join(map(str, SCALES))}]) AS w)""")
def representation_manifest(spark, sf_dir):
    """The manifest of the representations, in its seventeen columns; n_features is the width."""
    n = matrix(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_samples"))
    w = n.select("n_samples", F.explode(F.array(*[F.lit(k) for k in SCALES])).alias("scale"))
    at = lambda name: F.concat(F.lit("pca/scale="), F.col("scale").cast("string"), F.lit(f"/{name}"))
    fixed = {"analysis_id": "tables", "model_name": "embeddings", "space_name": "pca", "source": "full_pca", "builder": "gram", "reused": False, "seed_type": None, "seed": None}
    out = w.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumns({"seed_type": F.lit(None).cast("string"), "seed": F.lit(None).cast("string"), "n_features": F.col("scale").cast("long"),
        "matrix_path": at("matrix"), "components_path": at("arrays"), "explained_ratio_path": at("arrays"), "mean_path": at("arrays"), "metadata_path": at("metadata"),
        "config_hash": F.sha2(F.concat(F.lit("tables|embeddings|full_pca|"), F.col("scale").cast("string")), 256)})
    return out.select(*REPRESENTATION_MANIFEST)


@query("spectrum_output", _S + "SELECT idx, scale, round(value, 6) AS value, round(energy / sum(energy) OVER (), 6) AS energy_ratio FROM sp")
def spectrum_output(spark, sf_dir):
    """A spectrum with its measures, saved as one array file and loaded by the columns that are asked for."""
    npz.register(spark)
    s = spectrum(spark, sf_dir)
    total = s.agg(F.sum("energy").alias("total"))
    path = f"{shared_folder(spark, 'outputs')}/spectrum.npz"
    measured = s.join(total).select("idx", "scale", "value", "energy", (F.col("energy") / F.col("total")).alias("energy_ratio")).repartitionByRange(2, "idx").sortWithinPartitions("idx")
    measured.write.format("npz").option("single", "true").option("meta.source", "gram").mode("append").save(path)
    saved = spark.read.format("npz").schema("idx int, scale int, value double, energy_ratio double").load(path)
    return saved.select("idx", "scale", r6("value").alias("value"), r6("energy_ratio").alias("energy_ratio"))


# ---- projections, held against what they must keep


@query("pca_prefix_energy", f"WITH RECURSIVE {_CENTRED}, w_ AS (SELECT unnest([{', '.join(map(str, SCALES))}]) AS w) SELECT CAST(w AS INT) AS scale, (SELECT count(*) FROM embeddings) AS n_rows, round((SELECT sum(energy) FROM sp WHERE scale <= w), 5) AS energy FROM w_")
def pca_prefix_energy(spark, sf_dir):
    """Nested widths of the full principal scores: the energy of each prefix is that of its eigenvalues."""
    rows = matrix(spark, sf_dir)
    axes, _, mean = principal_axes(*moments(rows))
    square = F.transform("scores", lambda x: x * x)
    each = project(rows, axes, mean).select(F.explode(F.array(*[F.struct(F.lit(k).alias("scale"), F.aggregate(F.slice(square, 1, k), F.lit(0.0), lambda a, x: a + x).alias("e")) for k in SCALES])).alias("t"))
    return each.groupBy("t.scale").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("t.e"), 5).alias("energy"))


@query("random_projection_norms", """WITH m AS (SELECT d, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY d), c AS (SELECT list(m ORDER BY d) AS c FROM m)
SELECT vec_id AS row_id, round(sqrt(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS norm FROM embeddings, c""")
def random_projection_norms(spark, sf_dir, seed: int = 7):
    """A random orthogonal basis keeps the length of every centred row."""
    rows = matrix(spark, sf_dir)
    _, total, n = moments(rows)
    turned = project(rows, orthogonal_basis(len(total), seed), total / max(n, 1))
    return turned.select("row_id", F.round(F.sqrt(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))
