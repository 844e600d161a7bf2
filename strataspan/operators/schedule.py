"""Partitions of every width with their controls, metrics over all of them in one job, and the reports on their curves.

A partition of width k gives each row the label whose mean vector, over the first k columns, is nearest, and no label
(noise) where the mean of all rows is nearer still. Controls deal the tokens of a partition anew (over all clusters, or
inside length buckets), change the noise rule, or turn the matrix first. Every partition is a task
(source, seed, scale), and all tasks are rows of one table: no loop runs over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.functions.scripts import dominant_script, length_bucket
from strataspan.operators.curves import DRAWS, p_sql, pair_statistics, permutation_pvalues, permutation_sql, r6, two_sided_p, zscored
from strataspan.operators.orthography import sampled_similarity
from strataspan.operators.spectrum import moments, orthogonal_basis
from strataspan.operators.task_sql import _KEY, _METRICS, _PARTS, _TASKS, MARGINS
from strataspan.plans.registry import query
from strataspan.sources.store import fingerprint, settled, shared_folder
from strataspan.sources.tables import SCALES, SEEDS, matrix, numbered, read, vocab

PROJECTION_SEEDS = (7, 17)
TASK = ("source", "seed", "scale")


#: Bytes of mean vectors that one pass over the rows takes along.
CENTRE_BYTES = 64 << 20


def _matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    """The feature vectors of a batch; they all have the same width."""
    x = batch.column("features")
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _centres(rows: DataFrame) -> DataFrame:
    """(seed, label, s, n): sums of the rows of each label, and of all rows as label 0, added up in each task first."""
    shape = "seed long, label long, s array<double>, n long"

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, seed = _matrix_of(batch), batch.column("seed").to_numpy(zero_copy_only=False)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for s in np.unique(seed):
                here = seed == s
                for one in (0, *np.unique(label[here & (label > 0)])):
                    part = x[here] if one == 0 else x[here & (label == one)]
                    total = sums.setdefault((int(s), int(one)), [0.0, 0])
                    total[0], total[1] = total[0] + part.sum(0), total[1] + len(part)
        keys = sorted(sums)
        yield pa.RecordBatch.from_pydict({"seed": pa.array([k[0] for k in keys], pa.int64()), "label": pa.array([k[1] for k in keys], pa.int64()), "s": pa.array([sums[k][0] for k in keys], pa.list_(pa.float64())), "n": pa.array([sums[k][1] for k in keys], pa.int64())})

    def merge(group: pa.Table) -> pa.Table:
        total = np.sum(group["s"].combine_chunks().flatten().to_numpy().reshape(len(group), -1), axis=0)
        return pa.table({"seed": group["seed"][:1], "label": group["label"][:1], "s": pa.array([total], pa.list_(pa.float64())), "n": [int(group["n"].to_numpy().sum())]})

    return rows.mapInArrow(add_up, shape).groupBy("seed", "label").applyInArrow(merge, shape)


def _nearest_of(rows: DataFrame, centres: dict[int, list[tuple[int, np.ndarray]]], margins: dict[str, float], scales: tuple[int, ...]) -> DataFrame:
    """(seed, source, scale, token_id, d, label): the nearest of some mean vectors, for each row, width and noise rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, seeds, ids = _matrix_of(batch), batch.column("seed").to_numpy(), batch.column("row_id").to_numpy()
            widths = [k for k in scales if k <= x.shape[1]]
            for seed in np.unique(seeds) if widths else ():
                here = seeds == seed
                part, best = x[here], {}
                for label, centre in centres.get(int(seed), ()):  # ascending, so the smaller label stays in a tie
                    gaps = (part - centre) ** 2
                    far = np.cumsum(np.add.reduceat(gaps[:, : widths[-1]], [0, *widths[:-1]], axis=1), axis=1)
                    for name, margin in margins.items():
                        d = far * margin if label == 0 else far
                        if name not in best:
                            best[name] = (d.copy(), np.full(d.shape, label))
                        else:
                            closer = d < best[name][0]
                            best[name][0][closer], best[name][1][closer] = d[closer], label
                for name, (d, label) in best.items():
                    n = d.size
                    yield pa.RecordBatch.from_pydict({"seed": pa.array(np.full(n, seed)), "source": pa.array([name] * n), "scale": pa.array(np.tile(widths, len(part)), pa.int32()), "token_id": pa.array(np.repeat(ids[here], len(widths))), "d": pa.array(d.reshape(-1)), "label": pa.array(label.reshape(-1).astype(np.int64))})

    return rows.select("seed", "row_id", "features").mapInArrow(run, "seed long, source string, scale int, token_id long, d double, label long")


def nearest_partitions(rows: DataFrame, margins: dict[str, float], scales: tuple[int, ...] = SCALES) -> DataFrame:
    """(source, seed, scale, token_id, cluster_id) of rows (row_id, label, features), for every scale and every noise rule;
    with a column ``seed``, of every matrix of a seed by itself, else the seed is null. Widths that the rows do not have
    are left out.

    A first job adds up the mean vectors, which the driver takes; batches of rows then meet them without a shuffle. Where
    they are more than ``CENTRE_BYTES``, rows meet them block by block of labels, and the nearest of each block are
    compared."""
    seeded = "seed" in rows.columns
    keyed = rows.select((F.col("seed") if seeded else F.lit(0)).cast("long").alias("seed"), "row_id", F.coalesce("label", F.lit(0)).cast("long").alias("label"), "features")
    means = settled(_centres(keyed), shared_folder(rows.sparkSession, "centres"), "means")
    size = means.agg(F.coalesce(F.sum(F.size("s").cast("long") * 8), F.lit(0)).cast("long")).first()[0]
    blocks, found = max(1, -(-size // CENTRE_BYTES)), None
    for k in range(blocks):
        centres: dict[int, list[tuple[int, np.ndarray]]] = {}
        for r in means.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == k).orderBy("seed", "label").toLocalIterator():
            centres.setdefault(r["seed"], []).append((r["label"], np.array(r["s"]) / r["n"]))
        one = _nearest_of(keyed, centres, margins, tuple(sorted(scales)))
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        found = found.groupBy("seed", "source", "scale", "token_id").agg(F.min(F.struct("d", "label")).alias("m")).select("seed", "source", "scale", "token_id", "m.label")
    return found.select("source", (F.col("seed") if seeded else F.lit(None).cast("long")).alias("seed"), "scale", "token_id", (F.col("label") - 1).alias("cluster_id"))


def labelled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").alias("features"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token_id, token_str, script, bucket) of the tokens that have a row in the matrix."""
    text = vocab(spark, sf_dir).select("token_id", "token_str").join(matrix(spark, sf_dir).select(F.col("row_id").alias("token_id")), "token_id", "left_semi")
    return text.select("token_id", "token_str", dominant_script(F.col("token_str")).alias("script"), length_bucket(F.col("token_str")).alias("bucket"))


def seeded_controls(base: DataFrame, text: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """(source, seed, scale, token_id, cluster_id): every seed times every partition, tokens dealt anew globally
    (``permutation``) and inside length buckets (``length_bucket``). Noise is left out; clusters keep their sizes."""
    kept = base.where("cluster_id >= 0").select("scale", "token_id", "cluster_id").join(text.select("token_id", "bucket"), "token_id")
    both = F.explode(F.array(F.struct(F.lit("permutation").alias("source"), F.lit("").alias("within")), F.struct(F.lit("length_bucket").alias("source"), F.col("bucket").alias("within"))))
    seeded = kept.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds]))).withColumn("k", both).select("k.source", "seed", "scale", "k.within", "token_id", "cluster_id")
    group = ["source", "seed", "scale", "within"]
    seats = numbered(seeded, group, F.col("token_id"), "seat").select(*group, "seat", "cluster_id")
    order = F.sha2(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("token_id").cast("string")), 256)
    drawn = numbered(seeded.select(*group, "token_id"), group, order, "seat").select(*group, "seat", "token_id")
    return seats.join(drawn, [*group, "seat"]).select(*TASK, "token_id", "cluster_id")


def partition_schedule(spark: SparkSession, sf_dir: str, text: DataFrame, folder: str) -> DataFrame:
    """(source, seed, scale, token_id, cluster_id) of the baseline, the stability runs and the seeded controls.

    Partitions are saved, and the controls are run over what was saved."""
    rules = {"baseline": 1.0, **{f"stability_{m}": m for m in MARGINS}}
    found = settled(nearest_partitions(labelled_matrix(spark, sf_dir), rules), folder, "partitions")
    return found.unionByName(seeded_controls(found.where("source = 'baseline'"), text))


def turned(rows: DataFrame, bases: dict[int, np.ndarray], mean: np.ndarray) -> DataFrame:
    """(seed, row_id, label, features): centred rows turned by the basis of every seed, in one pass, brought to length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix_of(batch) - mean
            for seed, basis in bases.items():
                y = x @ basis
                y /= np.linalg.norm(y, axis=1, keepdims=True) + 1e-12
                features = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.reshape(-1)))
                yield pa.RecordBatch.from_pydict({"seed": pa.array(np.full(len(y), seed, np.int64)), "row_id": batch.column("row_id"), "label": batch.column("label"), "features": features})

    return rows.select("row_id", F.col("label").cast("long").alias("label"), "features").mapInArrow(run, "seed long, row_id long, label long, features array<double>")


def projected_partitions(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = PROJECTION_SEEDS) -> DataFrame:
    """The same of the matrix turned by a seeded random orthogonal basis, its rows brought to length one; all seeds are
    rows of one table."""
    rows = labelled_matrix(spark, sf_dir)
    _, total, n = moments(rows)
    bases = {seed: orthogonal_basis(len(total), seed) for seed in seeds}
    return nearest_partitions(turned(rows, bases, total / max(n, 1)), {"projection": 1.0})


def category_entropies(parts: DataFrame, text: DataFrame) -> DataFrame:
    """(source, seed, scale, metric, cluster_id, size, h, h_norm): the entropy of scripts (``script``) and of length
    buckets (``length``) in every cluster of every task; h_norm divides by the log of the categories of all tokens."""
    label = F.explode(F.array(F.struct(F.lit("script").alias("metric"), F.col("script").alias("category")), F.struct(F.lit("length").alias("metric"), F.col("bucket").alias("category"))))
    named = text.select("token_id", label.alias("k")).select("token_id", "k.metric", "k.category")
    kinds = named.groupBy("metric").agg(F.count_distinct("category").alias("kinds"))
    n = parts.where("cluster_id >= 0").join(named, "token_id").groupBy(*TASK, "metric", "cluster_id", "category").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy(*TASK, "metric", "cluster_id").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    h = F.ln("size") - F.col("s") / F.col("size")
    return per.join(F.broadcast(kinds), "metric").select(*TASK, "metric", "cluster_id", "size", h.alias("h"), F.when(F.col("kinds") <= 1, 0.0).otherwise(h / F.ln("kinds")).alias("h_norm"))


def summarised(clusters: DataFrame, components: list[str]) -> DataFrame:
    """(source, seed, scale, metric, component, aggregation, value): mean, population deviation and number of clusters.

    Values are rounded to nine digits, so that equal ones are equal however they were added up."""
    long = clusters.select(*TASK, "metric", F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("v")) for c in components])).alias("c")).select(*TASK, "metric", "c.*")
    agg = long.groupBy(*TASK, "metric", "component").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).cast("double").alias("count"))
    pairs = F.explode(F.create_map(F.lit("mean"), "mean", F.lit("std"), "std", F.lit("count"), "count"))
    return agg.select(*TASK, "metric", "component", pairs.alias("aggregation", "value")).withColumn("value", F.round("value", 9) + 0.0)


_kept: dict[tuple[str, str], DataFrame] = {}


def entropy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved metric results of all tasks, which reports read; made once a session for the same files."""
    key = (spark.sparkContext.applicationId, fingerprint(spark, [f"{sf_dir}/{name}.parquet" for name in ("documents", "embeddings")]))
    if key not in _kept:
        folder = shared_folder(spark, "schedule")
        text = settled(tokens(spark, sf_dir), folder, "tokens")
        _kept[key] = settled(summarised(category_entropies(partition_schedule(spark, sf_dir, text, folder), text), ["h", "h_norm"]).coalesce(1), folder, "results")
    return _kept[key]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("seed", F.coalesce(F.col("seed").cast("string"), F.lit("")))


@query("scale_partitions", f"WITH {_PARTS} SELECT source, CAST(scale AS INT) AS scale, CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS n, CAST(sum(token_id) AS BIGINT) AS ids FROM part_ GROUP BY ALL")
def scale_partitions(spark, sf_dir):
    """The partitions of every width and noise rule, counted by cluster."""
    rules = {"baseline": 1.0, **{f"stability_{m}": m for m in MARGINS}}
    return nearest_partitions(labelled_matrix(spark, sf_dir), rules).groupBy("source", "scale", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_id").alias("ids"))


@query("control_schedule", _TASKS + f"SELECT {_KEY}, CAST(scale AS INT) AS scale, CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS n, CAST(sum(token_id) AS BIGINT) AS ids FROM task_ GROUP BY ALL")
def control_schedule(spark, sf_dir):
    """All tasks, seeds times partitions, counted by cluster."""
    folder = shared_folder(spark, "schedule")
    rows = partition_schedule(spark, sf_dir, settled(tokens(spark, sf_dir), folder, "tokens"), folder).groupBy(*TASK, "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_id").alias("ids"))
    return _keyed(rows)


@query("entropy_schedule", _METRICS + f"SELECT {_KEY}, CAST(scale AS INT) AS scale, metric, component, aggregation, round(value, 6) + 0.0 AS value FROM mr_")
def entropy_schedule(spark, sf_dir):
    """Script and length entropy of every partition of every task, in one job."""
    return _keyed(entropy_results(spark, sf_dir)).withColumn("value", r6("value") + 0.0)


# ---- reports


def against_baseline(results: DataFrame) -> DataFrame:
    """(source, seed, metric, aggregation, scale, r, t): curves of h beside the baseline's."""
    c = results.where("component = 'h' AND aggregation IN ('mean', 'std')").drop("component")
    base = c.where("source = 'baseline'").select("metric", "aggregation", "scale", F.col("value").alias("r"))
    return c.where("source <> 'baseline'").withColumnRenamed("value", "t").join(base, ["metric", "aggregation", "scale"])


def seed_records(pairs: DataFrame, by: list[str]) -> DataFrame:
    """One record for each variant: n_dims, mean_rho, std_rho and joint_rho (both curves, each standardised by the
    baseline) of each metric, and joint_mean_rho over both metrics' mean curves. Metrics of a variant must agree in
    their widths."""
    each = pair_statistics(pairs, [*by, "metric", "aggregation"])
    z = zscored(pairs, [*by, "metric", "aggregation"])
    joint = pair_statistics(z, [*by, "metric"]).select(*by, "metric", F.col("spearman").alias("joint_rho"))
    means = pair_statistics(z.where("aggregation = 'mean'"), by).select(*by, F.col("spearman").alias("joint_mean_rho"))
    of = lambda a, c: F.max(F.when(F.col("aggregation") == a, F.col(c)))
    per = each.groupBy(*by, "metric").agg(of("mean", "n_points").alias("n_dims"), of("std", "n_points").alias("n_std"), of("mean", "spearman").alias("mean_rho"), of("std", "spearman").alias("std_rho"))
    rows = per.join(joint, [*by, "metric"])
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = rows.groupBy(*by).agg(
        F.when((F.min("n_dims") == F.max("n_dims")) & (F.min("n_std") == F.max("n_dims")), F.max("n_dims")).otherwise(F.raise_error("the metrics of a variant differ in their widths").cast("long")).alias("n_dims"),
        *[F.round(pick(m, c), 5).alias(f"{m}_{c}") for m in ("script", "length") for c in ("mean_rho", "std_rho", "joint_rho")])
    return wide.join(means.withColumn("joint_mean_rho", F.round("joint_mean_rho", 5)), by)


def _stats_sql(source: str, by: str) -> str:
    """st_ (by, metric, aggregation, n, rho), jt_ (by, metric, rho) and jm_ (by, rho) of the pairs in ``source``."""
    rank = lambda c, p: f"rank() OVER (PARTITION BY {p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {p}, {c}) - 1) / 2"
    rho = "CASE WHEN min(r) < max(r) AND min(t) < max(t) THEN corr(rr, tr) END"
    a = f"{by}, metric, aggregation"
    return f"""fit_ AS (SELECT {a}, avg(r) AS m, stddev_pop(r) AS s FROM {source} GROUP BY ALL),
st_ AS (SELECT {a}, count(*) AS n, {rho} AS rho, avg(abs(t - r)) AS mae FROM (SELECT *, {rank('r', a)} AS rr, {rank('t', a)} AS tr FROM {source}) GROUP BY {a}),
z_ AS (SELECT {a}, scale, (r - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END AS r, (t - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END AS t FROM {source} JOIN fit_ USING ({a})),
jt_ AS (SELECT {by}, metric, {rho} AS rho FROM (SELECT *, {rank('r', by + ', metric')} AS rr, {rank('t', by + ', metric')} AS tr FROM z_) GROUP BY {by}, metric),
jm_ AS (SELECT {by}, {rho} AS rho FROM (SELECT *, {rank('r', by)} AS rr, {rank('t', by)} AS tr FROM z_ WHERE aggregation = 'mean') GROUP BY {by})"""


def _record_sql(by: str, first: str) -> str:
    one = lambda m, a: f"round((SELECT rho FROM st_ s WHERE s.k = j.k AND s.metric = '{m}' AND s.aggregation = '{a}'), 5) AS {m}_{a}_rho"
    two = lambda m: f"round((SELECT rho FROM jt_ s WHERE s.k = j.k AND s.metric = '{m}'), 5) AS {m}_joint_rho"
    return f"SELECT {first}, (SELECT max(n) FROM st_ s WHERE s.k = j.k) AS n_dims, " + ", ".join(x for m in ("script", "length") for x in (one(m, "mean"), one(m, "std"), two(m))) + ", round(j.rho, 5) AS joint_mean_rho FROM jm_ j"


_AGAINST = _METRICS + """, ab_ AS (SELECT c.source || '|' || coalesce(CAST(c.seed AS VARCHAR), '') AS k, c.source, c.seed, c.metric, c.aggregation, c.scale, b.value AS r, c.value AS t FROM mr_ c
JOIN mr_ b ON b.source = 'baseline' AND b.metric = c.metric AND b.aggregation = c.aggregation AND b.scale = c.scale AND b.component = 'h' WHERE c.source <> 'baseline' AND c.component = 'h' AND c.aggregation IN ('mean', 'std'))"""


@query("seed_records", _AGAINST + f", sp_ AS (SELECT * FROM ab_ WHERE source IN ('permutation', 'length_bucket')), {_stats_sql('sp_', 'k')} " + _record_sql("k", "split_part(k, '|', 1) AS source, CAST(split_part(k, '|', 2) AS BIGINT) AS seed"))
def seed_records_query(spark, sf_dir):
    """Every seeded control against the full partitions: one record a seed."""
    pairs = against_baseline(entropy_results(spark, sf_dir)).where(F.col("source").isin("permutation", "length_bucket"))
    return seed_records(pairs, ["source", "seed"])


def seed_tests(pairs: DataFrame, by: list[str], draws: int = DRAWS) -> DataFrame:
    """(by, metric, n_dims, mean_rho, mean_p, std_rho, std_p, joint_rho, joint_p): Spearman's coefficient and p of each
    variant's mean and deviation curves, and of both together, each standardised by the baseline, with a permutation p."""
    each = pair_statistics(pairs, [*by, "metric", "aggregation"]).withColumn("p", two_sided_p("spearman", "n_points"))
    of = lambda a, c: F.max(F.when(F.col("aggregation") == a, F.col(c)))
    per = each.groupBy(*by, "metric").agg(of("mean", "n_points").alias("n_dims"), *[of(a, c).alias(f"{a}_{n}") for a in ("mean", "std") for c, n in (("spearman", "rho"), ("p", "p"))])
    z = zscored(pairs, [*by, "metric", "aggregation"])
    points = z.select(*by, "metric", "scale", F.col("aggregation").alias("feature"), *[F.round(c, 9).alias(c) for c in ("r", "t")])
    joint = pair_statistics(points, [*by, "metric"]).select(*by, "metric", F.col("spearman").alias("joint_rho"))
    return per.join(joint, [*by, "metric"]).join(permutation_pvalues(points, [*by, "metric"], draws).withColumnRenamed("p", "joint_p"), [*by, "metric"])


@query("seed_tests", _AGAINST + f""", sp_ AS (SELECT * FROM ab_ WHERE source IN ('permutation', 'length_bucket')), {_stats_sql('sp_', 'k')},
zf_ AS (SELECT split_part(k, '|', 1) AS source, CAST(split_part(k, '|', 2) AS BIGINT) AS seed, metric, scale, aggregation AS feature, round(r, 9) AS r, round(t, 9) AS t FROM z_), {permutation_sql('zf_', ['source', 'seed', 'metric'], DRAWS)}
SELECT p.source, p.seed, p.metric, a.n AS n_dims, round(a.rho, 5) AS mean_rho, {p_sql('a.rho')} AS mean_p, round(b.rho, 5) AS std_rho, {p_sql('b.rho')} AS std_p, round(j.rho, 5) AS joint_rho, round(p.p, 9) AS joint_p
FROM pp_ p JOIN st_ a ON a.k = p.source || '|' || p.seed AND a.metric = p.metric AND a.aggregation = 'mean' JOIN st_ b ON b.k = a.k AND b.metric = p.metric AND b.aggregation = 'std' JOIN jt_ j ON j.k = a.k AND j.metric = p.metric""")
def seed_tests_query(spark, sf_dir):
    """Every seeded control against the full partitions, with the p of each coefficient."""
    pairs = against_baseline(entropy_results(spark, sf_dir)).where(F.col("source").isin("permutation", "length_bucket"))
    rows = seed_tests(pairs, ["source", "seed"])
    digits = {"mean_rho": 5, "std_rho": 5, "joint_rho": 5, "mean_p": 6, "std_p": 6, "joint_p": 9}
    return rows.select("source", "seed", "metric", "n_dims", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("stability_vs_full", _AGAINST + f", sp_ AS (SELECT * FROM ab_ WHERE source LIKE 'stability%'), {_stats_sql('sp_', 'k')} " + _record_sql("k", "split_part(k, '|', 1) AS setting"))
def stability_vs_full(spark, sf_dir):
    """Partitions under other noise rules against the full ones."""
    pairs = against_baseline(entropy_results(spark, sf_dir)).where("source LIKE 'stability%'")
    return seed_records(pairs, ["source"]).withColumnRenamed("source", "setting")


@query("length_bucket_vs_full", _AGAINST + f", sp_ AS (SELECT source AS k, metric, aggregation, scale, max(r) AS r, round(avg(t), 9) AS t FROM ab_ WHERE source = 'length_bucket' GROUP BY ALL), {_stats_sql('sp_', 'k')} " + _record_sql("k", "k AS source"))
def length_bucket_vs_full(spark, sf_dir):
    """The mean curve of all seeds of the length-bucket control against the full partitions."""
    pairs = against_baseline(entropy_results(spark, sf_dir)).where("source = 'length_bucket'")
    mean = pairs.groupBy("source", "metric", "aggregation", "scale").agg(F.max("r").alias("r"), F.round(F.avg("t"), 9).alias("t"))
    return seed_records(mean, ["source"])


def strict_comparison(pairs: DataFrame, n_points: int, n_seeds: int) -> DataFrame:
    """(source, seed, metric, n_scales, rho, mae, r2) of mean curves; a variant with another number of widths, or a
    source and metric with another number of seeds, is an error."""
    mean = pairs.where("aggregation = 'mean'")
    seeds = mean.groupBy("source", "metric").agg(F.count_distinct("seed").alias("n_seeds"))
    s = pair_statistics(mean, ["source", "seed", "metric"]).join(seeds, ["source", "metric"])
    ok = (F.col("n_points") == n_points) & (F.col("n_seeds") == n_seeds)
    what = F.concat_ws(" ", F.lit("unexpected widths or seeds:"), "source", "metric", F.col("seed").cast("string"), F.col("n_points").cast("string"), F.col("n_seeds").cast("string"))
    return s.select("source", "seed", "metric", F.when(ok, F.col("n_points")).otherwise(F.raise_error(what).cast("long")).alias("n_scales"), F.round("spearman", 5).alias("rho"), r6("mae").alias("mae"), F.round("r2", 5).alias("r2"))


@query("strict_comparison", _AGAINST + f", sp_ AS (SELECT *, avg(r) OVER (PARTITION BY k, metric) AS rm FROM ab_ WHERE aggregation = 'mean' AND source IN ('permutation', 'length_bucket')), {_stats_sql('sp_', 'k')} " + """
SELECT split_part(st_.k, '|', 1) AS source, CAST(split_part(st_.k, '|', 2) AS BIGINT) AS seed, st_.metric, st_.n AS n_scales, round(rho, 5) AS rho, round(mae, 6) AS mae, round(r2, 5) AS r2
FROM st_ JOIN (SELECT k, metric, 1 - sum((t - r) ** 2) / nullif(sum((r - rm) ** 2), 0) AS r2 FROM sp_ GROUP BY k, metric) q ON st_.k = q.k AND st_.metric = q.metric""")
def strict_comparison_query(spark, sf_dir):
    pairs = against_baseline(entropy_results(spark, sf_dir)).where(F.col("source").isin("permutation", "length_bucket"))
    return strict_comparison(pairs, len(SCALES), len(SEEDS))


def merged_summary(results: DataFrame) -> DataFrame:
    """(scale, script_mean, script_std, length_mean, length_std) of one variant; a width found twice, missing in one
    metric, or with a negative deviation is an error."""
    of = lambda m, a: F.col("value").isNotNull() & (F.col("metric") == m) & (F.col("aggregation") == a)
    cells = {f"{m}_{a}": of(m, a) for m in ("script", "length") for a in ("mean", "std")}
    wide = results.groupBy("scale").agg(*[F.max(F.when(c, F.col("value"))).alias(k) for k, c in cells.items()], *[F.count(F.when(c, 1)).alias(f"n_{k}") for k, c in cells.items()])
    ok = F.lit(True)
    for k in cells:
        ok = ok & (F.col(f"n_{k}") == 1) & ((F.col(k) >= 0) if k.endswith("std") else F.lit(True))
    bad = F.raise_error(F.concat(F.lit("the summaries do not merge at width "), F.col("scale").cast("string"))).cast("int")
    return wide.select(F.when(ok, F.col("scale")).otherwise(bad).alias("scale"), *[r6(k).alias(k) for k in cells])


@query("merged_summary", _METRICS + "SELECT CAST(scale AS INT) AS scale, " + ", ".join(f"round(max(value) FILTER (WHERE metric = '{m}' AND aggregation = '{a}'), 6) AS {m}_{a}" for m in ("script", "length") for a in ("mean", "std")) + " FROM mr_ WHERE source = 'baseline' AND component = 'h' GROUP BY scale")
def merged_summary_query(spark, sf_dir):
    return merged_summary(entropy_results(spark, sf_dir).where("source = 'baseline' AND component = 'h'"))


@query("config_means", _METRICS + "SELECT metric, aggregation, round(avg(value), 6) AS mean, count(*) AS n_rows FROM mr_ WHERE source LIKE 'stability%' AND component = 'h' GROUP BY metric, aggregation")
def config_means(spark, sf_dir):
    """Means of a metric over all parameter settings and widths, with the number of rows behind them."""
    rows = entropy_results(spark, sf_dir).where("source LIKE 'stability%' AND component = 'h'")
    return rows.groupBy("metric", "aggregation").agg(r6(F.avg("value")).alias("mean"), F.count(F.lit(1)).alias("n_rows"))


def composed(pairs: DataFrame, by: list[str], weights: dict[str, float]) -> DataFrame:
    """(by, scale, r, t): the weighted mean of any number of features, over the widths that all of them have."""
    if not weights or any(not 0 <= w < float("inf") for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights are finite, not negative, and not all zero")
    total = sum(weights.values())
    w = F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v / total)]), F.col("feature"))
    return (pairs.where(F.col("feature").isin(*weights)).groupBy(*by, "scale").agg(F.count_distinct("feature").alias("n"), F.sum(w * F.col("r")).alias("r"), F.sum(w * F.col("t")).alias("t"))
            .where(F.col("n") == len(weights)).drop("n"))


WEIGHTS = {"script/mean": 3.0, "script/std": 1.0, "length/mean": 2.0, "length/std": 1.0}


@query("feature_composition", _AGAINST + ", w_ AS (" + " UNION ALL ".join(f"SELECT '{k}' AS f, {v / sum(WEIGHTS.values())!r}::DOUBLE AS w" for k, v in WEIGHTS.items()) + ") SELECT source, seed, CAST(scale AS INT) AS scale, round(sum(w * r), 6) AS r, round(sum(w * t), 6) AS t FROM ab_ JOIN w_ ON f = metric || '/' || aggregation WHERE source IN ('permutation', 'length_bucket') GROUP BY source, seed, scale HAVING count(DISTINCT f) = 4")
def feature_composition(spark, sf_dir):
    pairs = against_baseline(entropy_results(spark, sf_dir)).where(F.col("source").isin("permutation", "length_bucket"))
    rows = composed(pairs.withColumn("feature", F.concat_ws("/", "metric", "aggregation")), ["source", "seed"], WEIGHTS)
    return rows.select("source", "seed", "scale", r6("r").alias("r"), r6("t").alias("t"))


@query("projection_rho")
def projection_rho(spark, sf_dir):
    """Partitions of randomly turned matrices against the full ones, by seed."""
    folder = shared_folder(spark, "schedule")
    text = tokens(spark, sf_dir)
    base = nearest_partitions(labelled_matrix(spark, sf_dir), {"baseline": 1.0})
    results = summarised(category_entropies(base.unionByName(projected_partitions(spark, sf_dir)), text), ["h", "h_norm"])
    return seed_records(against_baseline(settled(results.coalesce(1), folder, "results")), ["source", "seed"])


@query("metric_schedule")
def metric_schedule(spark, sf_dir):
    """Orthographic similarity and script entropy of the baseline and of all seeds of the permutation control at every
    width: one job, a task being a group of rows."""
    folder = shared_folder(spark, "schedule")
    text = settled(tokens(spark, sf_dir), folder, "tokens")
    base = settled(nearest_partitions(labelled_matrix(spark, sf_dir), {"baseline": 1.0}), folder, "partitions")
    parts = base.unionByName(seeded_controls(base, text).where("source = 'permutation'"))
    named = parts.where("cluster_id >= 0").join(text.select("token_id", "token_str"), "token_id")
    similar = sampled_similarity(named, by=list(TASK)).select(*TASK, F.lit("similarity").alias("metric"), F.col("score").alias("h"))
    entropy = category_entropies(parts, text).where("metric = 'script'").select(*TASK, "metric", "h")
    return _keyed(summarised(similar.unionByName(entropy), ["h"])).withColumn("component", F.lit("score"))


# ---- case studies

ASKED = 50
#: Bytes of content that one task of a case study returns, about, and tasks that one cluster's rows go to at most.
CONTENT_BYTES, COPIES = 32 << 20, 8
#: Bytes of different contents that a Parquet column chunk holds once each.
DICTIONARY_BYTES = 32 << 20


def _repeating(spark: SparkSession) -> None:
    """Raise the session's limit on Parquet dictionaries, one megabyte, above which repeated contents are written out
    again for each row. Columns without repeats are not kept in a dictionary past their first page."""
    key = "parquet.dictionary.page.size"
    if int(spark.conf.get(key, "0")) < DICTIONARY_BYTES:
        spark.conf.set(key, str(DICTIONARY_BYTES))


def case_study(parts: DataFrame, text: DataFrame, asked: DataFrame) -> DataFrame:
    """(source, seed, scale, token_id, cluster_id, size, content): where each asked token lands in every task, with how
    many and with whom; noise has size 0 and no content. A token that is asked for twice is an error.

    Members are gathered for the clusters of asked tokens only. Contents are repeated by the asked tokens, so the rows of
    a cluster are dealt to chunks, by the bytes of all its rows, and the chunks to tasks. A content goes to a shuffle once
    for each chunk, ``COPIES`` times at most, so that the shuffle grows as the contents and not as the rows that repeat
    them; a task holds the few contents of its chunks, however many rows repeat them, and their files hold them once.
    Contents are saved when this is called."""
    twice = F.raise_error(F.concat(F.lit("a token is asked for twice: "), F.col("token_id").cast("string"))).cast("long")
    once = asked.groupBy("token_id").agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") == 1, F.col("token_id")).otherwise(twice).alias("token_id"))
    # a seed that is null is no key of a join
    key = ["source", "seed_key", "scale", "cluster_id"]
    keyed = parts.withColumn("seed_key", F.coalesce(F.col("seed").cast("string"), F.lit("")))
    at = keyed.join(once, "token_id")
    wanted = at.where("cluster_id >= 0").groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    members = keyed.join(wanted.select(*key), key, "left_semi").join(text.select("token_id", "token_str"), "token_id")
    content = F.array_join(F.array_sort(F.collect_list("token_str")), " ")
    found = settled(members.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), content.alias("content")), shared_folder(parts.sparkSession, "cases"), "contents")
    sized = found.select(*key, F.octet_length("content").cast("long").alias("bytes")).join(wanted, key).withColumn("bytes", F.col("bytes") * F.col("rows"))
    chunks = F.least(F.lit(COPIES).cast("long"), F.ceil(F.col("bytes") / CONTENT_BYTES + 1e-9)).cast("int")
    sized = settled(sized.select(*key, "bytes", chunks.alias("chunks")), shared_folder(parts.sparkSession, "cases"), "sizes")
    total, n = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("chunks"), F.lit(0))).first()
    chunk = F.pmod(F.xxhash64("token_id"), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = at.join(sized, key, "left").withColumn("chunk", chunk).select(*key, "chunk", "seed", "token_id").repartition(max(1, min(n, -(-total // CONTENT_BYTES))), *key, "chunk")
    each = found.join(sized, key).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*key, "chunk", "size", "content")
    # Spark takes the copies of a content for one, and might broadcast them
    rows = dealt.join(each.hint("merge"), [*key, "chunk"], "left")
    _repeating(parts.sparkSession)
    return rows.select(*TASK, "token_id", "cluster_id", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("content", F.lit("")).alias("content"))


@query("case_study", _TASKS + f""", m_x AS (SELECT source, seed, scale, cluster_id, count(*) AS n, string_agg(token_str, ' ' ORDER BY token_str) AS c FROM task_ JOIN text_ USING (token_id) WHERE cluster_id >= 0 GROUP BY ALL)
SELECT t.source, coalesce(CAST(t.seed AS VARCHAR), '') AS seed, CAST(t.scale AS INT) AS scale, t.token_id, CAST(t.cluster_id AS BIGINT) AS cluster_id, coalesce(n, 0) AS size, coalesce(c, '') AS content
FROM task_ t LEFT JOIN m_x m ON t.source = m.source AND t.seed IS NOT DISTINCT FROM m.seed AND t.scale = m.scale AND t.cluster_id = m.cluster_id WHERE t.token_id % {ASKED} = 0""")
def case_study_query(spark, sf_dir):
    """The tokens whose number is a multiple of ASKED, asked of all tasks over all tokens."""
    folder = shared_folder(spark, "schedule")
    text = settled(tokens(spark, sf_dir), folder, "tokens")
    parts = settled(partition_schedule(spark, sf_dir, text, folder), folder, "tasks")
    return _keyed(case_study(parts, text, text.where(F.col("token_id") % ASKED == 0).select("token_id")))
