"""Reports on saved metric results: controls by seed and by mean curve, seed means, joined curves, and what must hold of
partitions and controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.functions.scripts import length_bucket
from strataspan.operators.controls import _BUCKETED, SEED, permuted
from strataspan.operators.curves import _ALL, _TWO, _single, all_pairs_of, curve, curves, pair_statistics, r6, ranked, safe_corr
from strataspan.operators.randomized import project_all, randomized_svd
from strataspan.operators.schedule import _AGAINST, _METRICS, TASK, against_baseline, category_entropies, entropy_results, labelled_matrix, nearest_partitions, summarised, tokens, turned
from strataspan.operators.spectrum import moments, orthogonal_basis
from strataspan.operators.results import metric_results
from strataspan.plans.registry import query
from strataspan.sources.store import settled, shared_folder
from strataspan.sources.tables import PARTITION_SQL, numbered, partition, read, vocab

# The seeds of the ten-seed controls, and those of the randomised components.
TEN_SEEDS = (1813382118, 827307999, 1627694678, 1911784257, 903170602, 86939546, 556019485, 2073320061, 1097954097, 1043521778)
COMPONENT_SEEDS = (0, 42, 1000, 9999, 1813382118, 827307999, 1627694678, 1911784257)

# ---- controls against the baseline


def control_reports(pairs: DataFrame) -> DataFrame:
    """(control, seed, metric, aggregation, n_points, mae, r2, rho) of (source, seed, metric, aggregation, scale, r, t): a
    row for each seed, and one for the mean curve of all seeds, whose seed is null."""
    key = ["control", "seed", "metric", "aggregation"]
    named = pairs.select(F.col("source").alias("control"), F.coalesce(F.col("seed").cast("string"), F.lit("-")).alias("seed"), "metric", "aggregation", "scale", "r", "t")
    mean = named.groupBy("control", "metric", "aggregation", "scale").agg(F.max("r").alias("r"), F.round(F.avg("t"), 9).alias("t")).withColumn("seed", F.lit("mean"))
    rows = pair_statistics(named.unionByName(mean), key)
    return rows.select(*key, "n_points", r6("mae").alias("mae"), F.round("r2", 5).alias("r2"), F.round("spearman", 5).alias("rho"))


@query("control_reports", _AGAINST + """, nm_ AS (SELECT source AS control, coalesce(CAST(seed AS VARCHAR), '-') AS seed, metric, aggregation, scale, r, t FROM ab_),
al_ AS (SELECT * FROM nm_ UNION ALL SELECT control, 'mean', metric, aggregation, scale, max(r), round(avg(t), 9) FROM nm_ GROUP BY control, metric, aggregation, scale),
rk_ AS (SELECT *, avg(r) OVER w AS rm, rank() OVER (PARTITION BY control, seed, metric, aggregation ORDER BY r) + (count(*) OVER (PARTITION BY control, seed, metric, aggregation, r) - 1) / 2 AS rr,
 rank() OVER (PARTITION BY control, seed, metric, aggregation ORDER BY t) + (count(*) OVER (PARTITION BY control, seed, metric, aggregation, t) - 1) / 2 AS tr FROM al_ WINDOW w AS (PARTITION BY control, seed, metric, aggregation))
SELECT control, seed, metric, aggregation, count(*) AS n_points, round(avg(abs(t - r)), 6) AS mae, round(1 - sum((t - r) ** 2) / nullif(sum((r - rm) ** 2), 0), 5) AS r2,
 round(CASE WHEN min(r) < max(r) AND min(t) < max(t) THEN corr(rr, tr) END, 5) AS rho FROM rk_ GROUP BY control, seed, metric, aggregation""")
def control_reports_query(spark, sf_dir):
    """Permutations, length buckets and other noise rules against the full partitions."""
    return control_reports(against_baseline(entropy_results(spark, sf_dir)))


def sketched_partitions(spark: SparkSession, sf_dir: str, scales: tuple[int, ...], turns: tuple[int, ...] = TEN_SEEDS, components: tuple[int, ...] = COMPONENT_SEEDS) -> DataFrame:
    """(source, seed, scale, token_id, cluster_id) of random projections and of randomised principal components, every
    seed of both: partitions by the nearest mean, as of the matrix itself."""
    rows = labelled_matrix(spark, sf_dir)
    _, total, n = moments(rows)
    bases = {seed: orthogonal_basis(len(total), seed) for seed in turns}
    projected = nearest_partitions(turned(rows, bases, total / max(n, 1)), {"projection": 1.0}, scales)
    # components of each scale and seed are fitted by themselves; a scale's rows have its columns only
    sketches = randomized_svd(rows, [(k, s) for k in scales for s in components], centred=True)
    scores = project_all(rows, sketches).join(rows.select("row_id", "label"), "row_id").withColumnRenamed("scale", "k")
    out = projected
    for k in scales:  # widths differ, so their means do: one pass for each of a few
        one = nearest_partitions(scores.where(F.col("k") == k).drop("k"), {"components": 1.0}, (k,))
        out = out.unionByName(one)
    return out


@query("sketch_reports")
def sketch_reports(spark, sf_dir, scales: tuple[int, ...] = (4, 8, 16, 32)):
    """Random projections (ten seeds) and randomised components (eight) against the full partitions."""
    folder = shared_folder(spark, "sketches")
    base = nearest_partitions(labelled_matrix(spark, sf_dir), {"baseline": 1.0}, scales)
    parts = settled(base.unionByName(sketched_partitions(spark, sf_dir, scales)), folder, "partitions")
    results = settled(summarised(category_entropies(parts, tokens(spark, sf_dir)), ["h", "h_norm"]).coalesce(1), folder, "results")
    return control_reports(against_baseline(results))


# ---- seeds and curves


@query("seed_means", _METRICS + """, w_ AS (SELECT source, seed, scale, metric, max(value) FILTER (WHERE component = 'h' AND aggregation = 'count') AS n, max(value) FILTER (WHERE component = 'h' AND aggregation = 'mean') AS mh, max(value) FILTER (WHERE component = 'h' AND aggregation = 'std') AS sh,
 max(value) FILTER (WHERE component = 'h_norm' AND aggregation = 'mean') AS mn, max(value) FILTER (WHERE component = 'h_norm' AND aggregation = 'std') AS sn FROM mr_ WHERE seed IS NOT NULL GROUP BY source, seed, scale, metric)
SELECT source, CAST(scale AS INT) AS scale, metric, count(*) AS n_seeds, CAST(round_even(avg(n), 0) AS BIGINT) AS num_clusters, round(avg(mh), 6) AS mean_h, round(avg(sh), 6) AS std_h, round(avg(mn), 6) AS mean_h_norm, round(avg(sn), 6) AS std_h_norm,
 round(stddev_samp(mh), 6) + 0.0 AS mean_h_over_seeds, round(stddev_samp(mn), 6) + 0.0 AS mean_h_norm_over_seeds FROM w_ GROUP BY source, scale, metric""")
def seed_means(spark, sf_dir):
    """The summaries of all seeds of a control as one: every column's mean, the number of clusters to the nearest even
    integer, and the deviations of the means over the seeds."""
    rows = entropy_results(spark, sf_dir).where("seed IS NOT NULL")
    of = lambda c, a: F.max(F.when((F.col("component") == c) & (F.col("aggregation") == a), F.col("value")))
    wide = rows.groupBy(*TASK, "metric").agg(of("h", "count").alias("n"), of("h", "mean").alias("mean_h"), of("h", "std").alias("std_h"), of("h_norm", "mean").alias("mean_h_norm"), of("h_norm", "std").alias("std_h_norm"))
    names = ("mean_h", "std_h", "mean_h_norm", "std_h_norm")
    return wide.groupBy("source", "scale", "metric").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.bround(F.avg("n"), 0).cast("long").alias("num_clusters"), *[r6(F.avg(c)).alias(c) for c in names],
        *[(r6(F.stddev_samp(c)) + 0.0).alias(f"{c}_over_seeds") for c in ("mean_h", "mean_h_norm")])


@query("joined_curves", _METRICS + """SELECT a.source, coalesce(CAST(a.seed AS VARCHAR), '') AS seed, CAST(a.scale AS INT) AS scale, a.aggregation, round(a.value, 6) AS script, round(b.value, 6) AS length, round(a.value - b.value, 6) + 0.0 AS gap
FROM mr_ a JOIN mr_ b ON a.source = b.source AND a.seed IS NOT DISTINCT FROM b.seed AND a.scale = b.scale AND a.aggregation = b.aggregation AND a.component = b.component WHERE a.metric = 'script' AND b.metric = 'length' AND a.component = 'h' AND a.aggregation IN ('mean', 'std')""")
def joined_curves(spark, sf_dir):
    """The curves of two metrics side by side, width by width."""
    rows = entropy_results(spark, sf_dir).where("component = 'h' AND aggregation IN ('mean', 'std')").withColumn("seed", F.coalesce(F.col("seed").cast("string"), F.lit("")))
    one = lambda m: rows.where(F.col("metric") == m).select(*TASK, "aggregation", F.col("value").alias(m))
    both = one("script").join(one("length"), [*TASK, "aggregation"])
    return both.select(*TASK, "aggregation", r6("script").alias("script"), r6("length").alias("length"), (r6(F.col("script") - F.col("length")) + 0.0).alias("gap"))


def fully_matched(reference: DataFrame, target: DataFrame) -> DataFrame:
    """(scale, reference_value, target_value) of two curves that have the same widths, once each; anything else is an error."""
    a, b = _single(reference, "reference_value"), _single(target, "target_value")
    lost = F.raise_error(F.concat(F.lit("only one curve has width "), F.col("scale").cast("string"))).cast("int")
    whole = F.col("reference_value").isNotNull() & F.col("target_value").isNotNull()
    return a.join(b, "scale", "full_outer").select(F.when(whole, F.col("scale")).otherwise(lost).alias("scale"), "reference_value", "target_value")


@query("matched_curves", _TWO + "SELECT CAST(coalesce(ref.scale, tgt.scale) AS INT) AS scale, round(ref.value, 6) AS reference_value, round(tgt.value, 6) AS target_value FROM ref FULL JOIN tgt ON ref.scale = tgt.scale")
def matched_curves(spark, sf_dir):
    m = metric_results(spark, sf_dir)
    return fully_matched(curve(m, "script", "mean"), curve(m, "script", "mean", 0)).select("scale", r6("reference_value").alias("reference_value"), r6("target_value").alias("target_value"))


def coefficients(results: DataFrame, coefficient: str) -> DataFrame:
    """(a, b, value): the complete symmetric matrix of one coefficient, ``pearson`` or ``spearman``, in long form."""
    if coefficient not in ("pearson", "spearman"):
        raise ValueError(f"a matrix holds pearson or spearman, not {coefficient}")
    pairs = ranked(all_pairs_of(results), ["a", "b"]) if coefficient == "spearman" else all_pairs_of(results)
    x, y = ("rr", "tr") if coefficient == "spearman" else ("r", "t")
    half = pairs.groupBy("a", "b").agg(safe_corr(x, y).alias("value"))
    names = curves(results).select(F.col("curve").alias("a"), F.col("curve").alias("b"), F.lit(1.0).alias("value")).distinct()
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")).unionByName(names)


@query("rank_matrix", _ALL + """, rk_ AS (SELECT x.curve AS a, y.curve AS b, x.value AS r, y.value AS t FROM cv x JOIN cv y ON x.scale = y.scale AND x.curve < y.curve),
rr_ AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY r) + (count(*) OVER (PARTITION BY a, b, r) - 1) / 2 AS rr, rank() OVER (PARTITION BY a, b ORDER BY t) + (count(*) OVER (PARTITION BY a, b, t) - 1) / 2 AS tr FROM rk_),
sp_ AS (SELECT a, b, round(CASE WHEN min(r) < max(r) AND min(t) < max(t) THEN corr(rr, tr) END, 5) AS value FROM rr_ GROUP BY a, b)
SELECT a, b, value FROM sp_ UNION ALL SELECT b, a, value FROM sp_ UNION ALL SELECT DISTINCT curve, curve, 1.0 FROM cv""")
def rank_matrix(spark, sf_dir):
    """Spearman's coefficient of all curves with all others."""
    return coefficients(metric_results(spark, sf_dir), "spearman").withColumn("value", F.round("value", 5))


# ---- partitions


def assigned(rows: DataFrame) -> DataFrame:
    """Rows in clusters; that there are none is an error."""
    some = rows.agg(F.count(F.when(F.col("cluster_id") >= 0, 1)).alias("n"))
    none = F.raise_error(F.lit("the partition has no cluster")).cast("long")
    # the check's one row stays even where no row does, and raises there
    kept = rows.where("cluster_id >= 0").withColumn("__here", F.lit(True))
    return some.join(kept, F.lit(True), "left").withColumn("cluster_id", F.when(F.col("n") > 0, F.col("cluster_id")).otherwise(none)).where("__here").select(*rows.columns)


@query("assigned_rows", f"WITH {PARTITION_SQL} SELECT token_id, cluster_id FROM part_a WHERE cluster_id >= 0")
def assigned_rows(spark, sf_dir):
    return assigned(partition(spark, sf_dir).select("token_id", "cluster_id"))


@query("cluster_orders", f"WITH {PARTITION_SQL}" + """, s_ AS (SELECT cluster_id, count(*) AS n, avg(CAST(probability AS DOUBLE)) AS p FROM part_a WHERE cluster_id >= 0 GROUP BY cluster_id)
SELECT cluster_id, n, round(p, 6) AS mean_prob, CAST(row_number() OVER (ORDER BY cluster_id) AS INT) AS by_id, CAST(row_number() OVER (ORDER BY n DESC, cluster_id) AS INT) AS by_size, CAST(row_number() OVER (ORDER BY round(p, 9) DESC, cluster_id) AS INT) AS by_probability FROM s_""")
def cluster_orders(spark, sf_dir):
    """Three orders of the clusters: by number, by size, by mean membership; ties go to the smaller number."""
    rows = partition(spark, sf_dir).where("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("probability").cast("double")).alias("p"))
    for name, order in (("by_id", F.col("cluster_id")), ("by_size", F.struct(-F.col("n"), "cluster_id")), ("by_probability", F.struct(-F.round("p", 9), "cluster_id"))):
        rows = numbered(rows, [], order, name).withColumn(name, F.col(name).cast("int"))
    return rows.select("cluster_id", "n", r6("p").alias("mean_prob"), "by_id", "by_size", "by_probability")


def invariance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_tokens, same_ids, same_partition, noise_mismatches, max_probability_difference) of two partitions (token_id,
    cluster_id, probability): whether they are one up to the names of the clusters."""
    def named(rows: DataFrame) -> DataFrame:
        first = rows.where("cluster_id >= 0").groupBy("cluster_id").agg(F.min("token_id").alias("first"))
        return rows.join(first, "cluster_id", "left").select("token_id", F.coalesce("first", F.lit(-1)).alias("k"), F.col("probability").cast("double").alias("p"))

    x, y = named(a).alias("x"), named(b).alias("y")
    both = x.join(y, F.col("x.token_id") == F.col("y.token_id"), "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    alone = F.col("x.token_id").isNull() | F.col("y.token_id").isNull()
    return both.agg(
        F.count(F.lit(1)).alias("n_tokens"), (n(alone) == 0).alias("same_ids"), (n(alone | (F.col("x.k") != F.col("y.k"))) == 0).alias("same_partition"),
        n((F.col("x.k") == -1) != (F.col("y.k") == -1)).alias("noise_mismatches"), F.round(F.max(F.abs(F.col("x.p") - F.col("y.p"))), 6).alias("max_probability_difference"))


@query("partition_invariance", """WITH a_ AS (SELECT vec_id AS token_id, CAST(label - 1 AS BIGINT) AS c, CAST(CAST(abs(embedding[1]) AS FLOAT) AS DOUBLE) AS p FROM embeddings),
b_ AS (SELECT vec_id AS token_id, CASE WHEN label = 0 THEN -1 ELSE CAST((label * 7) % 11 AS BIGINT) END AS c, CAST(CAST(abs(embedding[2]) AS FLOAT) AS DOUBLE) AS p FROM embeddings),
ka AS (SELECT *, CASE WHEN c < 0 THEN -1 ELSE min(token_id) OVER (PARTITION BY c) END AS k FROM a_), kb AS (SELECT *, CASE WHEN c < 0 THEN -1 ELSE min(token_id) OVER (PARTITION BY c) END AS k FROM b_)
SELECT count(*) AS n_tokens, count(*) FILTER (WHERE ka.token_id IS NULL OR kb.token_id IS NULL) = 0 AS same_ids, count(*) FILTER (WHERE ka.token_id IS NULL OR kb.token_id IS NULL OR ka.k <> kb.k) = 0 AS same_partition,
count(*) FILTER (WHERE (ka.k = -1) <> (kb.k = -1)) AS noise_mismatches, round(max(abs(ka.p - kb.p)), 6) AS max_probability_difference FROM ka FULL JOIN kb ON ka.token_id = kb.token_id""")
def partition_invariance(spark, sf_dir):
    """A partition and itself under other names, with memberships of another column."""
    other = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("token_id"), F.when(F.col("label") == 0, -1).otherwise(F.col("label") * 7 % 11).cast("long").alias("cluster_id"), F.abs(F.get("embedding", F.lit(1))).cast("float").alias("probability"))
    return invariance(partition(spark, sf_dir), other)


@query("bucket_invariants", _BUCKETED + """, p AS (SELECT token_id AS old_id, new_id AS token_id, cluster_id, bucket FROM seats JOIN drawn USING (bucket, seat)),
b_ AS (SELECT token_id, CASE WHEN length(token_str) <= 2 THEN '1-2' WHEN length(token_str) <= 5 THEN '3-5' WHEN length(token_str) <= 10 THEN '6-10' ELSE '11+' END AS own FROM vocab)
SELECT (SELECT count(*) FROM p) = (SELECT count(*) FROM k) AS same_rows, (SELECT count(DISTINCT token_id) FROM p) = (SELECT count(*) FROM p) AS unique_ids,
NOT EXISTS (SELECT 1 FROM p JOIN b_ USING (token_id) WHERE own <> bucket) AS same_bucket_per_seat,
NOT EXISTS (SELECT cluster_id, bucket, count(*) FROM p GROUP BY 1, 2 EXCEPT SELECT cluster_id, bucket, count(*) FROM k GROUP BY 1, 2) AS same_sizes, (SELECT count(*) FROM p WHERE old_id <> token_id) AS n_moved""")
def bucket_invariants(spark, sf_dir):
    """What a permutation inside length buckets keeps: rows, ids, the bucket of every seat, and every cluster's buckets."""
    words = settled(vocab(spark, sf_dir).select("token_id", "cluster_id", length_bucket(F.col("token_str")).alias("bucket")), shared_folder(spark, "controls"), "words")
    before = words.where("cluster_id >= 0")
    after = permuted(words, SEED, ["bucket"]).select("old_id", "token_id", "cluster_id", "bucket")
    own = after.join(words.select("token_id", F.col("bucket").alias("own")), "token_id")
    ids = own.groupBy("token_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("own") != F.col("bucket")).cast("int")).alias("strange"), F.max((F.col("old_id") != F.col("token_id")).cast("int")).alias("moved"))
    a = ids.agg(F.sum("n").alias("rows"), (F.max("n") == 1).alias("unique_ids"), (F.max("strange") == 0).alias("same_bucket_per_seat"), F.sum("moved").alias("n_moved"))
    side = before.select("cluster_id", "bucket", F.lit(1).alias("s")).unionByName(after.select("cluster_id", "bucket", F.lit(-1).alias("s")))
    b = side.groupBy("cluster_id", "bucket").agg(F.sum("s").alias("s")).agg((F.max(F.abs("s")) == 0).alias("same_sizes"))
    c = before.agg(F.count(F.lit(1)).alias("want"))
    return a.join(b).join(c).select((F.col("rows") == F.col("want")).alias("same_rows"), "unique_ids", "same_bucket_per_seat", "same_sizes", "n_moved")


def dense_low_domain(chosen: list[int], main: list[int], n: int = 12) -> list[int]:
    """The low-domain scales, if they are ``n`` different ones in rising order and none is a main scale."""
    if len(chosen) != n or any(b <= a for a, b in zip(chosen, chosen[1:])):
        raise ValueError(f"{n} scales are wanted, each larger than the one before: {chosen}")
    if shared := sorted(set(chosen) & set(main)):
        raise ValueError(f"main scales among the low ones: {shared}")
    return chosen
