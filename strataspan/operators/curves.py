"""Curves over widths: selection, alignment, seed aggregation, pairwise statistics, composition and reports."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspan.operators.results import METRIC_SQL, metric_results
from strataspan.plans.registry import query
from strataspan.sources.tables import SEEDS

_M = f"WITH {METRIC_SQL} "
NEAR_ZERO = 1e-12


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def variant() -> Column:
    return F.coalesce(F.col("seed").cast("string"), F.lit("baseline")).alias("variant")


def curve(results: DataFrame, metric: str, aggregation: str, seed: int | None = None) -> DataFrame:
    """(scale, value) of one curve; seeds compare null-safely."""
    return results.where((F.col("metric") == metric) & (F.col("aggregation") == aggregation) & F.col("seed").eqNullSafe(F.lit(seed).cast("long"))).select("scale", "value")


def strict_curve(results: DataFrame, metric: str, aggregation: str, seed: int | None = None) -> DataFrame:
    """(scale, value) of the one curve that a query means: none, several spaces or methods, or a width twice is an error."""
    rows = results.where((F.col("metric") == metric) & (F.col("aggregation") == aggregation) & F.col("seed").eqNullSafe(F.lit(seed).cast("long")))
    kinds = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("space_name", "partition_method").alias("k")).first()
    if not kinds["n"]:
        raise ValueError("the query meets no curve")
    if kinds["k"] > 1:
        raise ValueError("the query is ambiguous: it meets several spaces or methods")
    return _single(rows.select("scale", "value"), "value")


def _single(rows: DataFrame, name: str) -> DataFrame:
    """(scale, name) of a curve's points; a width that is found twice is an error."""
    one = rows.groupBy("scale").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("v"))
    twice = F.raise_error(F.concat(F.lit("a curve has this width twice: "), F.col("scale").cast("string"))).cast("double")
    return one.select("scale", F.when(F.col("n") == 1, F.col("v")).otherwise(twice).alias(name))


def curves(results: DataFrame) -> DataFrame:
    """(curve, metric, aggregation, seed, scale, value) of the mean and deviation curves."""
    kept = results.where(F.col("aggregation").isin("mean", "std"))
    name = F.concat_ws("/", "metric", "aggregation", F.coalesce(F.col("seed").cast("string"), F.lit("baseline")))
    return kept.select(name.alias("curve"), "metric", "aggregation", "seed", "scale", "value")


_CURVES = _M + ", cv AS (SELECT metric || '/' || aggregation || '/' || coalesce(CAST(seed AS VARCHAR), 'baseline') AS curve, metric, aggregation, seed, scale, value FROM mr WHERE aggregation IN ('mean', 'std')) "


@query("metric_results", _M + "SELECT metric, CAST(scale AS INT) AS scale, coalesce(CAST(seed AS VARCHAR), 'baseline') AS variant, aggregation, round(value, 6) AS value FROM mr")
def metric_results_query(spark, sf_dir):
    return metric_results(spark, sf_dir).select("metric", "scale", variant(), "aggregation", r6("value").alias("value"))


@query("curve_select", _M + "SELECT CAST(scale AS INT) AS scale, round(value, 6) AS value FROM mr WHERE metric = 'script' AND aggregation = 'mean' AND seed IS NOT DISTINCT FROM NULL")
def curve_select(spark, sf_dir):
    return strict_curve(metric_results(spark, sf_dir), "script", "mean").select("scale", r6("value").alias("value"))


@query("curve_ids", _CURVES + "SELECT curve, sha256(curve) AS curve_id, CAST(count(*) AS BIGINT) AS n_points, CAST(min(scale) AS INT) AS first_scale, CAST(max(scale) AS INT) AS last_scale FROM cv GROUP BY curve")
def curve_ids(spark, sf_dir):
    return curves(metric_results(spark, sf_dir)).groupBy("curve").agg(F.count(F.lit(1)).alias("n_points"), F.min("scale").alias("first_scale"), F.max("scale").alias("last_scale")).withColumn("curve_id", F.sha2("curve", 256))


def align(reference: DataFrame, target: DataFrame, how: str) -> DataFrame:
    """(scale, reference_value, target_value) over the widths of both: ``exact`` wants equal widths, ``intersection`` takes
    the common ones and wants some, ``reference`` wants all widths of the reference in the target. What does not meet
    that is an error, raised where the rows are read (for an empty intersection at once)."""
    if how not in ("exact", "intersection", "reference"):
        raise ValueError(f"unknown alignment {how}")
    a, b = _single(reference, "reference_value").withColumn("in_a", F.lit(True)), _single(target, "target_value").withColumn("in_b", F.lit(True))
    both = a.join(b, "scale", {"exact": "full_outer", "intersection": "inner", "reference": "left"}[how])
    if how == "intersection" and both.isEmpty():
        raise ValueError("the curves have no common width")
    missing = F.raise_error(F.concat(F.lit(f"{how} alignment: one curve lacks width "), F.col("scale").cast("string"))).cast("int")
    scale = F.when(F.col("in_a") & F.col("in_b"), F.col("scale")).otherwise(missing)
    return both.select(scale.alias("scale"), "reference_value", "target_value")


def unmatched(reference: DataFrame, target: DataFrame) -> DataFrame:
    """(scale, side): scales that only one of two curves has."""
    a, b = reference.select("scale", F.lit(1).alias("a")), target.select("scale", F.lit(1).alias("b"))
    return a.join(b, "scale", "full_outer").where("a IS NULL OR b IS NULL").select("scale", F.when(F.col("b").isNull(), "reference").otherwise("target").alias("side"))


def _short(results: DataFrame) -> DataFrame:
    """A curve that lacks the smallest and has no value over 32: alignment has something to leave out."""
    return curve(results, "script", "mean", 0).where("scale BETWEEN 4 AND 32")


_TWO = _M + ", ref AS (SELECT scale, value FROM mr WHERE metric = 'script' AND aggregation = 'mean' AND seed IS NULL), tgt AS (SELECT scale, value FROM mr WHERE metric = 'script' AND aggregation = 'mean' AND seed = 0), short_ AS (SELECT * FROM tgt WHERE scale BETWEEN 4 AND 32) "
_VALUES = "CAST(ref.scale AS INT) AS scale, round(ref.value, 6) AS reference_value, round(t.value, 6) AS target_value"


def _rounded(pair: DataFrame) -> DataFrame:
    return pair.select("scale", r6("reference_value").alias("reference_value"), r6("target_value").alias("target_value"))


@query("align_exact", _TWO + f"SELECT {_VALUES} FROM ref JOIN tgt t ON ref.scale = t.scale")
def align_exact(spark, sf_dir):
    m = metric_results(spark, sf_dir)
    return _rounded(align(curve(m, "script", "mean"), curve(m, "script", "mean", 0), "exact"))


@query("align_intersection", _TWO + f"SELECT {_VALUES} FROM ref JOIN short_ t ON ref.scale = t.scale")
def align_intersection(spark, sf_dir):
    m = metric_results(spark, sf_dir)
    return _rounded(align(curve(m, "script", "mean"), _short(m), "intersection"))


@query("align_reference", _TWO + f"SELECT {_VALUES.replace('t.value', 'x').replace('ref.', 't.').replace('round(x', 'round(ref.value')} FROM short_ t LEFT JOIN ref ON ref.scale = t.scale")
def align_reference(spark, sf_dir):
    m = metric_results(spark, sf_dir)
    return _rounded(align(_short(m), curve(m, "script", "mean"), "reference"))


@query("outer_mismatch", _TWO + "SELECT CAST(coalesce(ref.scale, t.scale) AS INT) AS scale, CASE WHEN t.scale IS NULL THEN 'reference' ELSE 'target' END AS side FROM ref FULL JOIN short_ t ON ref.scale = t.scale WHERE ref.scale IS NULL OR t.scale IS NULL")
def outer_mismatch(spark, sf_dir):
    m = metric_results(spark, sf_dir)
    return unmatched(curve(m, "script", "mean"), _short(m))


@query("pivot_mean_std", _M + "SELECT metric, CAST(scale AS INT) AS scale, coalesce(CAST(seed AS VARCHAR), 'baseline') AS variant, round(max(value) FILTER (WHERE aggregation = 'mean'), 6) AS mean, round(max(value) FILTER (WHERE aggregation = 'std'), 6) AS std FROM mr GROUP BY metric, scale, seed")
def pivot_mean_std(spark, sf_dir):
    wide = metric_results(spark, sf_dir).groupBy("metric", "scale", "seed").pivot("aggregation", ["mean", "std"]).agg(F.first("value"))
    return wide.select("metric", "scale", variant(), r6("mean").alias("mean"), r6("std").alias("std"))


@query("seed_aggregate", _M + """SELECT metric, aggregation, CAST(scale AS INT) AS scale, CAST(count(DISTINCT seed) AS BIGINT) AS n_seeds, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) + 0.0 AS std,
count(*) = count(DISTINCT seed) AS unique_seeds FROM mr WHERE seed IS NOT NULL GROUP BY metric, aggregation, scale""")
def seed_aggregate(spark, sf_dir):
    """Means and sample deviations over the seeds of each width; a group without exactly the expected seeds is an error."""
    s = metric_results(spark, sf_dir).where("seed IS NOT NULL").groupBy("metric", "aggregation", "scale")
    own = F.array_sort(F.collect_set("seed"))
    expected = F.array(*[F.lit(k).cast("long") for k in sorted(SEEDS)])
    wrong = F.raise_error(F.concat(F.lit("unexpected seeds "), own.cast("string"))).cast("long")
    return s.agg(F.when(own == expected, F.count_distinct("seed")).otherwise(wrong).alias("n_seeds"), r6(F.avg("value")).alias("mean"), r6(F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("std"), (F.count(F.lit(1)) == F.count_distinct("seed")).alias("unique_seeds"))


@query("seed_mean_rounded", _M + "SELECT metric, CAST(scale AS INT) AS scale, CAST(round_even(avg(value), 0) AS BIGINT) AS n_clusters FROM mr WHERE aggregation = 'count' AND seed IS NOT NULL GROUP BY metric, scale")
def seed_mean_rounded(spark, sf_dir):
    return metric_results(spark, sf_dir).where("aggregation = 'count' AND seed IS NOT NULL").groupBy("metric", "scale").agg(F.bround(F.avg("value"), 0).cast("long").alias("n_clusters"))


@query("cross_scale_mean_std", _M + """, per AS (SELECT metric, seed, avg(value) AS m FROM mr WHERE aggregation = 'mean' AND seed IS NOT NULL GROUP BY metric, seed)
SELECT metric, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) + 0.0 AS std_of_seed_means FROM per GROUP BY metric""")
def cross_scale_mean_std(spark, sf_dir):
    per = metric_results(spark, sf_dir).where("aggregation = 'mean' AND seed IS NOT NULL").groupBy("metric", "seed").agg(F.avg("value").alias("m"))
    return per.groupBy("metric").agg(r6(F.avg("m")).alias("mean"), r6(F.stddev_pop("m")).alias("std_of_seed_means"))


@query("curve_band", _M + "SELECT metric, CAST(scale AS INT) AS scale, round(avg(value), 6) AS mean, round(avg(value) - coalesce(stddev_samp(value), 0), 6) AS low, round(avg(value) + coalesce(stddev_samp(value), 0), 6) AS high FROM mr WHERE aggregation = 'mean' AND seed IS NOT NULL GROUP BY metric, scale")
def curve_band(spark, sf_dir):
    sd = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    return metric_results(spark, sf_dir).where("aggregation = 'mean' AND seed IS NOT NULL").groupBy("metric", "scale").agg(r6(F.avg("value")).alias("mean"), r6(F.avg("value") - sd).alias("low"), r6(F.avg("value") + sd).alias("high"))


# ---- statistics of aligned pairs


def ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Average ranks of both values inside each pair; a pair has one row for each width."""
    def rank(c: str) -> Column:
        w = W.partitionBy(*by).orderBy(c)
        return F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy(*by, c)) - 1) / 2

    return pairs.withColumn("rr", rank("r")).withColumn("tr", rank("t"))


def safe_corr(x: str, y: str) -> Column:
    """Pearson's r, by central moments; null where an input is constant, for which ``corr`` divides by zero."""
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varies, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def pair_statistics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n_points, pearson, spearman, mae and r2 (reference as truth) of (r, t) rows in each group."""
    mean = pairs.groupBy(*by).agg(F.avg("r").alias("rm"))
    rows = ranked(pairs, by).join(mean, by)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_points"), safe_corr("r", "t").alias("pearson"), safe_corr("rr", "tr").alias("spearman"), F.avg(F.abs(F.col("t") - F.col("r"))).alias("mae"),
        (1 - F.sum(F.pow(F.col("t") - F.col("r"), 2)) / F.nullif(F.sum(F.pow(F.col("r") - F.col("rm"), 2)), F.lit(0.0))).alias("r2"))


def reference_pairs(results: DataFrame) -> DataFrame:
    """(metric, aggregation, seed, scale, r, t): each seeded curve against the baseline of its kind."""
    c = curves(results)
    base = c.where("seed IS NULL").select("metric", "aggregation", "scale", F.col("value").alias("r"))
    return c.where("seed IS NOT NULL").select("metric", "aggregation", "seed", "scale", F.col("value").alias("t")).join(base, ["metric", "aggregation", "scale"])


_REF = _CURVES + """, rp AS (SELECT c.metric, c.aggregation, c.seed, c.scale, b.value AS r, c.value AS t FROM cv c JOIN cv b ON c.metric = b.metric AND c.aggregation = b.aggregation AND c.scale = b.scale AND b.seed IS NULL WHERE c.seed IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY metric, aggregation, seed ORDER BY r) + (count(*) OVER (PARTITION BY metric, aggregation, seed, r) - 1) / 2 AS rr, rank() OVER (PARTITION BY metric, aggregation, seed ORDER BY t) + (count(*) OVER (PARTITION BY metric, aggregation, seed, t) - 1) / 2 AS tr,
 avg(r) OVER (PARTITION BY metric, aggregation, seed) AS rm FROM rp),
st AS (SELECT metric, aggregation, seed, count(*) AS n_points, CASE WHEN min(r) < max(r) AND min(t) < max(t) THEN corr(r, t) END AS pearson, CASE WHEN min(r) < max(r) AND min(t) < max(t) THEN corr(rr, tr) END AS spearman,
 avg(abs(t - r)) AS mae, 1 - sum((t - r) ** 2) / nullif(sum((r - rm) ** 2), 0) AS r2 FROM rk GROUP BY metric, aggregation, seed) """


@query("reference_only", _REF + "SELECT metric, aggregation, CAST(seed AS BIGINT) AS seed, CAST(n_points AS BIGINT) AS n_points, round(pearson, 5) AS pearson, round(spearman, 5) AS spearman, round(mae, 6) AS mae, round(r2, 5) AS r2 FROM st")
def reference_only(spark, sf_dir):
    s = pair_statistics(reference_pairs(metric_results(spark, sf_dir)), ["metric", "aggregation", "seed"])
    return s.select("metric", "aggregation", "seed", "n_points", F.round("pearson", 5).alias("pearson"), F.round("spearman", 5).alias("spearman"), r6("mae").alias("mae"), F.round("r2", 5).alias("r2"))


for _name, _digits in (("pearson", 5), ("spearman", 5), ("mae", 6), ("r2", 5)):
    @query(_name, _REF + f"SELECT CAST(seed AS BIGINT) AS seed, round({_name}, {_digits}) AS value FROM st WHERE metric = 'script' AND aggregation = 'mean'")
    def _statistic(spark, sf_dir, name=_name, digits=_digits):
        pairs = reference_pairs(metric_results(spark, sf_dir)).where("metric = 'script' AND aggregation = 'mean'")
        return pair_statistics(pairs, ["seed"]).select("seed", F.round(name, digits).alias("value"))


def all_pairs_of(results: DataFrame) -> DataFrame:
    """(a, b, scale, r, t) of all unordered pairs of curves (a bounded number: they are results of tasks, not rows)."""
    c = curves(results).select("curve", "scale", "value")
    return c.select(F.col("curve").alias("a"), "scale", F.col("value").alias("r")).join(c.select(F.col("curve").alias("b"), "scale", F.col("value").alias("t")), "scale").where("a < b")


_ALL = _CURVES + ", ap AS (SELECT x.curve AS a, y.curve AS b, x.value AS r, y.value AS t FROM cv x JOIN cv y ON x.scale = y.scale AND x.curve < y.curve), pc AS (SELECT a, b, count(*) AS n_points, CASE WHEN min(r) < max(r) AND min(t) < max(t) THEN corr(r, t) END AS pearson, avg(abs(t - r)) AS mae FROM ap GROUP BY a, b) "


@query("all_pairs", _ALL + "SELECT a, b, CAST(n_points AS BIGINT) AS n_points, round(pearson, 5) AS pearson, round(mae, 6) AS mae FROM pc")
def all_pairs(spark, sf_dir):
    p = all_pairs_of(metric_results(spark, sf_dir)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_points"), F.round(safe_corr("r", "t"), 5).alias("pearson"), r6(F.avg(F.abs(F.col("t") - F.col("r")))).alias("mae"))
    return p


@query("correlation_matrix", _ALL + "SELECT a, b, round(pearson, 5) AS pearson FROM pc UNION ALL SELECT b, a, round(pearson, 5) FROM pc UNION ALL SELECT DISTINCT curve, curve, 1.0 FROM cv")
def correlation_matrix(spark, sf_dir):
    """The complete symmetric matrix in long form."""
    m = metric_results(spark, sf_dir)
    half = all_pairs_of(m).groupBy("a", "b").agg(F.round(safe_corr("r", "t"), 5).alias("pearson"))
    names = curves(m).select("curve").distinct()
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "pearson")).unionByName(names.select(F.col("curve").alias("a"), F.col("curve").alias("b"), F.lit(1.0).alias("pearson")))


# ---- composition


def zscored(pairs: DataFrame, by: list[str]) -> DataFrame:
    """r and t standardised by the reference's mean and population deviation; a constant reference is centred only."""
    fit = pairs.groupBy(*by).agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    unit = F.when(F.col("s") < NEAR_ZERO, 1.0).otherwise(F.col("s"))
    return pairs.join(fit, by).withColumn("r", (F.col("r") - F.col("m")) / unit).withColumn("t", (F.col("t") - F.col("m")) / unit).drop("m", "s")


_Z = _REF + """, fit AS (SELECT metric, aggregation, seed, avg(r) AS m, stddev_pop(r) AS s FROM rp GROUP BY ALL),
z AS (SELECT rp.metric, rp.aggregation, rp.seed, rp.scale, (r - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END AS r, (t - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END AS t FROM rp JOIN fit ON rp.metric = fit.metric AND rp.aggregation = fit.aggregation AND rp.seed = fit.seed),
zr AS (SELECT *, rank() OVER (PARTITION BY metric, seed ORDER BY r) + (count(*) OVER (PARTITION BY metric, seed, r) - 1) / 2 AS rr, rank() OVER (PARTITION BY metric, seed ORDER BY t) + (count(*) OVER (PARTITION BY metric, seed, t) - 1) / 2 AS tr FROM z) """


@query("zscore_concat", _Z + "SELECT metric, aggregation AS feature_slot, CAST(seed AS BIGINT) AS seed, CAST(scale AS INT) AS scale, round(r, 5) + 0.0 AS r, round(t, 5) + 0.0 AS t FROM z")
def zscore_concat(spark, sf_dir):
    z = zscored(reference_pairs(metric_results(spark, sf_dir)), ["metric", "aggregation", "seed"])
    return z.select("metric", F.col("aggregation").alias("feature_slot"), "seed", "scale", F.round("r", 5).alias("r"), F.round("t", 5).alias("t"))


@query("seed_vs_baseline", _Z + "SELECT metric, CAST(seed AS BIGINT) AS seed, CAST(count(*) AS BIGINT) AS n_points, round(corr(r, t), 5) AS joint_pearson FROM z GROUP BY metric, seed")
def seed_vs_baseline(spark, sf_dir):
    """Mean and deviation curves of a seed together, each standardised by the baseline."""
    z = zscored(reference_pairs(metric_results(spark, sf_dir)), ["metric", "aggregation", "seed"])
    return z.groupBy("metric", "seed").agg(F.count(F.lit(1)).alias("n_points"), F.round(safe_corr("r", "t"), 5).alias("joint_pearson"))


@query("joint_mean", _Z + "SELECT CAST(seed AS BIGINT) AS seed, CAST(count(*) AS BIGINT) AS n_points, round(corr(r, t), 5) AS joint_pearson FROM z WHERE aggregation = 'mean' GROUP BY seed")
def joint_mean(spark, sf_dir):
    """The mean curves of both metrics together."""
    z = zscored(reference_pairs(metric_results(spark, sf_dir)).where("aggregation = 'mean'"), ["metric", "aggregation", "seed"])
    return z.groupBy("seed").agg(F.count(F.lit(1)).alias("n_points"), F.round(safe_corr("r", "t"), 5).alias("joint_pearson"))


@query("weighted_mean", _REF + "SELECT CAST(seed AS BIGINT) AS seed, CAST(scale AS INT) AS scale, round(sum(CASE metric WHEN 'script' THEN 0.75 ELSE 0.25 END * r), 6) AS r, round(sum(CASE metric WHEN 'script' THEN 0.75 ELSE 0.25 END * t), 6) AS t FROM rp WHERE aggregation = 'mean' GROUP BY seed, scale")
def weighted_mean(spark, sf_dir, weights: tuple[float, float] = (3.0, 1.0)):
    """The weighted mean of the features of a scale, weights divided by their sum."""
    if any(not math.isfinite(w) or w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights are finite, not negative, and not all zero")
    w = F.when(F.col("metric") == "script", weights[0] / sum(weights)).otherwise(weights[1] / sum(weights))
    p = reference_pairs(metric_results(spark, sf_dir)).where("aggregation = 'mean'")
    return p.groupBy("seed", "scale").agg(r6(F.sum(w * F.col("r"))).alias("r"), r6(F.sum(w * F.col("t"))).alias("t"))


@query("joint_mae_r2", _REF + """, jm AS (SELECT *, avg(r) OVER (PARTITION BY seed) AS gm FROM rp WHERE aggregation = 'mean')
SELECT CAST(seed AS BIGINT) AS seed, round(avg(abs(t - r)), 6) AS mae, round(1 - sum((t - r) ** 2) / sum((r - gm) ** 2), 5) AS r2 FROM jm GROUP BY seed""")
def joint_mae_r2(spark, sf_dir):
    """Error and fit over the raw values of both metrics, one after the other."""
    s = pair_statistics(reference_pairs(metric_results(spark, sf_dir)).where("aggregation = 'mean'"), ["seed"])
    return s.select("seed", r6("mae").alias("mae"), F.round("r2", 5).alias("r2"))


@query("control_report", _REF + """, mc AS (SELECT metric, aggregation, scale, max(r) AS r, avg(t) AS t FROM rp GROUP BY metric, aggregation, scale), mm AS (SELECT *, avg(r) OVER (PARTITION BY metric, aggregation) AS rm FROM mc)
SELECT metric, aggregation, round(avg(abs(t - r)), 6) AS mae, round(1 - sum((t - r) ** 2) / nullif(sum((r - rm) ** 2), 0), 5) AS r2 FROM mm GROUP BY metric, aggregation""")
def control_report(spark, sf_dir):
    """The mean curve of all seeds against the baseline."""
    mean = reference_pairs(metric_results(spark, sf_dir)).groupBy("metric", "aggregation", "scale").agg(F.max("r").alias("r"), F.avg("t").alias("t"))
    return pair_statistics(mean, ["metric", "aggregation"]).select("metric", "aggregation", r6("mae").alias("mae"), F.round("r2", 5).alias("r2"))


@query("model_summary", _REF + "SELECT metric, aggregation, CAST(count(*) AS BIGINT) AS n_seeds, round(avg(pearson), 5) AS mean_pearson, round(stddev_samp(pearson), 5) + 0.0 AS std_pearson, round(avg(mae), 6) AS mean_mae, round(stddev_samp(mae), 6) + 0.0 AS std_mae FROM st GROUP BY metric, aggregation")
def model_summary(spark, sf_dir):
    s = pair_statistics(reference_pairs(metric_results(spark, sf_dir)), ["metric", "aggregation", "seed"]).groupBy("metric", "aggregation")
    return s.agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("pearson"), 5).alias("mean_pearson"), F.round(F.stddev_samp("pearson"), 5).alias("std_pearson"), r6(F.avg("mae")).alias("mean_mae"), r6(F.stddev_samp("mae")).alias("std_mae"))


# ---- probabilities


def t_two_sided(r: float, n: int) -> float:
    """Two-sided p of a correlation of n points, by the regularised incomplete beta function."""
    if n < 3 or r is None or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # continued fraction, from its tail
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def two_sided_p(r: str, n: str) -> Column:
    """The p of a column of correlations; null where there is none, or too few points for one."""
    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, k) if x is not None else float("nan") for x, k in zip(r, n)])

    return F.nanvl(p(r, n), F.lit(None))


def p_sql(r: str) -> str:
    """The same of six points in SQL: four degrees of freedom have a closed form."""
    return f"round(CASE WHEN abs({r}) >= 1 THEN 0 ELSE 1 - abs({r}) * (3 - {r} * {r}) / 2 END, 6) + 0.0"


@query("pvalues", _REF + f"SELECT metric, aggregation, CAST(seed AS BIGINT) AS seed, {p_sql('spearman')} AS spearman_p, {p_sql('pearson')} AS pearson_p FROM st")
def pvalues(spark, sf_dir):
    """Spearman's and Pearson's p of each seeded curve against its baseline."""
    s = pair_statistics(reference_pairs(metric_results(spark, sf_dir)), ["metric", "aggregation", "seed"])
    return s.select("metric", "aggregation", "seed", (r6(two_sided_p("spearman", "n_points")) + 0.0).alias("spearman_p"), (r6(two_sided_p("pearson", "n_points")) + 0.0).alias("pearson_p"))


#: Draws of one task's row, before they are dealt out.
DRAW_BLOCK = 250


def permutation_pvalues(points: DataFrame, by: list[str], draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(by, n_draws, p) of Spearman's coefficient of (by, scale, feature, r, t): the scales of t are permuted, all
    features together, and p is the share of draws, the observed order included, whose coefficient is as large.

    A draw is a row: it orders the scales by a hash of seed, group, draw and scale, so any engine draws the same, tasks
    share a group's draws, and their counts are added. A permutation moves ranks but changes none, so a draw compares a
    sum of products of centred ranks, which are multiples of a quarter and add up exactly. A group in which r or t is
    constant has no p."""
    ranks = ranked(points.select(*by, "scale", "feature", "r", "t"), by)
    both = W.partitionBy(*by)
    centred = ranks.select(*by, "scale", "feature", *[(F.col(c) - F.avg(c).over(both)).alias(c) for c in ("rr", "tr")])
    at = centred.groupBy(*by, "scale").agg(F.array_sort(F.collect_list(F.struct("feature", "rr", "tr"))).alias("f"))
    one = F.struct("scale", F.transform("f", lambda x: x["rr"]).alias("a"), F.transform("f", lambda x: x["tr"]).alias("b"))
    groups = at.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("points"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    total = lambda left, right: F.aggregate(F.zip_with(left, right, dot), F.lit(0.0), lambda s, v: s + v)
    a, b = F.transform("points", lambda p: p["a"]), F.transform("points", lambda p: p["b"])
    blocks = -(-draws // DRAW_BLOCK)
    seen = groups.select(*by, "points", a.alias("a"), F.abs(total(a, b)).alias("observed"), (total(a, a) * total(b, b) > 0).alias("varies"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    first = F.col("block") * DRAW_BLOCK + 1
    drawn = seen.repartition(*by, "block").withColumn("draw", F.explode(F.sequence(first, F.least(first + (DRAW_BLOCK - 1), F.lit(draws)))))
    name = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("draw").cast("string"))
    order = F.array_sort(F.transform("points", lambda p: F.struct(F.sha2(F.concat(name, F.lit("|"), p["scale"].cast("string")), 256).alias("h"), p["b"].alias("b"))))
    hit = F.abs(total(F.col("a"), F.transform(order, lambda x: x["b"]))) >= F.col("observed")
    counted = drawn.groupBy(*by).agg(F.count(F.lit(1)).alias("n_draws"), F.count(F.when(hit, 1)).alias("hits"), F.first("varies").alias("varies"))
    return counted.select(*by, "n_draws", F.when(F.col("varies"), (F.col("hits") + 1) / (F.col("n_draws") + 1)).alias("p"))


def permutation_sql(source: str, by: list[str], draws: int, seed: int = 0) -> str:
    """pp_ (by, n_draws, p) of ``source`` (by, scale, feature, r, t)."""
    b = ", ".join(by)
    name = " || '|' || ".join(f"CAST({x} AS VARCHAR)" for x in (seed, *by, "d", "scale"))
    return f"""pr_ AS (SELECT {b}, scale, feature, rank() OVER (PARTITION BY {b} ORDER BY r) + (count(*) OVER (PARTITION BY {b}, r) - 1) / 2 AS rr, rank() OVER (PARTITION BY {b} ORDER BY t) + (count(*) OVER (PARTITION BY {b}, t) - 1) / 2 AS tr FROM {source}),
pc_ AS (SELECT {b}, scale, feature, rr - avg(rr) OVER (PARTITION BY {b}) AS x, tr - avg(tr) OVER (PARTITION BY {b}) AS y FROM pr_),
ps_ AS (SELECT {b}, scale, row_number() OVER (PARTITION BY {b} ORDER BY scale) AS pos FROM (SELECT DISTINCT {b}, scale FROM pc_)),
po_ AS (SELECT {b}, abs(sum(x * y)) AS observed, sum(x * x) * sum(y * y) > 0 AS varies FROM pc_ GROUP BY {b}),
pd_ AS (SELECT {b}, d, scale, row_number() OVER (PARTITION BY {b}, d ORDER BY sha256({name})) AS pos FROM ps_, (SELECT unnest(range(1, {draws + 1})) AS d)),
pt_ AS (SELECT {b}, d, abs(sum(l.x * m.y)) AS drawn FROM pd_ JOIN (SELECT {b}, pos, scale AS s0 FROM ps_) USING ({b}, pos) JOIN (SELECT {b}, scale AS s0, feature, x FROM pc_) l USING ({b}, s0) JOIN (SELECT {b}, scale, feature, y FROM pc_) m USING ({b}, scale, feature) GROUP BY {b}, d),
pp_ AS (SELECT {b}, count(*) AS n_draws, CASE WHEN any_value(varies) THEN (count(*) FILTER (WHERE drawn >= observed) + 1) / (count(*) + 1) END AS p FROM pt_ JOIN po_ USING ({b}) GROUP BY {b})"""


DRAWS = 10_000


@query("permutation_pvalue", _Z + f", zf_ AS (SELECT metric, CAST(seed AS BIGINT) AS seed, scale, aggregation AS feature, round(r, 9) AS r, round(t, 9) AS t FROM z), {permutation_sql('zf_', ['metric', 'seed'], DRAWS)} SELECT metric, seed, n_draws, round(p, 9) AS p FROM pp_")
def permutation_pvalue_query(spark, sf_dir, draws: int = DRAWS):
    """Grouped permutation p of mean and deviation together, for each metric and seed."""
    z = zscored(reference_pairs(metric_results(spark, sf_dir)), ["metric", "aggregation", "seed"])
    points = z.select("metric", "seed", "scale", F.col("aggregation").alias("feature"), F.round("r", 9).alias("r"), F.round("t", 9).alias("t"))
    return permutation_pvalues(points, ["metric", "seed"], draws).withColumn("p", F.round("p", 9))
