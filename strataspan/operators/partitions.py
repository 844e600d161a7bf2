"""Counts, sizes and probabilities of partitions; comparisons of two partitions."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspan.plans.registry import query
from strataspan.sources.tables import PARTITION_B_SQL, PARTITION_SQL, numbered, partition, partition_b

_P = f"WITH {PARTITION_SQL} "
_AB = f"WITH {PARTITION_SQL}, {PARTITION_B_SQL} "
_SIZES = f"WITH {PARTITION_SQL}, sz AS (SELECT cluster_id, count(*) AS n FROM part_a WHERE cluster_id >= 0 GROUP BY 1) "


def sizes(rows):
    return rows.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("drop_noise", _P + "SELECT token_id, cluster_id, probability FROM part_a WHERE cluster_id <> -1")
def drop_noise(spark, sf_dir):
    return partition(spark, sf_dir).where("cluster_id <> -1")


@query("partition_counts", _P + """SELECT CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS BIGINT) AS n_clusters,
CAST(sum(CASE WHEN cluster_id < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_noise, round(sum(CASE WHEN cluster_id < 0 THEN 1 ELSE 0 END) / count(*), 6) AS noise_fraction,
round(1 - sum(CASE WHEN cluster_id < 0 THEN 1 ELSE 0 END) / count(*), 6) AS valid_token_rate FROM part_a""")
def partition_counts(spark, sf_dir):
    noise = F.sum(F.when(F.col("cluster_id") < 0, 1).otherwise(0))
    return partition(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"), noise.alias("n_noise"),
        F.round(noise / F.count(F.lit(1)), 6).alias("noise_fraction"), F.round(1 - noise / F.count(F.lit(1)), 6).alias("valid_token_rate"))


@query("mean_probability", _P + """SELECT round(coalesce(avg(CAST(probability AS DOUBLE)), 0), 6) AS avg_prob_all,
round(coalesce(avg(CASE WHEN cluster_id >= 0 THEN CAST(probability AS DOUBLE) END), 0), 6) AS avg_prob_assigned FROM part_a""")
def mean_probability(spark, sf_dir):
    p = F.col("probability").cast("double")
    return partition(spark, sf_dir).agg(F.round(F.coalesce(F.avg(p), F.lit(0.0)), 6).alias("avg_prob_all"), F.round(F.coalesce(F.avg(F.when(F.col("cluster_id") >= 0, p)), F.lit(0.0)), 6).alias("avg_prob_assigned"))


@query("cluster_sizes", _SIZES + "SELECT CAST(count(*) AS BIGINT) AS n_clusters, round(coalesce(avg(n), 0), 6) AS mean_size, round(coalesce(median(n), 0), 6) AS median_size, round(coalesce(stddev_pop(n), 0), 6) AS std_size FROM sz")
def cluster_sizes(spark, sf_dir):
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return sizes(partition(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_clusters"), z(F.avg("n")).alias("mean_size"), z(F.percentile("n", 0.5)).alias("median_size"), z(F.stddev_pop("n")).alias("std_size"))


@query("cluster_sizes_with_noise", f"WITH {PARTITION_SQL}, sz AS (SELECT cluster_id, count(*) AS n FROM part_a GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n_groups, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_size FROM sz")
def cluster_sizes_with_noise(spark, sf_dir):
    return partition(spark, sf_dir).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg("n"), 6).alias("mean_size"), F.round(F.stddev_pop("n"), 6).alias("std_size"))


@query("cluster_size_quartiles", _SIZES + "SELECT round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.75), 6) AS q75 FROM sz")
def cluster_size_quartiles(spark, sf_dir):
    return sizes(partition(spark, sf_dir)).agg(*[F.round(F.percentile("n", q), 6).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)])


@query("cluster_probability_summary", _P + """SELECT cluster_id, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(probability AS DOUBLE)), 6) AS mean_prob,
round(coalesce(stddev_samp(CAST(probability AS DOUBLE)), 0), 6) AS std_prob, round(max(CAST(probability AS DOUBLE)), 6) AS max_prob, round(min(CAST(probability AS DOUBLE)), 6) AS min_prob FROM part_a WHERE cluster_id >= 0 GROUP BY cluster_id""")
def cluster_probability_summary(spark, sf_dir):
    p = F.col("probability").cast("double")
    return partition(spark, sf_dir).where("cluster_id >= 0").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_prob"), F.round(F.coalesce(F.stddev_samp(p), F.lit(0.0)), 6).alias("std_prob"),
        F.round(F.max(p), 6).alias("max_prob"), F.round(F.min(p), 6).alias("min_prob"))


@query("global_probability", _P + "SELECT round(avg(CAST(probability AS DOUBLE)), 6) AS mean_prob, round(stddev_pop(CAST(probability AS DOUBLE)), 6) AS std_prob FROM part_a WHERE cluster_id >= 0")
def global_probability(spark, sf_dir):
    p = F.col("probability").cast("double")
    return partition(spark, sf_dir).where("cluster_id >= 0").agg(F.round(F.avg(p), 6).alias("mean_prob"), F.round(F.stddev_pop(p), 6).alias("std_prob"))


@query("cluster_top_members", _P + """SELECT cluster_id, token_id, CAST(rank AS INT) AS rank FROM (SELECT cluster_id, token_id, row_number() OVER (PARTITION BY cluster_id ORDER BY probability DESC, token_id) AS rank FROM part_a WHERE cluster_id >= 0) WHERE rank <= 10""")
def cluster_top_members(spark, sf_dir):
    """A top-ten report: the members of each cluster with the highest probability."""
    w = W.partitionBy("cluster_id").orderBy(F.desc("probability"), "token_id")
    return partition(spark, sf_dir).where("cluster_id >= 0").select("cluster_id", "token_id", F.row_number().over(w).alias("rank")).where("rank <= 10")


@query("cluster_order", _SIZES + "SELECT cluster_id, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n DESC, cluster_id) AS INT) AS position FROM sz")
def cluster_order(spark, sf_dir):
    return numbered(sizes(partition(spark, sf_dir)), [], F.struct(-F.col("n"), "cluster_id"), "position").withColumn("position", F.col("position").cast("int"))


@query("partition_contract", _P + """SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT token_id) = count(*) AND min(token_id) = 0 AND max(token_id) = count(*) - 1 AS contiguous_ids,
count(probability) IN (0, count(*)) AS all_or_no_probability, coalesce(min(probability) >= 0 AND max(probability) <= 1, TRUE) AS probabilities_valid FROM part_a""")
def partition_contract(spark, sf_dir):
    """The strict rules of a stored partition, in one aggregate."""
    n = F.count(F.lit(1))
    return partition(spark, sf_dir).agg(
        n.alias("n_rows"), ((F.count_distinct("token_id") == n) & (F.min("token_id") == 0) & (F.max("token_id") == n - 1)).alias("contiguous_ids"),
        F.count("probability").isin(F.lit(0), n).alias("all_or_no_probability"), F.coalesce((F.min("probability") >= 0) & (F.max("probability") <= 1), F.lit(True)).alias("probabilities_valid"))


def strict_partition(rows: DataFrame) -> DataFrame:
    """The rows of a stored partition; ids that are not 0, 1, ... once each, a cluster below -1, or probabilities that are
    missing in part or lie outside 0 to 1, are an error."""
    n = F.count(F.lit(1))
    ok = ((F.count_distinct("token_id") == n) & (F.min("token_id") == 0) & (F.max("token_id") == n - 1) & (F.min("cluster_id") >= -1)
          & F.count("probability").isin(F.lit(0), n) & F.coalesce((F.min("probability") >= 0) & (F.max("probability") <= 1), F.lit(True)))
    bad = F.raise_error("the partition does not keep its contract").cast("long")
    return rows.join(F.broadcast(rows.agg(ok.alias("ok")))).select(F.when(F.col("ok"), F.col("token_id")).otherwise(bad).alias("token_id"), "cluster_id", "probability")


@query("strict_partition", _P + "SELECT token_id, cluster_id, round(least(probability, 1.0), 5) AS probability FROM part_a")
def strict_partition_query(spark, sf_dir):
    """A partition that is read strictly; memberships over one are cut to one before."""
    rows = partition(spark, sf_dir).withColumn("probability", F.least("probability", F.lit(1.0).cast("float")))
    return strict_partition(rows).withColumn("probability", F.round("probability", 5))


# ---- two partitions


@query("canonical_partition", _P + "SELECT token_id, CAST(CASE WHEN cluster_id < 0 THEN -1 ELSE min(token_id) OVER (PARTITION BY cluster_id) END AS BIGINT) AS canonical FROM part_a")
def canonical_partition(spark, sf_dir):
    """Clusters named by their smallest member, so that equal partitions get equal names."""
    rows = partition(spark, sf_dir)
    first = rows.where("cluster_id >= 0").groupBy("cluster_id").agg(F.min("token_id").alias("first"))
    return rows.join(first, "cluster_id", "left").select("token_id", F.coalesce("first", F.lit(-1)).cast("long").alias("canonical"))


@query("partition_mismatch", _AB + """, ca AS (SELECT token_id, CASE WHEN cluster_id < 0 THEN -1 ELSE min(token_id) OVER (PARTITION BY cluster_id) END AS k FROM part_a),
cb AS (SELECT token_id, CASE WHEN cluster_id < 0 THEN -1 ELSE min(token_id) OVER (PARTITION BY cluster_id) END AS k FROM part_b)
SELECT CAST(count(*) FILTER (WHERE ca.token_id IS NULL OR cb.token_id IS NULL) AS BIGINT) AS unmatched, CAST(count(*) FILTER (WHERE ca.k <> cb.k) AS BIGINT) AS moved,
CAST(count(*) FILTER (WHERE (ca.k = -1) <> (cb.k = -1)) AS BIGINT) AS noise_mismatch FROM ca FULL JOIN cb ON ca.token_id = cb.token_id""")
def partition_mismatch(spark, sf_dir):
    def named(rows):
        first = rows.where("cluster_id >= 0").groupBy("cluster_id").agg(F.min("token_id").alias("first"))
        return rows.join(first, "cluster_id", "left").select("token_id", F.coalesce("first", F.lit(-1)).alias("k"))

    a, b = named(partition(spark, sf_dir)).alias("a"), named(partition_b(spark, sf_dir)).alias("b")
    both = a.join(b, F.col("a.token_id") == F.col("b.token_id"), "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    return both.agg(n(F.col("a.token_id").isNull() | F.col("b.token_id").isNull()).alias("unmatched"), n(F.col("a.k") != F.col("b.k")).alias("moved"),
                    n((F.col("a.k") == -1) != (F.col("b.k") == -1)).alias("noise_mismatch"))


def contingency(spark, sf_dir):
    """(a, b, n): rows in each pair of clusters; -1 is a cluster like the others."""
    a = partition(spark, sf_dir).select("token_id", F.col("cluster_id").alias("a"))
    return a.join(partition_b(spark, sf_dir).select("token_id", F.col("cluster_id").alias("b")), "token_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("contingency", _AB + "SELECT x.cluster_id AS a, y.cluster_id AS b, CAST(count(*) AS BIGINT) AS n FROM part_a x JOIN part_b y ON x.token_id = y.token_id GROUP BY ALL")
def contingency_query(spark, sf_dir):
    return contingency(spark, sf_dir)


@query("adjusted_rand", _AB + """, ct AS (SELECT x.cluster_id AS a, y.cluster_id AS b, count(*) AS n FROM part_a x JOIN part_b y ON x.token_id = y.token_id GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS both_, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM ct GROUP BY a)) AS sa,
 (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM ct GROUP BY b)) AS sb, (SELECT sum(n) FROM ct) AS t)
SELECT round(CASE WHEN (sa + sb) / 2 = sa * sb / (t * (t - 1) / 2) THEN 1.0 ELSE (both_ - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)) END, 6) AS ari FROM s""")
def adjusted_rand(spark, sf_dir):
    c = contingency(spark, sf_dir)
    pairs = lambda col: F.sum(F.col(col).cast("double") * (F.col(col) - 1) / 2)
    rows = c.groupBy("a").agg(F.sum("n").alias("t")).agg(pairs("t").alias("sa"), F.sum("t").alias("t"))
    cols = c.groupBy("b").agg(F.sum("n").alias("t")).agg(pairs("t").alias("sb"))
    one = c.agg(pairs("n").alias("both")).join(rows).join(cols)
    expected = F.col("sa") * F.col("sb") / (F.col("t") * (F.col("t") - 1) / 2)
    half = (F.col("sa") + F.col("sb")) / 2
    return one.select(F.round(F.when(half == expected, 1.0).otherwise((F.col("both") - expected) / (half - expected)), 6).alias("ari"))


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


def expected_information(a: int, b: int, n: int, lf: np.ndarray) -> float:
    """What two clusters of a and b of n rows add to the expected mutual information of random partitions."""
    k = np.arange(max(1, a + b - n), min(a, b) + 1)
    if not len(k):
        return 0.0
    p = np.exp(lf[a] + lf[b] + lf[n - a] + lf[n - b] - lf[n] - lf[k] - lf[a - k] - lf[b - k] - lf[n - a - b + k])
    return float((k / n * np.log(n * k / (a * b)) * p).sum())


@query("adjusted_mutual_information", _AB + """, ct AS (SELECT x.cluster_id AS a, y.cluster_id AS b, CAST(count(*) AS BIGINT) AS n FROM part_a x JOIN part_b y ON x.token_id = y.token_id GROUP BY ALL),
ra AS (SELECT a, CAST(sum(n) AS BIGINT) AS na FROM ct GROUP BY a), cb AS (SELECT b, CAST(sum(n) AS BIGINT) AS nb FROM ct GROUP BY b), t_ AS (SELECT CAST(sum(n) AS BIGINT) AS t FROM ct),
mi_ AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM ct JOIN ra USING (a) JOIN cb USING (b), t_),
h_ AS (SELECT (SELECT sum(-na / t * ln(na / t)) FROM ra, t_) AS ha, (SELECT sum(-nb / t * ln(nb / t)) FROM cb, t_) AS hb),
k_ AS (SELECT na, nb, t, unnest(range(greatest(1, na + nb - t), least(na, nb) + 1)) AS k FROM ra, cb, t_),
em_ AS (SELECT sum(k / t * ln(t * k / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(t - na + 1) + lgamma(t - nb + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(t - na - nb + k + 1))) AS emi FROM k_)
SELECT round(CASE WHEN abs((ha + hb) / 2 - emi) < 1e-15 THEN 1.0 ELSE (mi - emi) / ((ha + hb) / 2 - emi) END, 6) AS ami FROM mi_, h_, em_""")
def adjusted_mutual_information(spark, sf_dir):
    """AMI with the arithmetic mean; the expected term is summed over pairs of cluster sizes in a task for each pair of distinct sizes."""
    c = contingency(spark, sf_dir)
    ra, cb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    total = c.agg(F.sum("n").alias("t"))
    mi = c.join(ra, "a").join(cb, "b").join(total).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), F.max("t").alias("t"))
    ent = lambda rows, n, out: rows.join(total).agg(F.sum(-F.col(n) / F.col("t") * F.ln(F.col(n) / F.col("t"))).alias(out))
    # equal sizes are one pair: the number of distinct sizes is at most the root of twice the rows
    fa, fb = ra.groupBy("na").agg(F.count(F.lit(1)).alias("fa")), cb.groupBy("nb").agg(F.count(F.lit(1)).alias("fb"))
    grid = fa.join(fb).join(total)

    def expected(frames):
        lf, size = None, -1
        for f in frames:
            out = []
            for na, nb, w, t in zip(f.na, f.nb, f.fa * f.fb, f.t):
                if t != size:
                    lf, size = _log_factorials(int(t)), t
                out.append(w * expected_information(int(na), int(nb), int(t), lf))
            f = f.assign(e=out)
            yield f[["e"]]

    emi = grid.select("na", "nb", "fa", "fb", "t").mapInPandas(expected, "e double").agg(F.sum("e").alias("emi"))
    one = mi.join(ent(ra, "na", "ha")).join(ent(cb, "nb", "hb")).join(emi)
    mean = (F.col("ha") + F.col("hb")) / 2
    return one.select(F.round(F.when(F.abs(mean - F.col("emi")) < 1e-15, 1.0).otherwise((F.col("mi") - F.col("emi")) / (mean - F.col("emi"))), 6).alias("ami"))


_ASSIGNED = _AB + ", j AS (SELECT coalesce(x.token_id, y.token_id) AS token_id, coalesce(x.cluster_id, -1) >= 0 AS in_a, coalesce(y.cluster_id, -1) >= 0 AS in_b FROM part_a x FULL JOIN part_b y ON x.token_id = y.token_id) "


def _assigned(spark, sf_dir):
    a = partition(spark, sf_dir).select("token_id", (F.col("cluster_id") >= 0).alias("in_a"))
    b = partition_b(spark, sf_dir).select("token_id", (F.col("cluster_id") >= 0).alias("in_b"))
    return a.join(b, "token_id", "full_outer").na.fill(False)


@query("noise_overlap", _ASSIGNED + """SELECT CAST(count(*) FILTER (WHERE in_a AND in_b) AS BIGINT) AS shared, CAST(count(*) FILTER (WHERE in_a OR in_b) AS BIGINT) AS united,
round(CASE WHEN count(*) FILTER (WHERE in_a OR in_b) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE in_a AND in_b) / count(*) FILTER (WHERE in_a OR in_b) END, 6) AS jaccard FROM j""")
def noise_overlap(spark, sf_dir):
    both, any_ = F.count(F.when(F.col("in_a") & F.col("in_b"), 1)), F.count(F.when(F.col("in_a") | F.col("in_b"), 1))
    return _assigned(spark, sf_dir).agg(both.alias("shared"), any_.alias("united"), F.round(F.when(any_ == 0, 0.0).otherwise(both / F.nullif(any_, F.lit(0))), 6).alias("jaccard"))


@query("noise_symmetric_difference", _ASSIGNED + "SELECT token_id, CASE WHEN in_a THEN 'a' ELSE 'b' END AS only_in FROM j WHERE in_a <> in_b")
def noise_symmetric_difference(spark, sf_dir):
    return _assigned(spark, sf_dir).where("in_a <> in_b").select("token_id", F.when(F.col("in_a"), "a").otherwise("b").alias("only_in"))


@query("token_id_mismatch", _AB + "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT token_id FROM part_a EXCEPT ALL SELECT token_id FROM part_b UNION ALL (SELECT token_id FROM part_b EXCEPT ALL SELECT token_id FROM part_a))")
def token_id_mismatch(spark, sf_dir):
    a, b = partition(spark, sf_dir).select("token_id"), partition_b(spark, sf_dir).select("token_id")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("n"))


@query("token_case_study", _AB + """, q AS (SELECT 'a' AS which, token_id, cluster_id FROM part_a UNION ALL SELECT 'b', token_id, cluster_id FROM part_b),
sz AS (SELECT which, cluster_id, count(*) AS n, min(token_id) AS first_member FROM q WHERE cluster_id >= 0 GROUP BY ALL)
SELECT q.which, q.token_id, q.cluster_id, CAST(coalesce(sz.n, 0) AS BIGINT) AS cluster_size, coalesce(sz.first_member, -1) AS first_member FROM q LEFT JOIN sz ON q.which = sz.which AND q.cluster_id = sz.cluster_id""")
def token_case_study(spark, sf_dir):
    """Where every token lands in each partition, and with how many; noise has size 0 and first member -1."""
    rows = partition(spark, sf_dir).select(F.lit("a").alias("which"), "token_id", "cluster_id").unionByName(partition_b(spark, sf_dir).select(F.lit("b").alias("which"), "token_id", "cluster_id"))
    size = rows.where("cluster_id >= 0").groupBy("which", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("token_id").alias("first_member"))
    return rows.join(size, ["which", "cluster_id"], "left").select("which", "token_id", "cluster_id", F.coalesce("n", F.lit(0)).alias("cluster_size"), F.coalesce("first_member", F.lit(-1)).alias("first_member"))
