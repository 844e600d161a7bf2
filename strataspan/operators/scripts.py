"""Script entropy of partitions: dominant scripts, counts, entropies and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.functions.scripts import DOMINANT_SQL, dominant_script, length_bucket, script_counts
from strataspan.plans.registry import query
from strataspan.sources.store import settled, shared_folder
from strataspan.sources.tables import VOCAB_SQL, vocab, vocabulary

_BASE = f"WITH {VOCAB_SQL},\n{DOMINANT_SQL}"
_ENTROPY = """, vocab_scripts AS (SELECT count(DISTINCT script) AS k FROM scripted),
sc_ AS (SELECT cluster_id, script, count(*) AS n FROM scripted WHERE cluster_id >= 0 GROUP BY ALL),
tot AS (SELECT cluster_id, sum(n) AS t FROM sc_ GROUP BY ALL),
ent AS (SELECT s.cluster_id, CAST(max(t) AS BIGINT) AS cluster_size, -sum(n / t * ln(n / t)) AS h FROM sc_ s JOIN tot ON s.cluster_id = tot.cluster_id GROUP BY s.cluster_id),
hn AS (SELECT cluster_id, cluster_size, h, CASE WHEN k <= 1 THEN 0.0 ELSE h / ln(k) END AS h_norm FROM ent, vocab_scripts)"""


def scripted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab(spark, sf_dir).withColumn("script", dominant_script(F.col("token_str")))


def counts_by_script(tokens: DataFrame) -> DataFrame:
    return tokens.where("cluster_id >= 0").groupBy("cluster_id", "script").agg(F.count(F.lit(1)).alias("n"))


def entropies(counts: DataFrame, n_scripts: DataFrame) -> DataFrame:
    """(cluster_id, cluster_size, h, h_norm) from counts; h_norm divides by ln of the scripts of the whole vocabulary."""
    # sum of n ln n gives the entropy in one pass: ln t - sum(n ln n) / t
    per = counts.groupBy("cluster_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    h = F.ln("t") - F.col("s") / F.col("t")
    return per.join(F.broadcast(n_scripts)).select("cluster_id", F.col("t").alias("cluster_size"), h.alias("h"), F.when(F.col("k") <= 1, 0.0).otherwise(h / F.ln("k")).alias("h_norm"))


def vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, script, n) over the vocabulary, noise included: a row for each cluster and script, saved, from one
    look at the texts."""
    tokens = vocabulary(spark, sf_dir).select("cluster_id", dominant_script(F.col("token_str")).alias("script"))
    return settled(tokens.groupBy("cluster_id", "script").agg(F.count(F.lit(1)).alias("n")).coalesce(1), shared_folder(spark, "scripts"), "counts")


def cluster_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = vocabulary_counts(spark, sf_dir)
    return entropies(counts.where("cluster_id >= 0"), counts.agg(F.count_distinct("script").alias("k")))


def wide_counts(counts: DataFrame) -> DataFrame:
    """(cluster_id, one column for each script there is, noise included), from (cluster_id, script, n); columns are named
    by their scripts in small letters, in order. A vocabulary has at most as many scripts as Unicode."""
    scripts = sorted(r[0] for r in counts.select("script").distinct().collect())
    wide = counts.where("cluster_id >= 0").groupBy("cluster_id").pivot("script", scripts).agg(F.sum("n")).na.fill(0)
    return wide.select("cluster_id", *[F.col(f"`{s}`").alias(s.lower()) for s in scripts])


@query("token_scripts", _BASE + " SELECT token_id, script FROM scripted")
def token_scripts(spark, sf_dir):
    return scripted_tokens(spark, sf_dir).select("token_id", "script")


@query("char_script_counts", f"WITH {VOCAB_SQL}, {DOMINANT_SQL}, e AS (SELECT unnest(c) AS x FROM cand) SELECT x.script AS script, CAST(sum(x.n) AS BIGINT) AS n FROM e GROUP BY x.script")
def char_script_counts(spark, sf_dir):
    return vocabulary(spark, sf_dir).select(F.explode(script_counts(F.col("token_str"))).alias("x")).groupBy("x.script").agg(F.sum("x.n").alias("n"))


@query("script_counts", _BASE + _ENTROPY + " SELECT cluster_id, script, n FROM sc_")
def script_counts_query(spark, sf_dir):
    return vocabulary_counts(spark, sf_dir).where("cluster_id >= 0")


@query("script_counts_wide", _BASE + " SELECT * FROM (PIVOT (SELECT cluster_id, lower(script) AS s FROM scripted) ON s USING count(*) GROUP BY cluster_id) WHERE cluster_id >= 0")
def script_counts_wide(spark, sf_dir):
    return wide_counts(vocabulary_counts(spark, sf_dir))


@query("cluster_entropy", _BASE + _ENTROPY + " SELECT cluster_id, cluster_size, round(h, 6) + 0.0 AS h, round(h_norm, 6) + 0.0 AS h_norm FROM hn")
def cluster_entropy(spark, sf_dir):
    return cluster_entropies(spark, sf_dir).select("cluster_id", "cluster_size", F.round("h", 6).alias("h"), F.round("h_norm", 6).alias("h_norm"))


@query("partition_entropy", _BASE + _ENTROPY + """ SELECT CAST(count(*) AS BIGINT) AS num_clusters, round(avg(h), 6) AS mean_h, round(stddev_pop(h), 6) AS std_h,
round(avg(h_norm), 6) AS mean_h_norm, round(stddev_pop(h_norm), 6) AS std_h_norm FROM hn""")
def partition_entropy(spark, sf_dir):
    h = cluster_entropies(spark, sf_dir)
    return h.agg(F.count(F.lit(1)).alias("num_clusters"), F.round(F.avg("h"), 6).alias("mean_h"), F.round(F.stddev_pop("h"), 6).alias("std_h"),
                 F.round(F.avg("h_norm"), 6).alias("mean_h_norm"), F.round(F.stddev_pop("h_norm"), 6).alias("std_h_norm"))


@query("global_scripts", _BASE + " SELECT DISTINCT script FROM scripted")
def global_scripts(spark, sf_dir):
    return vocabulary_counts(spark, sf_dir).select("script").distinct()


@query("length_bucket_counts", f"""WITH {VOCAB_SQL}, b AS (SELECT cluster_id, CASE WHEN length(token_str) <= 2 THEN '1-2' WHEN length(token_str) <= 5 THEN '3-5' WHEN length(token_str) <= 10 THEN '6-10' ELSE '11+' END AS bucket FROM vocab WHERE cluster_id >= 0)
SELECT cluster_id, CAST(count(*) FILTER (WHERE bucket = '1-2') AS BIGINT) AS n_1_2, CAST(count(*) FILTER (WHERE bucket = '3-5') AS BIGINT) AS n_3_5, CAST(count(*) FILTER (WHERE bucket = '6-10') AS BIGINT) AS n_6_10, CAST(count(*) FILTER (WHERE bucket = '11+') AS BIGINT) AS n_11 FROM b GROUP BY cluster_id""")
def length_bucket_counts(spark, sf_dir):
    wide = vocabulary(spark, sf_dir).where("cluster_id >= 0").withColumn("b", length_bucket(F.col("token_str"))).groupBy("cluster_id").pivot("b", ["1-2", "3-5", "6-10", "11+"]).count().na.fill(0)
    return wide.select("cluster_id", F.col("1-2").alias("n_1_2"), F.col("3-5").alias("n_3_5"), F.col("6-10").alias("n_6_10"), F.col("11+").alias("n_11"))
