"""Orthographic similarity of clusters: exact over all pairs, or over seeded subsamples of large clusters."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspan.functions.strings import mean_similarity, ndist
from strataspan.plans.registry import query
from strataspan.sources.store import settled, shared_folder
from strataspan.sources.tables import NAMES_SQL, names, vocab

EXACT_LIMIT, SAMPLE_SIZE, REPEATS, SEED = 512, 128, 10, 1813382118
#: Rows of a large cluster that are ranked for a subsample, about.
CANDIDATES = 384

#: (x, y, d) of all pairs in ``pairs_`` (x, y): one cell of the table a step, two rows of state.
_DISTANCE = """dp AS (
  SELECT x, y, lower(x) AS a, lower(y) AS b, 1 AS i, 0 AS j, list_transform(range(0, length(y) + 1), lambda v: CAST(v AS DOUBLE)) AS prev, [1.0::DOUBLE] AS cur FROM pairs_ WHERE length(x) > 0 AND length(y) > 0
  UNION ALL
  SELECT x, y, a, b, CASE WHEN j = length(b) THEN i + 1 ELSE i END, CASE WHEN j = length(b) THEN 0 ELSE j + 1 END,
    CASE WHEN j = length(b) THEN cur ELSE prev END,
    CASE WHEN j = length(b) THEN [CAST(i + 1 AS DOUBLE)] ELSE list_append(cur, least(least(prev[j + 2], cur[j + 1]) + 1, prev[j + 1] +
      CASE WHEN i >= 2 AND j + 1 >= 2 THEN (CASE WHEN a[i] <> b[j + 1] THEN 0.5 ELSE 0 END + CASE WHEN a[i - 1] <> b[j] THEN 0.5 ELSE 0 END)
           ELSE CASE WHEN a[i] <> b[j + 1] THEN 1 ELSE 0 END END)) END
  FROM dp WHERE i <= length(a)),
dist AS (SELECT x, y, cur[length(b) + 1] / greatest(length(a), length(b)) AS d FROM dp WHERE i = length(a) AND j = length(b))"""
_PAIRS = f"WITH RECURSIVE {NAMES_SQL}, own AS (SELECT a.cluster_id, a.token_str AS x, b.token_str AS y FROM names a JOIN names b ON a.cluster_id = b.cluster_id AND a.token_str < b.token_str), pairs_ AS (SELECT DISTINCT x, y FROM own), {_DISTANCE} "


def by_size(rows: DataFrame, large: bool) -> DataFrame:
    """The rows of clusters of more than EXACT_LIMIT strings, or of the others."""
    n = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n.where(F.col("n") > EXACT_LIMIT if large else F.col("n") <= EXACT_LIMIT), "cluster_id", "left_semi")


def cluster_pairs(rows: DataFrame) -> DataFrame:
    """(cluster_id, x, y): unordered pairs of the distinct strings of each cluster of at most EXACT_LIMIT strings."""
    rows = by_size(rows, False)
    other = rows.select("cluster_id", F.col("token_str").alias("y"))
    return rows.select("cluster_id", F.col("token_str").alias("x")).join(other, "cluster_id").where("x < y")


def exact_similarity(rows: DataFrame) -> DataFrame:
    """(cluster_id, n_pairs, score); a pair of strings that several clusters share is measured once."""
    pairs = cluster_pairs(rows)
    measured = pairs.select("x", "y").distinct().withColumn("d", ndist("x", "y"))
    return pairs.join(measured, ["x", "y"]).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(1 - F.col("d")).alias("score"))


@query("ndist_pairs", _PAIRS + "SELECT x, y, round(d, 6) AS ndist, round(1 - d, 6) AS similarity FROM dist")
def ndist_pairs(spark, sf_dir):
    d = cluster_pairs(names(spark, sf_dir)).select("x", "y").distinct().withColumn("d", ndist("x", "y"))
    return d.select("x", "y", F.round("d", 6).alias("ndist"), F.round(1 - F.col("d"), 6).alias("similarity"))


@query("os_cluster_exact", _PAIRS + "SELECT cluster_id, CAST(count(*) AS BIGINT) AS n_pairs, round(avg(1 - d), 6) AS score FROM own JOIN dist USING (x, y) GROUP BY cluster_id")
def os_cluster_exact(spark, sf_dir):
    return exact_similarity(names(spark, sf_dir)).select("cluster_id", "n_pairs", F.round("score", 6).alias("score"))


def partition_scores(rows: DataFrame) -> DataFrame:
    """(cluster_id, score) of all clusters: over all pairs where they are few, over subsamples of large clusters."""
    large = sampled_similarity(by_size(rows, True).withColumn("token_id", F.col("token_str"))).select("cluster_id", "score")
    return exact_similarity(rows).select("cluster_id", "score").unionByName(large)


@query("os_partition", _PAIRS + ", s AS (SELECT cluster_id, avg(1 - d) AS score FROM own JOIN dist USING (x, y) GROUP BY cluster_id) SELECT round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, CAST(count(*) AS BIGINT) AS n_clusters FROM s")
def os_partition(spark, sf_dir):
    return partition_scores(names(spark, sf_dir)).agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.stddev_pop("score"), 6).alias("std_score"), F.count(F.lit(1)).alias("n_clusters"))


def sampled_similarity(rows: DataFrame, seed: int = SEED, by: list[str] = []) -> DataFrame:
    """(by, cluster_id, cluster_size, score): exact up to EXACT_LIMIT tokens, else the mean of REPEATS subsamples.

    ``by``: columns that tell partitions apart. The subsample is the operator itself: the SAMPLE_SIZE tokens that a
    seeded hash puts first. Of a large cluster only the rows below a bound on the hash are ranked, which about CANDIDATES
    rows are; should a subsample not have SAMPLE_SIZE rows below it, all rows of its cluster are ranked. Ranked rows are
    saved when this is called.
    """
    key = [*by, "cluster_id"]
    settle = lambda df: settled(df, shared_folder(rows.sparkSession, "similarity"), "rows")
    size = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("cluster_size")).where("cluster_size >= 2")

    def same(a: str, b: str, names: list[str]):
        on = F.lit(True)
        for k in names:
            on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return on

    sized = rows.alias("r").join(size.alias("s"), same("r", "s", key)).select(*[F.col(f"r.{k}").alias(k) for k in key], "s.cluster_size", "r.token_id", "r.token_str")
    draws = sized.withColumn("draw", F.explode(F.when(F.col("cluster_size") > EXACT_LIMIT, F.sequence(F.lit(1), F.lit(REPEATS))).otherwise(F.array(F.lit(0)))))
    hashed = draws.withColumn("hash", F.xxhash64(F.lit(seed), "draw", "token_id"))
    # hashes are even over all 64-bit numbers
    bound = F.col("hash").cast("double") < -(2.0**63) + 2.0**64 * CANDIDATES / F.col("cluster_size")
    below = hashed.where((F.col("draw") == 0) | bound)

    def first(few: DataFrame) -> DataFrame:
        order = W.partitionBy(*key, "draw").orderBy("hash", "token_id")
        most = F.when(F.col("draw") == 0, EXACT_LIMIT).otherwise(SAMPLE_SIZE)
        ranked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= EXACT_LIMIT)  # a constant, so that tasks rank what they have first
        return ranked.where(F.col("rank") <= most).select(*key, "cluster_size", "draw", "token_str")

    kept = settle(first(below))
    full = kept.where("draw > 0").groupBy(*key, "draw").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == SAMPLE_SIZE)
    wanted = size.where(F.col("cluster_size") > EXACT_LIMIT).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    short = settle(wanted.alias("r").join(full.alias("s"), same("r", "s", [*key, "draw"]), "left_anti").select(*key, "draw"))
    if not short.isEmpty():
        again = first(hashed.alias("r").join(short.alias("s"), same("r", "s", [*key, "draw"]), "left_semi"))
        kept = kept.alias("r").join(short.alias("s"), same("r", "s", [*key, "draw"]), "left_anti").unionByName(again)

    def score(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [f[k].iloc[0]] for k in key}, "cluster_size": [f.cluster_size.iloc[0]], "score": [mean_similarity(f.token_str.tolist())]})

    shape = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)
    # few bytes, much work: as many tasks as there are partitions, whatever the bytes
    spread = kept.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "draw")
    each = spread.groupBy(*key, "draw").applyInPandas(score, f"{shape}, cluster_size long, score double")
    return each.groupBy(*key).agg(F.max("cluster_size").alias("cluster_size"), F.avg("score").alias("score"))


@query("os_cluster_sampled")
def os_cluster_sampled(spark, sf_dir):
    return sampled_similarity(vocab(spark, sf_dir).where("cluster_id >= 0")).withColumn("score", F.round("score", 6))


def subsample_seed(seed: int, tokens: list[str]) -> int:
    """The generator's seed of a cluster: eight bytes of BLAKE2b over the seed and the length-prefixed sorted tokens."""
    h = hashlib.blake2b(digest_size=8)
    h.update(int(seed).to_bytes(8, "little", signed=True))
    for t in sorted(tokens):
        raw = t.encode()
        h.update(len(raw).to_bytes(8, "little"))
        h.update(raw)
    return int.from_bytes(h.digest(), "little")


def replayable_score(tokens: list[str], seed: int = SEED) -> float:
    """The score of one cluster that fits a task, with NumPy subsamples that do not depend on the tokens' order."""
    if len(tokens) < 2:
        raise ValueError("a cluster needs two tokens")
    t = sorted(tokens)
    if len(t) <= EXACT_LIMIT:
        return mean_similarity(t)
    rng = np.random.default_rng(subsample_seed(seed, t))
    return float(np.mean([mean_similarity([t[i] for i in rng.choice(len(t), SAMPLE_SIZE, replace=False)]) for _ in range(REPEATS)]))
