"""Permutation controls: token ids shuffled over the clusters by a seeded hash, globally or inside length buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspan.functions.scripts import DOMINANT_SQL, dominant_script, length_bucket
from strataspan.operators.scripts import counts_by_script, entropies
from strataspan.plans.registry import query
from strataspan.sources.store import settled, shared_folder
from strataspan.sources.tables import PARTITION_SQL, VOCAB_SQL, numbered, partition, vocab

SEED = 42
_HASH = "sha256(CAST({seed} AS VARCHAR) || ':' || CAST(token_id AS VARCHAR))"


def seeded_order(seed: int, column: str = "token_id") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")), 256)


def permuted(rows: DataFrame, seed: int, group: list[str]) -> DataFrame:
    """Rows without noise whose token ids are dealt anew inside each group; all other columns stay in place."""
    kept = rows.where("cluster_id >= 0")
    seats = numbered(kept, group, F.col("token_id"), "seat")
    drawn = numbered(kept.select(*group, F.col("token_id").alias("new_id")), group, seeded_order(seed, "new_id"), "seat")
    return seats.withColumnRenamed("token_id", "old_id").join(drawn, [*group, "seat"]).withColumnRenamed("new_id", "token_id")


_GLOBAL = f"""WITH {PARTITION_SQL}, k AS (SELECT * FROM part_a WHERE cluster_id >= 0),
seats AS (SELECT *, row_number() OVER (ORDER BY token_id) AS seat FROM k), drawn AS (SELECT token_id AS new_id, row_number() OVER (ORDER BY {_HASH.format(seed=SEED)}) AS seat FROM k)"""


@query("permute_global", _GLOBAL + " SELECT new_id AS token_id, cluster_id, probability FROM seats JOIN drawn USING (seat)")
def permute_global(spark, sf_dir):
    return permuted(partition(spark, sf_dir), SEED, []).select("token_id", "cluster_id", "probability")


_BUCKETED = f"""WITH {VOCAB_SQL}, k AS (SELECT token_id, cluster_id, CASE WHEN length(token_str) <= 2 THEN '1-2' WHEN length(token_str) <= 5 THEN '3-5' WHEN length(token_str) <= 10 THEN '6-10' ELSE '11+' END AS bucket FROM vocab WHERE cluster_id >= 0),
seats AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY token_id) AS seat FROM k), drawn AS (SELECT token_id AS new_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY {_HASH.format(seed=SEED)}) AS seat FROM k)"""


def bucketed(spark, sf_dir):
    rows = vocab(spark, sf_dir).select("token_id", "cluster_id", length_bucket(F.col("token_str")).alias("bucket"))
    return permuted(rows, SEED, ["bucket"])


@query("permute_length_bucket", _BUCKETED + " SELECT new_id AS token_id, cluster_id, bucket FROM seats JOIN drawn USING (bucket, seat)")
def permute_length_bucket(spark, sf_dir):
    return bucketed(spark, sf_dir).select("token_id", "cluster_id", "bucket")


@query("permutation_invariants", _GLOBAL + """, p AS (SELECT new_id AS token_id, cluster_id FROM seats JOIN drawn USING (seat))
SELECT (SELECT count(*) FROM p) = (SELECT count(*) FROM k) AS same_rows, (SELECT count(DISTINCT token_id) FROM p) = (SELECT count(*) FROM p) AS unique_ids,
NOT EXISTS (SELECT token_id FROM p EXCEPT ALL SELECT token_id FROM k) AND NOT EXISTS (SELECT token_id FROM k EXCEPT ALL SELECT token_id FROM p) AS same_ids,
NOT EXISTS (SELECT cluster_id, count(*) FROM p GROUP BY 1 EXCEPT SELECT cluster_id, count(*) FROM k GROUP BY 1) AS same_sizes,
(SELECT count(*) FROM p WHERE cluster_id < 0) = 0 AS no_noise""")
def permutation_invariants(spark, sf_dir):
    before = partition(spark, sf_dir).where("cluster_id >= 0").select("token_id", "cluster_id", F.lit(1).alias("side"))
    after = permute_global(spark, sf_dir).select("token_id", "cluster_id", F.lit(-1).alias("side"))
    both = before.unionByName(after)
    ids = both.groupBy("token_id").agg(F.sum("side").alias("s"), F.count(F.when(F.col("side") == -1, 1)).alias("n")).agg((F.max(F.abs("s")) == 0).alias("same_ids"), (F.max("n") <= 1).alias("unique_ids"))
    size = both.groupBy("cluster_id").agg(F.sum("side").alias("s")).agg((F.max(F.abs("s")) == 0).alias("same_sizes"))
    rows = both.agg((F.sum("side") == 0).alias("same_rows"), (F.count(F.when((F.col("side") == -1) & (F.col("cluster_id") < 0), 1)) == 0).alias("no_noise"))
    return rows.join(ids).join(size)


@query("permuted_entropy", _BUCKETED + f""", {DOMINANT_SQL}, moved AS (SELECT new_id AS token_id, cluster_id FROM seats JOIN drawn USING (bucket, seat)),
sc_ AS (SELECT m.cluster_id, s.script, count(*) AS n FROM moved m JOIN scripted s ON m.token_id = s.token_id GROUP BY ALL), tot AS (SELECT cluster_id, sum(n) AS t FROM sc_ GROUP BY 1)
SELECT s.cluster_id, round(-sum(n / t * ln(n / t)), 6) + 0.0 AS h FROM sc_ s JOIN tot ON s.cluster_id = tot.cluster_id GROUP BY s.cluster_id""")
def permuted_entropy(spark, sf_dir):
    text = vocab(spark, sf_dir)
    tokens = settled(text.select("token_id", "cluster_id", length_bucket(F.col("token_str")).alias("bucket"), dominant_script(F.col("token_str")).alias("script")), shared_folder(spark, "controls"), "tokens")
    moved = permuted(tokens.select("token_id", "cluster_id", "bucket"), SEED, ["bucket"]).select("token_id", "cluster_id").join(tokens.select("token_id", "script"), "token_id")
    return entropies(counts_by_script(moved), tokens.agg(F.count_distinct("script").alias("k"))).select("cluster_id", F.round("h", 6).alias("h"))
