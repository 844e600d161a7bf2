"""Typed views of the input tables: matrix, partitions and vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.sources.store import settled, shared_folder

SCALES = (2, 4, 8, 16, 32, 64)
SEEDS = (0, 1, 2, 3)

PARTITION = T.StructType([T.StructField("token_id", T.LongType()), T.StructField("cluster_id", T.LongType()), T.StructField("probability", T.FloatType())])
TASK_KEY = ("analysis_id", "model_name", "space_name", "scale", "source", "seed_type", "seed")
METRIC_RESULT = (*TASK_KEY, "partition_method", "metric", "component", "aggregation", "value", "scope", "config_hash", "reused")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, features): one row vector per row."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("features"))


def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token_id, cluster_id, probability); cluster -1 is noise."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("token_id"), (F.col("label") - 1).cast("long").alias("cluster_id"), F.abs(F.get("embedding", F.lit(0))).cast("float").alias("probability"))


def partition_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second partition of the same rows: every seventh row sits one cluster further."""
    shifted = (F.col("label") + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)) % 10 - 1
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token_id"), shifted.cast("long").alias("cluster_id"))


def numbered(rows: DataFrame, group: list[str], order: Column, out: str) -> DataFrame:
    """Number the rows of each group from 1 in an order without ties, without a window over a whole group. Rows are saved
    when this is called, not when its result is read.

    Rows are dealt to ranges of group and order, as many as there are shuffle partitions, and saved with the number of
    their range; they are numbered inside it, and the ranges, a few rows, get offsets."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__order", order).repartitionByRange(n, *[F.col(g) for g in group], "__order").withColumn("__range", F.spark_partition_id())
    dealt = settled(dealt, shared_folder(rows.sparkSession, "ranges"), "rows")
    sizes = dealt.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(W.partitionBy(*group).orderBy("__range")) - F.col("__n")).drop("__n")
    inner = dealt.withColumn("__rank", F.row_number().over(W.partitionBy(*group, "__range").orderBy("__order")))
    return inner.join(before, [*group, "__range"]).withColumn(out, F.col("__before") + F.col("__rank")).drop("__order", "__range", "__rank", "__before")


def dense_ids(values: DataFrame, column: str, out: str) -> DataFrame:
    """Number distinct strings from 0 in binary order."""
    return numbered(values, [], F.col(column), out).withColumn(out, (F.col(out) - 1).cast("long")).select(out, *values.columns)


def token_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token_str) of every whitespace token of every document."""
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("token_str")).where("token_str <> ''")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token_str, cluster_id) of all distinct tokens; the cluster is the first document's id mod 9, less 1."""
    return token_occurrences(spark, sf_dir).groupBy("token_str").agg((F.min("doc_id") % 9 - 1).cast("long").alias("cluster_id"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with a number, token_id, for each token."""
    return dense_ids(vocabulary(spark, sf_dir), "token_str", "token_id")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, token_str): the distinct part names of each brand, the brands' numbers as clusters."""
    return read(spark, sf_dir, "part").select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("cluster_id"), F.col("p_name").alias("token_str")).distinct()


# ---- the same views in SQL

VOCAB_SQL = """occ AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS token_str FROM documents),
vocab AS (SELECT CAST(row_number() OVER (ORDER BY token_str) - 1 AS BIGINT) AS token_id, token_str, min(doc_id) % 9 - 1 AS cluster_id FROM occ WHERE token_str <> '' GROUP BY token_str)"""
PARTITION_SQL = "part_a AS (SELECT vec_id AS token_id, CAST(label - 1 AS BIGINT) AS cluster_id, CAST(abs(embedding[1]) AS FLOAT) AS probability FROM embeddings)"
PARTITION_B_SQL = "part_b AS (SELECT vec_id AS token_id, CAST((label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 - 1 AS BIGINT) AS cluster_id FROM embeddings)"
NAMES_SQL = "names AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS cluster_id, p_name AS token_str FROM part)"
#: Eigenvalues of the Gram matrix by Jacobi rotations: in each step every column is paired with another, all pairs meet
#: in as many steps as there are columns less one (an even number of columns), and after nine such rounds the matrix is
#: diagonal.
SPECTRUM_SQL = """x_ AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
gram_ AS (SELECT 0 AS step, CAST(a.d AS INT) AS i, CAST(b.d AS INT) AS j, sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)) AS v FROM x_ a JOIN x_ b ON a.vec_id = b.vec_id GROUP BY a.d, b.d),
size_ AS (SELECT CAST(max(i) + 1 AS INT) AS n FROM gram_),
jac AS (SELECT step, i, j, v FROM gram_ UNION ALL (
  WITH pair AS (SELECT i, CASE WHEN i = n - 1 THEN r WHEN i = r THEN n - 1 ELSE (2 * r - i + 2 * (n - 1)) % (n - 1) END AS o FROM (SELECT i, step % (n - 1) AS r, n FROM jac, size_ WHERE i = j)),
  ang AS (SELECT p.i, p.o, (z.v - a.v) / (2 * nullif(y.v, 0)) AS th FROM pair p JOIN jac y ON y.i = least(p.i, p.o) AND y.j = greatest(p.i, p.o)
    JOIN jac a ON a.i = least(p.i, p.o) AND a.j = a.i JOIN jac z ON z.i = greatest(p.i, p.o) AND z.j = z.i),
  tan_ AS (SELECT i, o, coalesce(CASE WHEN th >= 0 THEN 1 ELSE -1 END / (abs(th) + sqrt(th * th + 1)), 0) AS t FROM ang),
  rot AS (SELECT i, o, 1 / sqrt(1 + t * t) AS c, CASE WHEN i < o THEN -t ELSE t END / sqrt(1 + t * t) AS g FROM tan_)
  SELECT w.step + 1, w.i, w.j, k.c * m.c * w.v + k.c * m.g * b.v + k.g * m.c * d.v + k.g * m.g * e.v
  FROM jac w JOIN rot k ON k.i = w.i JOIN rot m ON m.i = w.j JOIN jac b ON b.i = w.i AND b.j = m.o JOIN jac d ON d.i = k.o AND d.j = w.j JOIN jac e ON e.i = k.o AND e.j = m.o
  WHERE w.step < 9 * (SELECT n - 1 FROM size_))),
sp0 AS (SELECT greatest(v, 0) AS energy FROM jac WHERE i = j AND step = (SELECT max(step) FROM jac)),
sp AS (SELECT CAST(row_number() OVER (ORDER BY energy DESC) - 1 AS INT) AS idx, CAST(row_number() OVER (ORDER BY energy DESC) AS INT) AS scale, sqrt(energy) AS value, energy FROM sp0)"""
