"""Long-form metric results, the table that curves and statistics read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.operators.task_sql import METRIC_SQL

__all__ = ["METRIC_SQL", "metric_results"]


def metric_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entropies of scripts and of length buckets over the clusters of every width: mean, population deviation and
    number of clusters, of the baseline, whose seed is null, and of the permutation control's seeds."""
    from strataspan.operators.schedule import entropy_results  # which takes its statistics from the curves

    rows = entropy_results(spark, sf_dir).where("source IN ('baseline', 'permutation') AND component = 'h'")
    return rows.select(
        F.lit("driver").alias("analysis_id"), F.lit("embeddings").alias("model_name"), F.lit("prefix").alias("space_name"), "scale",
        "source", F.when(F.col("seed").isNotNull(), "permutation").alias("seed_type"), "seed",
        F.lit("nearest_mean").alias("partition_method"), "metric", "component", "aggregation", "value", F.lit("non_noise").alias("scope"),
        F.sha2(F.concat_ws("|", "metric", F.col("scale").cast("string"), F.coalesce(F.col("seed").cast("string"), F.lit(""))), 256).alias("config_hash"), F.lit(False).alias("reused"))
