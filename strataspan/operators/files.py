"""Result tables through files and back: CSV with a fixed schema, JSON lines, and the store's partitioned layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.operators.curves import r6
from strataspan.operators.manifests import boolean, variant
from strataspan.operators.results import METRIC_SQL, metric_results
from strataspan.plans.registry import query
from strataspan.sources.store import RunPolicy, Store, shared_folder
from strataspan.sources.tables import PARTITION, PARTITION_SQL, partition

_LONG = f"WITH {METRIC_SQL} SELECT metric, CAST(scale AS INT) AS scale, coalesce(CAST(seed AS VARCHAR), 'baseline') AS variant, aggregation, round(value, 6) AS value, FALSE AS reused FROM mr"


def _result(df: DataFrame) -> DataFrame:
    return df.select("metric", "scale", "variant", "aggregation", "value", "reused")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_results(spark, sf_dir).select("metric", "scale", variant(), "aggregation", r6("value").alias("value"), "reused")


@query("csv_round_trip", _LONG)
def csv_round_trip(spark, sf_dir):
    """Written as CSV in folders by metric; read as text and cast, a bad number being an error."""
    path = shared_folder(spark, "files") + "/rows"
    _rows(spark, sf_dir).write.option("header", True).partitionBy("metric").csv(path)
    text = spark.read.schema("scale string, variant string, aggregation string, value string, reused string, metric string").option("header", True).csv(path)
    return _result(text.withColumns({"scale": F.col("scale").cast("int"), "value": F.col("value").cast("double"), "reused": boolean(F.col("reused"))}))


@query("json_round_trip", _LONG)
def json_round_trip(spark, sf_dir):
    path = shared_folder(spark, "files") + "/rows"
    rows = _rows(spark, sf_dir)
    rows.write.json(path)
    return _result(spark.read.schema(rows.schema).json(path))


@query("stored_partition", f"WITH {PARTITION_SQL} SELECT token_id, cluster_id, round(probability, 5) AS probability FROM part_a")
def stored_partition(spark, sf_dir):
    """A partition through the store: its configuration is written last, its columns are checked when it is read."""
    store = Store(spark, shared_folder(spark, "files") + "/rows")
    rows = partition(spark, sf_dir)
    store.write("partition", rows, {"source": "embeddings", "method": "label"}, RunPolicy("error"))
    back = store.read("partition", T.StructType([T.StructField(f.name, f.dataType) for f in PARTITION]))
    return back.select("token_id", "cluster_id", F.round("probability", 5).alias("probability"))
