"""Stages over tasks that are resumed: partitions by task, then metrics over them, with reports of what each run did.

Both stages keep their rows in a :class:`TaskStore`. A metric run reads the partitions of its pending tasks only, through
the partition store's manifest, so that what is finished is neither computed nor read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.operators.curves import r6
from strataspan.operators.schedule import _KEY, _METRICS, _PARTS, _TASKS, MARGINS, TASK, _keyed, category_entropies, labelled_matrix, nearest_partitions, partition_schedule, summarised, tokens
from strataspan.plans.registry import query
from strataspan.sources.manifested import read_manifested
from strataspan.sources.store import RunPolicy, settled, shared_folder
from strataspan.sources.tables import SCALES, SEEDS
from strataspan.sources.tasks import Report, TaskStore, config_hash

TASK_KEY = T.StructType().add("source", "string").add("seed", "long").add("scale", "integer")
PARTITION_ROWS = T.StructType().add("token_id", "long").add("cluster_id", "long")
METRIC_ROWS = T.StructType().add("metric", "string").add("component", "string").add("aggregation", "string").add("value", "double")
PLAIN = ("baseline", *(f"stability_{m}" for m in MARGINS))
CONTROLS = ("permutation", "length_bucket")
#: A width that no matrix here has: its tasks fail, and are reported.
TOO_WIDE = 128


def tasks_of(spark: SparkSession, scales: tuple[int, ...], method: str = "nearest_mean", controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(source, seed, scale, config_hash): the plain partitions and every control and seed, of some widths."""
    keys = [(s, None, k) for s in PLAIN for k in scales] + [(s, seed, k) for s in controls for seed in SEEDS for k in scales]
    return spark.createDataFrame(keys, TASK_KEY).withColumn("config_hash", config_hash(F.lit(method), *TASK))


def of_tasks(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """The rows of some tasks; seeds compare null-safely."""
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in TASK]
    return rows.alias("r").join(F.broadcast(tasks.select(*TASK)).alias("t"), same, "left_semi")  # a list of tasks


class Stages:
    """The two stages below one folder, over the tables of ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str, path: str):
        self.spark, self.sf_dir, self.path = spark, sf_dir, path
        self.text = settled(tokens(spark, sf_dir), path, "tokens")
        self.partitions = TaskStore(spark, f"{path}/partitions", TASK_KEY, PARTITION_ROWS)
        self.metrics = TaskStore(spark, f"{path}/metrics", TASK_KEY, METRIC_ROWS)

    def make_partitions(self, tasks: DataFrame, policy: RunPolicy = RunPolicy(), stop_on_error: bool = True) -> Report:
        made = lambda pending: of_tasks(partition_schedule(self.spark, self.sf_dir, self.text, shared_folder(self.spark, "schedule")), pending)
        return self.partitions.run(tasks, made, policy, stop_on_error)

    def make_metrics(self, tasks: DataFrame, policy: RunPolicy = RunPolicy(), stop_on_error: bool = True) -> Report:
        def made(pending: DataFrame) -> DataFrame:
            parts = self.partitions.rows_of(pending).select(*TASK, *PARTITION_ROWS.fieldNames())
            return summarised(category_entropies(parts, self.text), ["h", "h_norm"])

        # a partition that is all noise has no clusters to measure, which is a result
        return self.metrics.run(tasks, made, policy, stop_on_error, may_be_empty=self.partitions.manifest())


def _resumed(spark: SparkSession, sf_dir: str) -> tuple[Stages, Report]:
    """Metrics of the narrow widths, then of all: the second run finds the first one's."""
    stages = Stages(spark, sf_dir, shared_folder(spark, "stages"))
    stages.make_partitions(tasks_of(spark, SCALES))
    stages.make_metrics(tasks_of(spark, SCALES[:3]))
    wide = tasks_of(spark, (TOO_WIDE,), controls=())
    return stages, stages.make_metrics(tasks_of(spark, SCALES).unionByName(wide), RunPolicy("resume"), stop_on_error=False)


_LAST = SCALES[2]


@query("resumed_metrics", _METRICS + f"SELECT {_KEY}, CAST(scale AS INT) AS scale, metric, component, aggregation, round(value, 6) + 0.0 AS value, scale <= {_LAST} AS reused FROM mr_")
def resumed_metrics(spark, sf_dir):
    """All metric results of two runs, the second of which computes what the first has not; reused ones are marked."""
    stages, report = _resumed(spark, sf_dir)
    status = report.records.select(*TASK, (F.col("status") == "reused").alias("reused"))
    rows = stages.metrics.rows().alias("r").join(status.alias("s"), [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in TASK])
    return _keyed(rows.select(*[F.col(f"r.{c}").alias(c) for c in (*TASK, "metric", "component", "aggregation")], (r6("value") + 0.0).alias("value"), "reused"))


@query("resume_report", _TASKS + f""", t_ AS (SELECT DISTINCT source, seed, scale FROM task_ UNION ALL SELECT DISTINCT source, CAST(NULL AS BIGINT), {TOO_WIDE} FROM part_)
SELECT source, count(*) FILTER (WHERE scale > {_LAST} AND scale < {TOO_WIDE}) AS computed, count(*) FILTER (WHERE scale <= {_LAST}) AS reused, count(*) FILTER (WHERE scale = {TOO_WIDE}) AS failed FROM t_ GROUP BY source""")
def resume_report(spark, sf_dir):
    """What the second run did with the tasks of each source; widths that the matrix does not have fail."""
    _, report = _resumed(spark, sf_dir)
    return report.records.groupBy("source").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("computed", "reused", "failed")])


# ---- runs and their summary rows


def write_runs(parts: DataFrame, root: str) -> str:
    """Rows (source, scale, ...) saved by run, and one summary row a run with its path, in the columns of
    ``run_summaries``; the path of the summary table, a manifest."""
    run = F.concat("source", F.lit("_dim"), F.col("scale").cast("string")).alias("run_id")
    parts.select(run, "token_id", "cluster_id").hint("rebalance", "run_id").write.partitionBy("run_id").parquet(f"{root}/runs")
    saved = parts.sparkSession.read.schema("token_id long, cluster_id long, run_id string").parquet(f"{root}/runs")
    noise = F.count(F.when(F.col("cluster_id") < 0, 1))
    rows = saved.groupBy("run_id").agg(F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters_excl_noise"), noise.alias("n_noise"), F.count(F.lit(1)).alias("n_total"))
    scale = F.regexp_extract("run_id", r"_dim(\d+)$", 1).cast("int")
    named = rows.select("run_id", F.regexp_replace("run_id", r"_dim\d+$", "").alias("source"), scale.alias("scale"), "n_clusters_excl_noise", "n_noise", "n_total", F.concat(F.lit("runs/run_id="), "run_id").alias("cluster_path"))
    named.coalesce(1).write.parquet(f"{root}/summary")
    return f"{root}/summary"


def open_runs(spark: SparkSession, summary: str) -> DataFrame:
    """(run_id, source, scale, n_total, token_id, cluster_id) of the summary's runs: a filter on a run's columns opens the
    files of the runs that meet it. Two summary rows for one run are an error."""
    return read_manifested(spark, summary, "run_id string, source string, scale int, n_total long, token_id long, cluster_id long", pathcolumn="cluster_path", key="run_id", root=summary.rpartition("/")[0])


@query("run_partition", f"WITH {_PARTS} SELECT source || '_dim' || scale AS run_id, CAST(count(*) OVER () AS BIGINT) AS n_total, vec_id AS token_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM (SELECT *, token_id AS vec_id FROM part_ WHERE source = 'stability_{MARGINS[0]}' AND scale = 16)")
def run_partition(spark, sf_dir):
    """One run's partition through its summary row: of all runs that are saved, only its files are read."""
    rules = {"baseline": 1.0, **{f"stability_{m}": m for m in MARGINS}}
    summary = write_runs(nearest_partitions(labelled_matrix(spark, sf_dir), rules), shared_folder(spark, "runs"))
    return open_runs(spark, summary).where(F.col("run_id") == f"stability_{MARGINS[0]}_dim16").select("run_id", "n_total", "token_id", "cluster_id")


@query("runs_of_width", f"WITH {_PARTS} SELECT source, CAST(scale AS INT) AS scale, CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS n, CAST(sum(token_id) AS BIGINT) AS ids FROM part_ WHERE scale >= 32 AND source <> 'baseline' GROUP BY ALL")
def runs_of_width(spark, sf_dir):
    """The runs of some widths and settings, chosen by the columns of their summary rows."""
    rules = {"baseline": 1.0, **{f"stability_{m}": m for m in MARGINS}}
    summary = write_runs(nearest_partitions(labelled_matrix(spark, sf_dir), rules), shared_folder(spark, "runs"))
    rows = open_runs(spark, summary).where("scale >= 32 AND source <> 'baseline'")
    return rows.groupBy("source", "scale", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_id").alias("ids"))


def write_metadata(summary: DataFrame, margins: dict[str, float], path: str) -> None:
    """A JSON record for each run, with the parameters it was made with."""
    margin = F.element_at(F.create_map(*[F.lit(x) for kv in margins.items() for x in kv]), F.col("source"))
    params = F.struct(F.lit("nearest_mean").alias("method"), margin.alias("margin"))
    summary.select("run_id", "scale", params.alias("params"), F.struct("n_clusters_excl_noise", "n_noise", "n_total").alias("result"), "cluster_path").write.json(path)


def runs_by_parameters(records: DataFrame) -> DataFrame:
    """(method, margin, n_runs, runs, total_noise): the runs of each set of parameters, by width, with what they found."""
    one = F.struct("scale", F.concat_ws(":", F.col("scale").cast("string"), "run_id", F.col("result.n_clusters_excl_noise").cast("string")).alias("text"))
    grouped = records.groupBy("params.method", "params.margin").agg(F.count(F.lit(1)).alias("n_runs"), F.array_sort(F.collect_list(one)).alias("runs"), F.sum("result.n_noise").alias("total_noise"))
    return grouped.select("method", "margin", "n_runs", F.array_join(F.transform("runs", lambda r: r["text"]), ";").alias("runs"), "total_noise")


@query("runs_by_parameters", f"WITH {_PARTS}, r_ AS (SELECT source, margin, scale, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS n, count(*) FILTER (WHERE cluster_id < 0) AS noise FROM part_ JOIN rule_ USING (source) GROUP BY ALL) SELECT 'nearest_mean' AS method, margin, count(*) AS n_runs, string_agg(scale || ':' || source || '_dim' || scale || ':' || n, ';' ORDER BY scale) AS runs, CAST(sum(noise) AS BIGINT) AS total_noise FROM r_ GROUP BY margin")
def runs_by_parameters_query(spark, sf_dir):
    """Records of all runs in a folder of JSON files, read and grouped by their parameters."""
    rules, root = {"baseline": 1.0, **{f"stability_{m}": m for m in MARGINS}}, shared_folder(spark, "runs")
    summary = spark.read.parquet(write_runs(nearest_partitions(labelled_matrix(spark, sf_dir), rules), root))
    write_metadata(summary, rules, f"{root}/metadata")
    shape = "run_id string, scale int, params struct<method: string, margin: double>, result struct<n_clusters_excl_noise: long, n_noise: long, n_total: long>, cluster_path string"
    return runs_by_parameters(spark.read.schema(shape).option("mode", "FAILFAST").json(f"{root}/metadata"))
