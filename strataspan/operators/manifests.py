"""Relational plumbing over result tables: selection, guards, unions, schedules and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspan.operators.curves import r6
from strataspan.operators.partitions import sizes
from strataspan.operators.results import METRIC_SQL, metric_results
from strataspan.plans.registry import query
from strataspan.sources.tables import PARTITION_B_SQL, PARTITION_SQL, SCALES, SEEDS, TASK_KEY, partition, partition_b

_M = f"WITH {METRIC_SQL} "
_VARIANT = "coalesce(CAST(seed AS VARCHAR), 'baseline') AS variant"
TOLERANCE = 1e-12


def variant() -> Column:
    return F.coalesce(F.col("seed").cast("string"), F.lit("baseline")).alias("variant")


def boolean(text: Column) -> Column:
    """Of the texts true and false, whatever their case and surrounding blanks; any other text is an error."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t == "true", True).when(t == "false", False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(t, F.lit("null")))).cast("boolean"))


@query("manifest", f"""WITH {PARTITION_SQL}, {PARTITION_B_SQL}, u AS (SELECT 'a' AS method, token_id, cluster_id FROM part_a UNION ALL SELECT 'b', token_id, cluster_id FROM part_b)
SELECT method, sha256('driver|embeddings|' || method) AS config_hash, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS BIGINT) AS n_clusters,
CAST(count(*) FILTER (WHERE cluster_id < 0) AS BIGINT) AS n_noise, round(count(*) FILTER (WHERE cluster_id < 0) / count(*), 6) AS noise_fraction FROM u GROUP BY method""")
def manifest(spark, sf_dir):
    """One row for each partition."""
    u = partition(spark, sf_dir).select(F.lit("a").alias("method"), "token_id", "cluster_id").unionByName(partition_b(spark, sf_dir).select(F.lit("b").alias("method"), "token_id", "cluster_id"))
    noise = F.count(F.when(F.col("cluster_id") < 0, 1))
    return u.groupBy("method").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"), noise.alias("n_noise"),
                                   r6(noise / F.count(F.lit(1))).alias("noise_fraction")).withColumn("config_hash", F.sha2(F.concat(F.lit("driver|embeddings|"), "method"), 256))


@query("stats_with_manifest", f"""WITH {PARTITION_SQL}, {PARTITION_B_SQL}, u AS (SELECT 'a' AS method, token_id, cluster_id FROM part_a UNION ALL SELECT 'b', token_id, cluster_id FROM part_b),
m AS (SELECT method, count(*) AS n_tokens FROM u GROUP BY method), s AS (SELECT method, avg(n) AS mean_size FROM (SELECT method, cluster_id, count(*) AS n FROM u WHERE cluster_id >= 0 GROUP BY ALL) GROUP BY method)
SELECT method, CAST(n_tokens AS BIGINT) AS n_tokens, round(mean_size, 6) AS mean_size FROM m JOIN s USING (method)""")
def stats_with_manifest(spark, sf_dir):
    one = lambda rows, name: sizes(rows).agg(F.avg("n").alias("mean_size")).withColumn("method", F.lit(name))
    stats = one(partition(spark, sf_dir), "a").unionByName(one(partition_b(spark, sf_dir), "b"))
    return manifest(spark, sf_dir).select("method", "n_tokens").join(stats, "method").select("method", "n_tokens", r6("mean_size").alias("mean_size"))


def exactly_one(results: DataFrame, condition: Column, key: list[str]) -> DataFrame:
    """(key, n_matches, value) of the one row of each key that meets a condition; none or several are an error."""
    n = F.count(F.when(condition, 1))
    wrong = F.raise_error(F.concat_ws(" ", F.lit("not one row for"), *[F.col(k).cast("string") for k in key])).cast("long")
    return results.groupBy(*key).agg(n.alias("n"), F.max(F.when(condition, F.col("value"))).alias("value")).select(*key, F.when(F.col("n") == 1, F.col("n")).otherwise(wrong).alias("n_matches"), "value")


@query("config_row", _M + f"SELECT metric, aggregation, {_VARIANT}, CAST(count(*) AS BIGINT) AS n_matches, round(max(value), 6) AS value FROM mr WHERE scale = 8 AND abs(CAST(scale AS DOUBLE) - 8.0) <= 1e-12 GROUP BY metric, aggregation, seed")
def config_row(spark, sf_dir):
    rows = metric_results(spark, sf_dir).withColumn("variant", variant())
    return exactly_one(rows, (F.col("scale") == 8) & (F.abs(F.col("scale").cast("double") - 8.0) <= TOLERANCE), ["metric", "aggregation", "variant"]).withColumn("value", r6("value"))


@query("in_main_flag", _M + "SELECT DISTINCT CAST(scale AS INT) AS scale, scale IN (2, 8, 32) AS in_main, scale NOT IN (2, 8, 32) AS is_new FROM mr")
def in_main_flag(spark, sf_dir):
    s = metric_results(spark, sf_dir).select("scale").distinct()
    main = s.where(F.col("scale").isin(2, 8, 32)).select("scale", F.lit(True).alias("m"))
    flag = F.coalesce("m", F.lit(False))
    return s.join(main, "scale", "left").select("scale", flag.alias("in_main"), (~flag).alias("is_new"))


@query("task_grid", _M + """SELECT metric, CAST(scale AS INT) AS scale, CAST(g.seed AS BIGINT) AS seed, CAST(row_number() OVER (PARTITION BY metric ORDER BY scale, g.seed) AS INT) AS run
FROM (SELECT DISTINCT metric, scale FROM mr), (SELECT unnest([0, 1, 2, 3]) AS seed) g""")
def task_grid(spark, sf_dir):
    """Metrics and scales times the seed list, numbered in order: tasks, a bounded number."""
    tasks = metric_results(spark, sf_dir).select("metric", "scale").distinct().withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in SEEDS])))
    return tasks.withColumn("run", F.row_number().over(W.partitionBy("metric").orderBy("scale", "seed")))


@query("pending_tasks", _M + """, grid AS (SELECT metric, scale, g.seed FROM (SELECT DISTINCT metric, scale FROM mr), (SELECT unnest([0, 1, 2, 3]) AS seed) g),
done AS (SELECT DISTINCT metric, scale, seed FROM mr WHERE seed IN (0, 1))
SELECT grid.metric, CAST(grid.scale AS INT) AS scale, CAST(grid.seed AS BIGINT) AS seed FROM grid ANTI JOIN done ON grid.metric = done.metric AND grid.scale = done.scale AND grid.seed = done.seed""")
def pending_tasks(spark, sf_dir):
    """Resuming: the scheduled tasks without a completed result (here those of seeds 0 and 1 are complete)."""
    done = metric_results(spark, sf_dir).where(F.col("seed").isin(0, 1)).select("metric", "scale", "seed").distinct()
    return task_grid(spark, sf_dir).drop("run").join(done, ["metric", "scale", "seed"], "left_anti")


@query("run_report", _M + """, s AS (SELECT metric, CASE WHEN seed IS NULL THEN 'reused' WHEN seed < 3 THEN 'computed' ELSE 'failed' END AS status FROM mr)
SELECT metric, CAST(count(*) FILTER (WHERE status = 'computed') AS BIGINT) AS computed, CAST(count(*) FILTER (WHERE status = 'reused') AS BIGINT) AS reused, CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed FROM s GROUP BY metric""")
def run_report(spark, sf_dir):
    status = F.when(F.col("seed").isNull(), "reused").when(F.col("seed") < 3, "computed").otherwise("failed")
    rows = metric_results(spark, sf_dir).withColumn("status", status)
    return rows.groupBy("metric").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("computed", "reused", "failed")])


@query("common_seeds", _M + "SELECT DISTINCT CAST(a.seed AS BIGINT) AS seed FROM mr a WHERE a.metric = 'script' AND a.seed IS NOT NULL AND a.seed IN (SELECT seed FROM mr WHERE metric = 'length')")
def common_seeds(spark, sf_dir):
    m = metric_results(spark, sf_dir).where("seed IS NOT NULL")
    return m.where("metric = 'script'").select("seed").intersect(m.where("metric = 'length'").select("seed"))


@query("wide_summary", _M + f"""SELECT metric, {_VARIANT}, CAST(count(DISTINCT aggregation) AS BIGINT) AS n_aggregations, count(DISTINCT aggregation) = 3 AS complete,
round(max(value) FILTER (WHERE aggregation = 'mean'), 6) AS mean, round(max(value) FILTER (WHERE aggregation = 'std'), 6) AS std, round(max(value) FILTER (WHERE aggregation = 'count'), 6) AS count_ FROM mr WHERE scale = 64 GROUP BY metric, seed""")
def wide_summary(spark, sf_dir):
    rows = metric_results(spark, sf_dir).where("scale = 64").withColumn("variant", variant())
    n = F.count_distinct("aggregation")
    of = lambda a: r6(F.max(F.when(F.col("aggregation") == a, F.col("value"))))
    return rows.groupBy("metric", "variant").agg(n.alias("n_aggregations"), (n == 3).alias("complete"), of("mean").alias("mean"), of("std").alias("std"), of("count").alias("count_"))


@query("uniqueness_guard", _M + "SELECT CAST(count(*) AS BIGINT) AS n_duplicates FROM (SELECT metric, scale, seed, aggregation FROM mr GROUP BY ALL HAVING count(*) > 1)")
def uniqueness_guard(spark, sf_dir):
    return metric_results(spark, sf_dir).groupBy("metric", "scale", "seed", "aggregation").count().where("count > 1").agg(F.count(F.lit(1)).alias("n_duplicates"))


@query("union_results", _M + "SELECT metric, aggregation, CAST(count(*) AS BIGINT) AS n FROM mr GROUP BY ALL")
def union_results(spark, sf_dir):
    """The tables of two metrics under one another, then counted."""
    m = metric_results(spark, sf_dir)
    return united([m.where("metric = 'script'"), m.where("metric = 'length'")], [*TASK_KEY, "partition_method", "metric", "component", "aggregation", "scope"]).groupBy("metric", "aggregation").agg(F.sum("one").alias("n"))


def united(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """(key, one) of the rows of several tables under one another; a row that is found twice is an error."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    twice = F.raise_error("an observation is found twice").cast("long")
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*key, F.when(F.col("n") == 1, F.col("n")).otherwise(twice).alias("one"))


@query("runs_by_config", _M + "SELECT metric, aggregation, array_to_string(list_sort(list(DISTINCT CAST(scale AS INT))), ',') AS scales, CAST(count(*) AS BIGINT) AS n_runs FROM mr GROUP BY metric, aggregation")
def runs_by_config(spark, sf_dir):
    return metric_results(spark, sf_dir).groupBy("metric", "aggregation").agg(F.array_join(F.array_sort(F.collect_set("scale")), ",").alias("scales"), F.count(F.lit(1)).alias("n_runs"))


@query("projection_cluster_stats", _M + """SELECT CAST(scale AS INT) AS scale, CAST(count(DISTINCT seed) AS BIGINT) AS n_seeds, round(avg(value) FILTER (WHERE metric = 'script'), 6) AS mean_script,
round(stddev_samp(value) FILTER (WHERE metric = 'script'), 6) + 0.0 AS std_script, round(avg(value) FILTER (WHERE metric = 'length'), 6) AS mean_length, round(stddev_samp(value) FILTER (WHERE metric = 'length'), 6) + 0.0 AS std_length FROM mr WHERE aggregation = 'mean' AND seed IS NOT NULL GROUP BY scale""")
def projection_cluster_stats(spark, sf_dir):
    rows = metric_results(spark, sf_dir).where("aggregation = 'mean' AND seed IS NOT NULL")
    of = lambda m: F.when(F.col("metric") == m, F.col("value"))
    return rows.groupBy("scale").agg(F.count_distinct("seed").alias("n_seeds"), *[r6(f(of(m))).alias(f"{n}_{m}") for m in ("script", "length") for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


@query("set_equality", _M + """SELECT NOT EXISTS (SELECT scale FROM mr WHERE metric = 'script' EXCEPT SELECT scale FROM mr WHERE metric = 'length') AND NOT EXISTS (SELECT scale FROM mr WHERE metric = 'length' EXCEPT SELECT scale FROM mr WHERE metric = 'script') AS equal_scales""")
def set_equality(spark, sf_dir):
    m = metric_results(spark, sf_dir)
    side = lambda k: m.where(F.col("metric") == k).select("scale").distinct()
    a, b = side("script").withColumn("a", F.lit(1)), side("length").withColumn("b", F.lit(1))
    return a.join(b, "scale", "full_outer").agg((F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)) == 0).alias("equal_scales"))


@query("ordered_models", _M + "SELECT metric, CAST(scale AS INT) AS scale, CAST(row_number() OVER (ORDER BY CASE metric WHEN 'length' THEN 0 ELSE 1 END, scale) AS INT) AS position FROM (SELECT DISTINCT metric, scale FROM mr)")
def ordered_models(spark, sf_dir):
    """A custom order of models, then scales; tasks are a bounded number."""
    t = metric_results(spark, sf_dir).select("metric", "scale").distinct()
    return t.withColumn("position", F.row_number().over(W.orderBy(F.when(F.col("metric") == "length", 0).otherwise(1), "scale")))


@query("null_seed_first", _M + f"SELECT metric, CAST(scale AS INT) AS scale, {_VARIANT}, CAST(row_number() OVER (PARTITION BY metric, scale ORDER BY coalesce(seed, -1)) AS INT) AS position FROM mr WHERE aggregation = 'mean'")
def null_seed_first(spark, sf_dir):
    w = W.partitionBy("metric", "scale").orderBy(F.coalesce("seed", F.lit(-1)))
    return metric_results(spark, sf_dir).where("aggregation = 'mean'").select("metric", "scale", variant(), F.row_number().over(w).alias("position"))


@query("expected_artifacts", _M + """, want AS (SELECT unnest([2, 4, 8, 16, 32, 64, 128]) AS scale) SELECT CAST(want.scale AS INT) AS scale, CAST(count(mr.scale) AS BIGINT) AS n_present, count(mr.scale) = 0 AS missing FROM want LEFT JOIN mr ON want.scale = mr.scale GROUP BY want.scale""")
def expected_artifacts(spark, sf_dir):
    """Expected keys against those present."""
    want = spark.createDataFrame([(k,) for k in (*SCALES, 128)], "scale int")
    have = metric_results(spark, sf_dir).groupBy("scale").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return want.join(have, "scale", "left").select("scale", n.alias("n_present"), (n == 0).alias("missing"))


@query("boolean_text", _M + "SELECT DISTINCT txt, lower(trim(txt)) = 'true' AS value FROM (SELECT CASE scale WHEN 2 THEN ' True ' WHEN 4 THEN 'False' WHEN 8 THEN 'true' WHEN 16 THEN 'false ' WHEN 32 THEN 'TRUE' ELSE 'FALSE' END AS txt FROM mr)")
def boolean_text(spark, sf_dir):
    words = F.element_at(F.create_map(*[F.lit(x) for kv in zip(SCALES, (" True ", "False", "true", "false ", "TRUE", "FALSE")) for x in kv]), F.col("scale"))
    return metric_results(spark, sf_dir).select(words.alias("txt")).distinct().select("txt", boolean(F.col("txt")).alias("value"))


@query("figure_data", _M + """, line AS (SELECT metric, scale, avg(value) AS value, coalesce(stddev_samp(value), 0) AS uncertainty FROM mr WHERE aggregation = 'mean' AND seed IS NOT NULL GROUP BY metric, scale)
SELECT CAST(dense_rank() OVER (ORDER BY metric) - 1 AS INT) AS line_index, metric AS label, 'left' AS axis, CAST(scale AS INT) AS scale, round(value, 6) AS value, round(uncertainty, 6) + 0.0 AS uncertainty FROM line""")
def figure_data(spark, sf_dir):
    """What a figure of the seeds' mean curves plots, with its uncertainty."""
    line = metric_results(spark, sf_dir).where("aggregation = 'mean' AND seed IS NOT NULL").groupBy("metric", "scale").agg(F.avg("value").alias("value"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("uncertainty"))
    return line.select((F.dense_rank().over(W.orderBy("metric")) - 1).alias("line_index"), F.col("metric").alias("label"), F.lit("left").alias("axis"), "scale", r6("value").alias("value"), r6("uncertainty").alias("uncertainty"))
