"""What users add: metrics, row transforms, partition methods, permutation strategies, statistics, composers, selectors
and providers of representations. Each is a small object; what it is added to compiles all of them into the same jobs.

* A metric gives additive parts of a cluster's rows in each task (``partial``), which Spark adds up by key, and makes its
  components of the sums (``finish``). All metrics over all tasks are one scan and one aggregation.
* A statistic is an aggregate expression over the rows of aligned pairs; all of them are one aggregation.
* A strategy says inside which groups tokens are dealt anew; all strategies and seeds are one table.
* A provider gives the rows of some tasks' representations; a method makes partitions of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.operators.curves import ranked, reference_pairs, safe_corr
from strataspan.operators.schedule import _KEY, _TASKS, TASK, _keyed, labelled_matrix, nearest_partitions, partition_schedule, tokens
from strataspan.operators.spectrum import _CUM, _ELBOWS, at_thresholds, elbows_of, l2_normalised, scales_to_indices, spectrum_of
from strataspan.operators.results import METRIC_SQL, metric_results
from strataspan.plans.registry import query
from strataspan.sources.store import RunPolicy, settled, shared_folder
from strataspan.sources.tables import SCALES, SEEDS, matrix, numbered
from strataspan.sources.tasks import Report, TaskStore

# ---- metrics


@dataclass(frozen=True)
class Metric:
    """``columns``: of the tokens, beside the id; ``prepare``: once, from all tokens, what ``finish`` is given too;
    ``partial``: sums by key of the values of those columns in a group of rows; ``finish``: the components of a cluster,
    from the sums over its rows, its number of rows and what was prepared."""

    name: str
    columns: tuple[str, ...]
    partial: Callable[[dict[str, list]], Mapping[str, float]]
    finish: Callable[[dict[str, float], int, Any], Mapping[str, float]]
    prepare: Callable[[DataFrame], Any] = lambda tokens: None


def evaluate(parts: DataFrame, text: DataFrame, metrics: list[Metric], by: tuple[str, ...] = TASK) -> DataFrame:
    """(by, cluster_id, size, metric, component, value) of all metrics over the clusters of all tasks in ``parts`` (by,
    token_id, cluster_id), noise left out. Tasks of Spark send the sums of each cluster and metric, not rows."""
    names = [m.name for m in metrics]
    if len(set(names)) < len(names):
        raise ValueError("metrics have names of their own")
    prepared = {m.name: m.prepare(text) for m in metrics}
    columns = sorted({c for m in metrics for c in m.columns})
    key = [*by, "cluster_id"]
    rows = parts.where("cluster_id >= 0").join(text.select("token_id", *columns), "token_id").select(*key, *columns)
    shape = T.StructType([rows.schema[k] for k in key])
    sums = T.StructType([*shape.fields, T.StructField("metric", T.StringType()), T.StructField("k", T.StringType()), T.StructField("s", T.DoubleType())])
    kinds = {f.name: f.type for f in _arrow(sums)}

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            values = {c: batch.column(c).to_pylist() for c in (*key, *columns)}
            for k, group in enumerate(zip(*[values[c] for c in key])):
                groups.setdefault(group, []).append(k)
            found = [(*g, m.name, k, float(s)) for g, at in groups.items() for m in metrics for k, s in m.partial({c: [values[c][i] for i in at] for c in m.columns}).items()]
            found += [(*g, "", "rows", float(len(at))) for g, at in groups.items()]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in found], kind) for i, (n, kind) in enumerate(kinds.items())})

    added = rows.mapInArrow(partials, sums).groupBy(*key, "metric", "k").agg(F.sum("s").alias("s"))
    of_cluster = added.groupBy(*key).agg(F.collect_list(F.struct("metric", "k", "s")).alias("sums"))
    out = T.StructType([*shape.fields, T.StructField("size", T.LongType()), T.StructField("metric", T.StringType()), T.StructField("component", T.StringType()), T.StructField("value", T.DoubleType())])
    out_kinds = {f.name: f.type for f in _arrow(out)}

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                mine: dict[str, dict[str, float]] = {n: {} for n in ("", *names)}
                for x in row["sums"]:
                    mine[x["metric"]][x["k"]] = x["s"]
                size = int(mine[""]["rows"])
                found += [(*[row[k] for k in key], size, m.name, c, float(v)) for m in metrics for c, v in m.finish(mine[m.name], size, prepared[m.name]).items()]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in found], kind) for i, (n, kind) in enumerate(out_kinds.items())})

    return of_cluster.mapInArrow(finished, out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def category_metric(name: str, column: str) -> Metric:
    """Entropy (``h``) of a column's values in a cluster, and over the log of the values that all tokens have (``h_norm``)."""
    def count(values: dict[str, list]) -> dict[str, float]:
        out: dict[str, float] = {}
        for v in values[column]:
            out[v] = out.get(v, 0) + 1
        return out

    def entropy(sums: dict[str, float], size: int, kinds: int) -> dict[str, float]:
        n = np.array(list(sums.values()))
        h = float(np.log(size) - (n * np.log(n)).sum() / size)
        return {"h": h, "h_norm": h / np.log(kinds) if kinds > 1 else 0.0}

    return Metric(name, (column,), count, entropy, lambda text: text.select(column).distinct().count())


SCRIPT, LENGTH = category_metric("script", "script"), category_metric("length", "bucket")
#: A metric as a user would write it: mean and deviation of the tokens' lengths.
MEAN_LENGTH = Metric(
    "mean_length", ("token_str",),
    lambda v: {"s": sum(map(len, v["token_str"])), "q": sum(len(t) ** 2 for t in v["token_str"])},
    lambda sums, n, _: {"mean": sums["s"] / n, "std": max(sums["q"] / n - (sums["s"] / n) ** 2, 0.0) ** 0.5})


@query("protocol_metrics", _TASKS + f""", named_ AS (SELECT token_id, 'script' AS metric, script AS category FROM text_ UNION ALL SELECT token_id, 'length', bucket FROM text_),
kinds_ AS (SELECT metric, count(DISTINCT category) AS kinds FROM named_ GROUP BY metric),
n_ AS (SELECT source, seed, scale, metric, cluster_id, category, count(*) AS n FROM task_ JOIN named_ USING (token_id) WHERE cluster_id >= 0 GROUP BY ALL),
h_ AS (SELECT source, seed, scale, metric, cluster_id, CAST(sum(n) AS BIGINT) AS size, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM n_ GROUP BY ALL),
len_ AS (SELECT source, seed, scale, cluster_id, count(*) AS size, avg(length(token_str)) AS m, stddev_pop(length(token_str)) AS s FROM task_ JOIN text_ USING (token_id) WHERE cluster_id >= 0 GROUP BY ALL),
all_ AS (SELECT source, seed, scale, cluster_id, size, metric, 'h' AS component, h AS value FROM h_ UNION ALL SELECT source, seed, scale, cluster_id, size, metric, 'h_norm', CASE WHEN kinds <= 1 THEN 0.0 ELSE h / ln(kinds) END FROM h_ JOIN kinds_ USING (metric)
  UNION ALL SELECT source, seed, scale, cluster_id, size, 'mean_length', 'mean', m FROM len_ UNION ALL SELECT source, seed, scale, cluster_id, size, 'mean_length', 'std', s FROM len_)
SELECT {_KEY}, CAST(scale AS INT) AS scale, CAST(cluster_id AS BIGINT) AS cluster_id, size, metric, component, round(value, 5) + 0.0 AS value FROM all_""")
def protocol_metrics(spark, sf_dir):
    """Two metrics of the library and one of a user over every cluster of every task, in one job."""
    folder = shared_folder(spark, "protocols")
    text = settled(tokens(spark, sf_dir), folder, "tokens")
    rows = evaluate(partition_schedule(spark, sf_dir, text, folder), text, [SCRIPT, LENGTH, MEAN_LENGTH])
    return _keyed(rows).withColumn("value", F.round("value", 5) + 0.0)


# ---- statistics and composers

#: Aggregates over r and t, and their average ranks rr and tr.
STATISTICS: dict[str, Callable[[], Column]] = {
    "n_points": lambda: F.count(F.lit(1)).cast("double"), "pearson": lambda: safe_corr("r", "t"), "spearman": lambda: safe_corr("rr", "tr"), "mae": lambda: F.avg(F.abs(F.col("t") - F.col("r")))}

#: Tables of pairs (by, feature, scale, r, t) to tables of (by, scale, r, t).
COMPOSERS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "mean": lambda pairs, by: pairs.groupBy(*by, "scale").agg(F.avg("r").alias("r"), F.avg("t").alias("t")),
    "apart": lambda pairs, by: pairs.select(*by, F.concat_ws("/", "feature", F.col("scale").cast("string")).alias("scale"), "r", "t")}


def compare(pairs: DataFrame, by: list[str], statistics: Mapping[str, Callable[[], Column]] = STATISTICS) -> DataFrame:
    """(by, statistic, value) of every statistic of each pair: one aggregation."""
    wide = ranked(pairs, by).groupBy(*by).agg(*[f().cast("double").alias(n) for n, f in statistics.items()])
    return wide.select(*by, F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in statistics]), F.array(*statistics))).alias("statistic", "value"))


def largest_gap() -> Column:
    """A statistic as a user would write it."""
    return F.max(F.abs(F.col("t") - F.col("r")))


@query("protocol_statistics", f"WITH {METRIC_SQL}" + """, p_ AS (SELECT b.metric, b.seed, b.scale, avg(a.value) AS r, avg(b.value) AS t FROM mr a JOIN mr b ON a.metric = b.metric AND a.aggregation = b.aggregation AND a.scale = b.scale WHERE a.seed IS NULL AND b.seed IS NOT NULL AND a.aggregation IN ('mean', 'std') GROUP BY b.metric, b.seed, b.scale),
k_ AS (SELECT *, rank() OVER (PARTITION BY metric, seed ORDER BY r) + (count(*) OVER (PARTITION BY metric, seed, r) - 1) / 2 AS rr, rank() OVER (PARTITION BY metric, seed ORDER BY t) + (count(*) OVER (PARTITION BY metric, seed, t) - 1) / 2 AS tr FROM p_),
s_ AS (SELECT metric, seed, CAST(count(*) AS DOUBLE) AS n_points, CASE WHEN min(r) < max(r) AND min(t) < max(t) THEN corr(r, t) END AS pearson, CASE WHEN min(r) < max(r) AND min(t) < max(t) THEN corr(rr, tr) END AS spearman, avg(abs(t - r)) AS mae, max(abs(t - r)) AS largest_gap FROM k_ GROUP BY metric, seed)
SELECT metric, CAST(seed AS BIGINT) AS seed, statistic, round(value, 5) AS value FROM (UNPIVOT s_ ON n_points, pearson, spearman, mae, largest_gap INTO NAME statistic VALUE value)""")
def protocol_statistics(spark, sf_dir):
    """Statistics of the library and one of a user, over curves that a composer has put together."""
    pairs = reference_pairs(metric_results(spark, sf_dir)).withColumnRenamed("aggregation", "feature")
    composed = COMPOSERS["mean"](pairs, ["metric", "seed"])
    return compare(composed, ["metric", "seed"], {**STATISTICS, "largest_gap": largest_gap}).withColumn("value", F.round("value", 5))


# ---- permutation strategies

#: Columns of the tokens inside whose values a strategy deals tokens anew.
STRATEGIES: dict[str, tuple[str, ...]] = {"global": (), "length_bucket": ("bucket",), "script": ("script",)}


def permute(parts: DataFrame, text: DataFrame, strategies: Mapping[str, tuple[str, ...]], seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """(source, seed, scale, token_id, cluster_id): every strategy and seed of the plain partitions (scale, token_id,
    cluster_id). Clusters keep their sizes, and each group of a strategy keeps its seats in every cluster."""
    columns = sorted({c for s in strategies.values() for c in s})
    kept = parts.where("cluster_id >= 0").select("scale", "token_id", "cluster_id").join(text.select("token_id", *columns), "token_id")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.concat_ws("|", F.lit(""), *g).alias("within")) for n, g in strategies.items()]))
    seeded = kept.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds]))).withColumn("k", each).select("k.source", "seed", "scale", "k.within", "token_id", "cluster_id")
    group = ["source", "seed", "scale", "within"]
    seats = numbered(seeded, group, F.col("token_id"), "seat").select(*group, "seat", "cluster_id")
    order = F.sha2(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("token_id").cast("string")), 256)
    drawn = numbered(seeded.select(*group, "token_id"), group, order, "seat").select(*group, "seat", "token_id")
    return seats.join(drawn, [*group, "seat"]).select(*TASK, "token_id", "cluster_id")


@query("protocol_controls", _TASKS + f""", kp_ AS (SELECT 'script' AS source, seed, scale, script AS within, p.token_id, cluster_id FROM part_ p JOIN text_ t ON p.token_id = t.token_id, sd_ WHERE p.source = 'baseline' AND cluster_id >= 0),
st_ AS (SELECT *, row_number() OVER (PARTITION BY seed, scale, within ORDER BY token_id) AS a, row_number() OVER (PARTITION BY seed, scale, within ORDER BY sha256(CAST(seed AS VARCHAR) || ':' || CAST(token_id AS VARCHAR))) AS b FROM kp_),
all_ AS (SELECT 'script' AS source, x.seed, x.scale, y.token_id, x.cluster_id FROM st_ x JOIN st_ y ON x.seed = y.seed AND x.scale = y.scale AND x.within = y.within AND x.a = y.b
  UNION ALL SELECT CASE source WHEN 'permutation' THEN 'global' ELSE source END, seed, scale, token_id, cluster_id FROM task_ WHERE seed IS NOT NULL)
SELECT {_KEY}, CAST(scale AS INT) AS scale, CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS n, CAST(sum(token_id) AS BIGINT) AS ids FROM all_ GROUP BY ALL""")
def protocol_controls(spark, sf_dir):
    """Three strategies, one of them a user's, over all widths and seeds."""
    folder = shared_folder(spark, "protocols")
    text = settled(tokens(spark, sf_dir), folder, "tokens")
    base = settled(nearest_partitions(labelled_matrix(spark, sf_dir), {"baseline": 1.0}), folder, "partitions")
    rows = permute(base, text, STRATEGIES).groupBy(*TASK, "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_id").alias("ids"))
    return _keyed(rows)


# ---- representations


@dataclass(frozen=True)
class Prefix:
    """Widths of one matrix (row_id, features): the first columns of each row."""

    rows: DataFrame

    def load(self, tasks: DataFrame) -> DataFrame:
        """(source, seed, scale, row_id, features) of (source, seed, scale); a width beyond the matrix is an error."""
        short = F.raise_error(F.concat(F.lit("the matrix has no width "), F.col("scale").cast("string"))).cast("array<double>")
        part = F.when(F.size("features") >= F.col("scale"), F.slice("features", F.lit(1), F.col("scale")).cast("array<double>")).otherwise(short)
        return self.rows.join(F.broadcast(tasks.select(*TASK))).select(*TASK, "row_id", part.alias("features"))  # a list of tasks


@dataclass(frozen=True)
class Saved:
    """Representations that a :class:`TaskStore` has by task: files of the wanted tasks are read, no others."""

    store: TaskStore

    def load(self, tasks: DataFrame) -> DataFrame:
        lost = tasks.select(self.store._task()).join(self.store.manifest(), "task", "left_anti").first()
        if lost:
            raise FileNotFoundError(f"no representation is saved for task {lost['task']}")
        return self.store.rows_of(tasks).select(*TASK, "row_id", "features")


@dataclass(frozen=True)
class InMemory:
    """DataFrames (row_id, features) by (source, seed, scale)."""

    frames: Mapping[tuple, DataFrame] = field(default_factory=dict)

    def load(self, tasks: DataFrame) -> DataFrame:
        wanted = [tuple(r) for r in tasks.select(*TASK).collect()]  # a list of tasks
        lost = [t for t in wanted if t not in self.frames]
        if lost or not wanted:
            raise KeyError(f"no representation for {lost}")
        each = [self.frames[t].select(F.lit(t[0]).alias("source"), F.lit(t[1]).cast("long").alias("seed"), F.lit(t[2]).cast("int").alias("scale"), "row_id", F.col("features").cast("array<double>").alias("features")) for t in wanted]
        return reduce(DataFrame.unionByName, each)


Transform = Callable[[Column], Column]
IDENTITY: Transform = lambda features: features
UNIT: Transform = l2_normalised


def represented(provider: Prefix | Saved | InMemory, tasks: DataFrame, transforms: tuple[Transform, ...] = ()) -> DataFrame:
    """What a provider gives, every row through the transforms, one after the other."""
    features = reduce(lambda c, f: f(c), transforms, F.col("features"))
    return provider.load(tasks).withColumn("features", features)


REPRESENTATION_ROWS = T.StructType().add("row_id", "long").add("features", T.ArrayType(T.DoubleType()))


@query("provided_norms", "WITH s_ AS (SELECT unnest([" + ", ".join(map(str, SCALES)) + """]) AS scale), p_ AS (SELECT unnest(['in_memory', 'prefix', 'saved']) AS provider)
SELECT provider, CAST(scale AS INT) AS scale, count(*) AS n_rows, CAST(max(len(x)) AS INT) AS width, round(sum(sqrt(list_sum(list_transform(x, lambda v: v * v)))), 4) AS norms, round(sum(list_sum(list_transform(x, lambda v: v / (sqrt(list_sum(list_transform(x, lambda u: u * u))) + 1e-12)))), 4) + 0.0 AS unit_sum
FROM (SELECT scale, CAST(embedding[1:scale] AS DOUBLE[]) AS x FROM embeddings, s_), p_ GROUP BY provider, scale""")
def provided_norms(spark, sf_dir):
    """The same widths from three providers: prefixes of the matrix, files saved by task, and frames by task."""
    rows, folder = matrix(spark, sf_dir), shared_folder(spark, "representations")
    tasks = spark.createDataFrame([("plain", None, k) for k in SCALES], "source string, seed long, scale int").withColumn("config_hash", F.lit("widths"))
    store = TaskStore(spark, folder, tasks.select(*TASK).schema, REPRESENTATION_ROWS)
    prefix = Prefix(rows)
    store.run(tasks, prefix.load)
    frames = {("plain", None, k): rows.select("row_id", F.slice("features", 1, k).alias("features")) for k in SCALES}
    out = None
    for name, provider in (("prefix", prefix), ("saved", Saved(store)), ("in_memory", InMemory(frames))):
        plain, unit = represented(provider, tasks), represented(provider, tasks, (IDENTITY, UNIT))
        norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x))
        a = plain.groupBy("scale").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("features")).alias("width"), F.round(F.sum(norm), 4).alias("norms"))
        b = unit.groupBy("scale").agg((F.round(F.sum(F.aggregate("features", F.lit(0.0), lambda s, x: s + x)), 4) + 0.0).alias("unit_sum"))
        one = a.join(b, "scale").select(F.lit(name).alias("provider"), "scale", "n_rows", "width", "norms", "unit_sum")
        out = one if out is None else out.unionByName(one)
    return out


# ---- partition methods

#: (source, seed, scale, row_id, features) of some tasks to (source, seed, scale, token_id, cluster_id).
Method = Callable[[DataFrame], DataFrame]


def run_partitions(store: TaskStore, tasks: DataFrame, provider: Prefix | Saved | InMemory, method: Method, transforms: tuple[Transform, ...] = (), policy: RunPolicy = RunPolicy(), stop_on_error: bool = True) -> Report:
    """Load, transform, partition and save tasks (source, seed, scale, config_hash): those that are finished are reused,
    as the policy says, and the representations of the others are loaded only."""
    return store.run(tasks, lambda pending: method(represented(provider, pending, transforms)), policy, stop_on_error)


def quadrants(rows: DataFrame) -> DataFrame:
    """A method as a user would write it: rows by the signs of their first and last column, noise where both are small."""
    first, last = F.element_at("features", 1), F.element_at("features", -1)
    cluster = F.when(F.abs(first) + F.abs(last) < 0.1, -1).otherwise(2 * (first > 0).cast("int") + (last > 0).cast("int"))
    return rows.select(*TASK, F.col("row_id").alias("token_id"), cluster.cast("long").alias("cluster_id"))


@query("protocol_partitions", "WITH s_ AS (SELECT unnest([" + ", ".join(map(str, SCALES)) + """]) AS scale), x_ AS (SELECT scale, vec_id, CAST(embedding[1:scale] AS DOUBLE[]) AS x FROM embeddings, s_),
u_ AS (SELECT scale, vec_id, x[1] / (sqrt(list_sum(list_transform(x, lambda v: v * v))) + 1e-12) AS a, x[len(x)] / (sqrt(list_sum(list_transform(x, lambda v: v * v))) + 1e-12) AS b FROM x_)
SELECT CAST(scale AS INT) AS scale, CASE WHEN abs(a) + abs(b) < 0.1 THEN -1 ELSE 2 * CAST(a > 0 AS INT) + CAST(b > 0 AS INT) END::BIGINT AS cluster_id, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, scale <= 8 AS reused FROM u_ GROUP BY ALL""")
def protocol_partitions(spark, sf_dir):
    """Widths of the matrix, rows brought to length one, partitioned by a user's method and saved by task in two runs."""
    tasks = spark.createDataFrame([("plain", None, k) for k in SCALES], "source string, seed long, scale int").withColumn("config_hash", F.lit("quadrants"))
    store = TaskStore(spark, shared_folder(spark, "quadrants"), tasks.select(*TASK).schema, T.StructType().add("token_id", "long").add("cluster_id", "long"))
    provider = Prefix(matrix(spark, sf_dir))
    run_partitions(store, tasks.where("scale <= 8"), provider, quadrants, (UNIT,))
    report = run_partitions(store, tasks, provider, quadrants, (UNIT,), RunPolicy("resume"))
    reused = report.records.select("scale", (F.col("status") == "reused").alias("reused"))
    counted = store.rows().groupBy("scale", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_id").alias("ids"))
    return counted.join(reused, "scale")


# ---- scale selectors

#: (name, spectrum -> scales): what the candidate scales are united from.
Selector = Callable[[DataFrame], DataFrame]


def energy_selector(thresholds: tuple[float, ...]) -> Selector:
    return lambda s: at_thresholds(s, thresholds).select("scale")


def manual_selector(scales: tuple[int, ...]) -> Selector:
    return lambda s: scales_to_indices(s, scales).where("idx >= 0").select("scale")


def elbow_selector(**options) -> Selector:
    return lambda s: elbows_of(s, **options).select("scale")


def selected(s: DataFrame, selectors: Mapping[str, Selector]) -> DataFrame:
    """(scale, sources): every scale that any selector chose, with the selectors' names."""
    picks = reduce(DataFrame.unionByName, [f(s).select("scale", F.lit(n).alias("selector")) for n, f in selectors.items()])
    return picks.groupBy("scale").agg(F.array_join(F.array_sort(F.collect_set("selector")), ";").alias("sources"))


@query("protocol_scales", _CUM + f""", {_ELBOWS}, k AS (SELECT threshold, coalesce(min(CASE WHEN cum_energy_ratio >= threshold THEN idx END), max(idx)) AS idx FROM cum, (SELECT unnest([0.3, 0.6, 0.9]::DOUBLE[]) AS threshold) GROUP BY threshold),
u AS (SELECT scale, 'elbow' AS selector FROM el JOIN sp ON el.idx = sp.idx UNION ALL SELECT scale, 'energy' FROM k JOIN cum ON k.idx = cum.idx UNION ALL SELECT scale, 'odd' FROM sp WHERE scale % 9 = 0 UNION ALL SELECT scale, 'manual' FROM sp WHERE scale IN (2, 64))
SELECT scale, array_to_string(list_sort(list(DISTINCT selector)), ';') AS sources FROM u GROUP BY scale""")
def protocol_scales(spark, sf_dir):
    """Selectors of the library and one of a user, united."""
    s = spectrum_of(spark, matrix(spark, sf_dir))
    return selected(s, {"elbow": elbow_selector(), "energy": energy_selector((0.3, 0.6, 0.9)), "manual": manual_selector((2, 64)), "odd": lambda s: s.where("scale % 9 = 0").select("scale")})
