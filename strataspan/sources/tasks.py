"""Results by task, computed once: a resumable sink with a manifest, and reports of what each run really did.

A task is a row of key columns with the hash of its configuration. A run plans its tasks against the manifest: finished
ones are reused after their rows have been checked, tasks of another configuration are an error, the others are computed
together in one job. Their rows go to folders of the run's own; the manifest, a table with one row for each finished
task, is replaced in one step at the end, so a run that dies leaves the tasks before it as they were, and readers see a
task as it was or as it is. One run at a time writes to a store.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.sources.manifested import read_manifested
from strataspan.sources.store import RunPolicy, Store, settled, shared_folder

STATUSES = ("computed", "reused", "failed")
#: Columns of a manifest beside the key.
ENTRY = T.StructType().add("task", "string").add("config_hash", "string").add("path", "string").add("n_rows", "long").add("digest", "long").add("run_id", "string")


def same(a: str, b: str, key: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key])


def config_hash(*parts: str | Column) -> Column:
    """SHA-256 of parts of a configuration, nulls told apart from texts."""
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), t), F.lit("-")) for t in texts]), 256)


@dataclass
class Report:
    """``records``: (key, status, reason, n_rows, config_hash, run_id), one row for each task of the run; ``counts``: of
    each status, observed while the records were written."""

    records: DataFrame
    counts: dict[str, int]


class TaskFailures(RuntimeError):
    def __init__(self, report: Report):
        super().__init__(f"{report.counts['failed']} of {sum(report.counts.values())} tasks failed")
        self.report = report


class TaskStore:
    """Rows of many tasks below one folder. ``key``: columns of a task; ``schema``: columns of its rows, without the key."""

    def __init__(self, spark: SparkSession, path: str, key: T.StructType, schema: T.StructType):
        self.spark, self.path, self.key_schema, self.schema = spark, path.rstrip("/"), key, schema
        self.key = key.fieldNames()
        self.store = Store(spark, self.path)

    @property
    def manifest_path(self) -> str:
        found = self.store._marker("manifest")
        if found is None:
            raise FileNotFoundError(f"{self.path} has no finished task")
        return f"{self.path}/manifest/{found[1]}"

    def manifest(self) -> DataFrame:
        """(key, task, config_hash, path, n_rows, digest, run_id) of the finished tasks."""
        shape = T.StructType([*self.key_schema.fields, *ENTRY.fields])
        if not self.store.has("manifest"):
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(self.manifest_path)

    def rows(self) -> DataFrame:
        """(key, task, run_id, columns) of all finished tasks; a filter on key, task or run reads the files of those only."""
        shape = T.StructType([*self.key_schema.fields, T.StructField("task", T.StringType()), T.StructField("run_id", T.StringType()), *self.schema.fields])
        return read_manifested(self.spark, self.manifest_path, shape, key="task", root=self.path)

    def rows_of(self, tasks: DataFrame) -> DataFrame:
        """The same of some tasks, given by their key: a bounded list, as tasks are."""
        wanted = [r[0] for r in tasks.select(self._task()).distinct().collect()]
        return self.rows().where(F.col("task").isin(wanted))

    def _task(self) -> Column:
        return F.substring(config_hash(*self.key), 1, 32).alias("task")

    def _tallied(self, rows: DataFrame) -> DataFrame:
        """(task, n_rows, digest): the digest does not depend on the order or the files of the rows."""
        each = F.xxhash64(*self.schema.fieldNames())
        # a sum beside the exclusive or, under which a row that comes twice would vanish
        digest = F.bit_xor(each).bitwiseXOR(F.sum(F.shiftrightunsigned(each, 32)))
        return rows.groupBy("task").agg(F.count(F.lit(1)).alias("n_rows"), digest.alias("digest"))

    def _plan(self, tasks: DataFrame, policy: RunPolicy, folder: str) -> DataFrame:
        """(key, task, config_hash, have): ``have`` is the manifest's row of a task that is to be reused."""
        entry = F.struct(*ENTRY.fieldNames())
        have = self.manifest().select(F.col("task").alias("__task"), entry.alias("have"))
        planned = settled(tasks.select(*self.key, "config_hash", self._task()).join(have, F.col("task") == F.col("__task"), "left").drop("__task"), folder, "planned")
        twice = planned.groupBy("task").count().where("count > 1").first()
        if twice:
            raise ValueError(f"a task is planned twice: {twice['task']}")
        there = planned.where("have IS NOT NULL")
        if policy.existing == "error" and not there.isEmpty():
            raise FileExistsError(f"{self.path} has {there.first()['have']['path']} already")
        if policy.existing == "replace":
            return planned.withColumn("have", F.lit(None).cast(planned.schema["have"].dataType))
        other = there.where("have.config_hash <> config_hash").first()
        if other:
            raise ValueError(f"{other['have']['path']} was made with another configuration")
        return planned

    def _check(self, reused: DataFrame) -> None:
        """What is to be reused must be there with the rows and the digest that the manifest tells."""
        want = reused.select("task", F.col("have.n_rows").alias("want_rows"), F.col("have.digest").alias("want_digest"))
        bad = want.join(self._tallied(self.rows_of(reused)), "task", "left").where(~(F.coalesce("n_rows", F.lit(0)).eqNullSafe(F.col("want_rows")) & F.coalesce("digest", F.lit(0)).eqNullSafe(F.col("want_digest")))).first()
        if bad:
            raise ValueError(f"the saved rows of task {bad['task']} are not those of the manifest")

    def run(self, tasks: DataFrame, compute: Callable[[DataFrame], DataFrame], policy: RunPolicy = RunPolicy(), stop_on_error: bool = True, may_be_empty: DataFrame | None = None) -> Report:
        """Bring ``tasks`` (key, config_hash) to be finished. ``compute`` gets (key, config_hash) of those to be done, in
        one table, and returns their rows (key, columns); with a further column ``error``, a text there fails the task
        of the row. A task without rows fails, too, but for those in ``may_be_empty`` (key), whose result can be no rows. Failed tasks are not kept; with ``stop_on_error`` they raise
        :class:`TaskFailures` after the others are."""
        run_id, folder = uuid.uuid4().hex, shared_folder(self.spark, "tasks")
        planned = self._plan(tasks, policy, folder)
        reused, pending = planned.where("have IS NOT NULL"), planned.where("have IS NULL").drop("have")
        if not reused.isEmpty():
            self._check(reused)
        done = pending.select("task", F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("long").alias("digest"), F.lit(None).cast("string").alias("error")).limit(0)
        if not pending.isEmpty():
            done = self._compute(pending, compute, run_id)
        tried = pending.join(done, "task", "left")
        if may_be_empty is not None:
            none = F.col("__may") & F.col("error").isNull()
            tried = tried.join(may_be_empty.select(self._task(), F.lit(True).alias("__may")).distinct(), "task", "left").withColumns({c: F.when(none, F.coalesce(c, F.lit(0))).otherwise(F.col(c)) for c in ("n_rows", "digest")}).drop("__may")
        tried = settled(tried, folder, "tried")
        ok = F.col("error").isNull() & F.col("n_rows").isNotNull()
        for r in tried.where(ok & (F.col("n_rows") == 0)).select("task").collect():  # tasks are a bounded list
            self._folder(f"data/{run_id}/task={r['task']}")
        new = tried.where(ok).select(*self.key, "task", "config_hash", F.concat(F.lit(f"data/{run_id}/task="), "task").alias("path"), "n_rows", "digest", F.lit(run_id).alias("run_id"))
        merged = settled(self.manifest().join(new.select("task"), "task", "left_anti").select(*new.columns).unionByName(new).coalesce(1), folder, "manifest")
        if not tried.where(ok).isEmpty():
            self.store.write("manifest", merged, {"run": run_id}, RunPolicy("replace"))
        return self._report(reused, tried, ok, run_id, stop_on_error)

    def _folder(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)

    def _compute(self, pending: DataFrame, compute: Callable[[DataFrame], DataFrame], run_id: str) -> DataFrame:
        rows = compute(pending.select(*self.key, "config_hash"))
        error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
        lost = [f.name for f in self.schema if f.name not in rows.columns or rows.schema[f.name].dataType != f.dataType]
        if lost:
            raise ValueError(f"computed rows lack {lost}, or have them in other types")
        path = f"{self.path}/data/{run_id}"
        laid = rows.select(self._task(), *self.schema.fieldNames(), error.alias("error"))
        laid.hint("rebalance", "task").write.partitionBy("task").parquet(path)  # a large task is split, small ones make one file each
        back = self.spark.read.schema(laid.schema).parquet(path)
        return self._tallied(back).join(back.groupBy("task").agg(F.min("error").alias("error")), "task")

    def _report(self, reused: DataFrame, tried: DataFrame, ok: Column, run_id: str, stop_on_error: bool) -> Report:
        status = F.when(ok, "computed").otherwise("failed")
        reason = F.when(~ok, F.coalesce("error", F.lit("no rows")))
        old = reused.select(*self.key, F.lit("reused").alias("status"), F.lit(None).cast("string").alias("reason"), F.col("have.n_rows").alias("n_rows"), "config_hash", F.col("have.run_id").alias("run_id"))
        records = old.unionByName(tried.select(*self.key, status.alias("status"), reason.alias("reason"), "n_rows", "config_hash", F.lit(run_id).alias("run_id")))
        seen = Observation(f"tasks-{run_id}")
        records.observe(seen, *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES]).write.parquet(f"{self.path}/reports/{run_id}")
        report = Report(self.spark.read.schema(records.schema).parquet(f"{self.path}/reports/{run_id}"), {s: seen.get[s] for s in STATUSES})
        if stop_on_error and report.counts["failed"]:
            raise TaskFailures(report)
        return report

    def vacuum(self) -> int:
        """Delete the data of runs that no task of the manifest refers to; the number of runs deleted."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(f"{self.path}/data")
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        used = {r[0].split("/")[1] for r in self.manifest().select("path").collect()}
        gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in used]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
