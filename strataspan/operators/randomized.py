"""Truncated spectra and principal components by random sketches of the rows, for every scale and seed in the same passes.

A task (scale, seed) starts from seeded Gaussian test vectors and builds a block Krylov space of the row space: each
pass over the rows adds up X'(X V) of all tasks, columns times block, and the driver makes it orthogonal to the blocks
before it. A last pass takes the rows into the space and finds the triangular factor of what comes out by QR
factorisations in the tasks, merged pairwise in a tree; its singular values are the task's. Nothing is squared on the
way to them, and no array of columns times columns is made, anywhere.

The driver and every task hold columns x (scale + oversampling) x (rounds + 1) numbers of a scale and seed. Tasks are
taken in groups of at most ``GROUP_BYTES`` of these; a single larger one makes a group by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.plans.registry import query
from strataspan.sources.tables import SPECTRUM_SQL, matrix

OVERSAMPLE, ROUNDS = 8, 4
GROUP_BYTES = 256 << 20
#: Triangular factors that one task of the tree merges.
FAN_IN = 8
BLOCKS = "task int, row int, x array<double>"


@dataclass(frozen=True)
class Sketch:
    """``axes``: columns x scale, the largest entry of each positive; ``values``: the scale's singular values; ``total``:
    the sum of squares of all (centred) rows."""

    scale: int
    seed: int
    axes: np.ndarray
    values: np.ndarray
    mean: np.ndarray
    total: float
    n: int


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _rows(task: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"task": pa.array(np.full(len(x), task, np.int32)), "row": pa.array(np.arange(len(x), dtype=np.int32)), "x": pa.array(list(x), pa.list_(pa.float64()))})


def _array(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist())


def column_sums(rows: DataFrame) -> tuple[np.ndarray, float, int]:
    """(column sums, sum of squares, rows)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, n = 0.0, 0.0, 0
        for batch in batches:
            if batch.num_rows:
                x = _features(batch)
                total, square, n = total + x.sum(0), square + float((x * x).sum()), n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"d": pa.array(np.arange(len(total), dtype=np.int32)), "s": pa.array(total), "q": pa.array(np.full(len(total), square)), "n": pa.array(np.full(len(total), n))})

    got = rows.select("features").mapInArrow(add, "d int, s double, q double, n long").groupBy("d").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).orderBy("d").toPandas()
    return (got.s.to_numpy(), float(got.q.iloc[0]), int(got.n.iloc[0])) if len(got) else (np.zeros(0), 0.0, 0)


def _applied(rows: DataFrame, blocks: dict[int, np.ndarray], mean: np.ndarray) -> dict[int, np.ndarray]:
    """X'(X V) for the block V of each task, X centred: one pass, one row a task and column back."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros_like(v) for t, v in blocks.items()}
        for batch in batches:
            if batch.num_rows:
                x = _features(batch) - mean
                for t, v in blocks.items():
                    sums[t] += x.T @ (x @ v)
        for t, s in sums.items():
            yield _rows(t, s)

    def merge(group: pa.Table) -> pa.Table:
        return pa.table({"task": group["task"][:1], "row": group["row"][:1], "x": pa.array([_array(group["x"]).sum(0)], pa.list_(pa.float64()))})

    got = rows.select("features").mapInArrow(add, BLOCKS).groupBy("task", "row").applyInArrow(merge, BLOCKS).orderBy("task", "row").toArrow()
    task, x = got["task"].to_numpy(), _array(got["x"]) if len(set(len(r) for r in got["x"].to_pylist())) <= 1 else None
    return {t: (x[task == t] if x is not None else np.array([r for r, k in zip(got["x"].to_pylist(), task) if k == t])) for t in blocks}


def triangles(rows: DataFrame, bases: dict[int, np.ndarray], mean: np.ndarray, fan_in: int = FAN_IN) -> dict[int, np.ndarray]:
    """The triangular factor of X B for the basis B of each task: QR in the tasks, then of stacked factors in a tree."""
    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = _features(batch) - mean
                for t, b in bases.items():
                    y = x @ b
                    found[t] = np.linalg.qr(np.vstack([found[t], y]) if t in found else y, mode="r")
        for t, r in found.items():
            yield _rows(t, r)

    shape = "task int, leaf long, row int, x array<double>"

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("leaf", "ascending"), ("row", "ascending")])
        r = np.linalg.qr(_array(group["x"]), mode="r")
        out = pa.Table.from_batches([_rows(group["task"][0].as_py(), r)])
        return out.add_column(1, "leaf", pa.array(np.full(len(r), group["leaf"][0].as_py() // fan_in)))

    level = rows.select("features").mapInArrow(factor, BLOCKS).withColumn("leaf", F.spark_partition_id().cast("long")).select("task", "leaf", "row", "x")
    leaves = rows.rdd.getNumPartitions()
    while leaves > 1:
        level = level.groupBy("task", F.floor(F.col("leaf") / fan_in).alias("parent")).applyInArrow(merge, shape)
        leaves = -(-leaves // fan_in)
    out: dict[int, list] = {}
    for r in level.orderBy("task", "row").collect():  # of each task a square as wide as its basis
        out.setdefault(r["task"], []).append(r["x"])
    return {t: np.array(r) for t, r in out.items()}


def _beside(new: np.ndarray, before: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``new`` add to the orthonormal ``before``; twice, for rounding."""
    for _ in range(2):
        new = new - before @ (before.T @ new)
        q, r = np.linalg.qr(new)
        keep = np.abs(np.diag(r)) > 1e-10 * max(np.abs(np.diag(r)).max(initial=0), 1e-300)
        new = q[:, keep]
    return new[:, : before.shape[0] - before.shape[1]]


def randomized_svd(rows: DataFrame, tasks: list[tuple[int, int]], centred: bool = False, rounds: int = ROUNDS, oversample: int = OVERSAMPLE) -> list[Sketch]:
    """A sketch for each (scale, seed) of rows (features, ...), each with its own test vectors. ``rounds`` + 3 passes for a
    group of tasks, whatever their number. A scale beyond the rows or columns is an error."""
    total, square, n = column_sums(rows)
    d = len(total)
    bad = [k for k, _ in tasks if not 1 <= k <= min(d, n)]
    if bad or len(set(tasks)) < len(tasks):
        raise ValueError(f"scales beyond the matrix of {n} x {d}: {bad}" if bad else "a task is there twice")
    mean = total / n if centred else np.zeros(d)
    groups: list[list[int]] = [[]]
    held = 0
    for k, (scale, _) in enumerate(tasks):
        size = 8 * d * min(d, (scale + oversample) * (rounds + 1))
        if groups[-1] and held + size > GROUP_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(k)
        held += size
    out: dict[int, Sketch] = {}
    for group in groups if tasks else ():
        blocks = {k: np.linalg.qr(np.random.default_rng(tasks[k][1]).normal(size=(d, min(d, tasks[k][0] + oversample))))[0] for k in group}
        space = dict(blocks)
        for _ in range(rounds):
            blocks = {k: v for k, v in blocks.items() if v.shape[1]}
            if not blocks:
                break
            grown = _applied(rows, blocks, mean)
            blocks = {k: _beside(np.linalg.qr(v)[0], space[k]) for k, v in grown.items()}
            space = {k: np.hstack([v, blocks[k]]) if k in blocks else v for k, v in space.items()}
        for k, r in triangles(rows, space, mean).items():
            scale, seed = tasks[k]
            _, values, right = np.linalg.svd(r)
            axes = space[k] @ right.T[:, :scale]
            axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
            out[k] = Sketch(scale, seed, axes, values[:scale], mean, square - n * float(mean @ mean), n)
    return [out[k] for k in range(len(tasks))]


def project_all(rows: DataFrame, sketches: list[Sketch]) -> DataFrame:
    """(scale, seed, row_id, features): the rows in the axes of every sketch, single precision, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _features(batch)
            for s in sketches:
                y = ((x - s.mean) @ s.axes).astype(np.float32)
                features = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.reshape(-1)))
                yield pa.RecordBatch.from_pydict({"scale": pa.array(np.full(len(y), s.scale, np.int32)), "seed": pa.array(np.full(len(y), s.seed)), "row_id": batch.column("row_id"), "features": features})

    return rows.select("row_id", "features").mapInArrow(run, "scale int, seed long, row_id long, features array<float>")


TASKS = [(scale, seed) for scale in (4, 8, 16, 32) for seed in (11, 12)]
_TASK_SQL = "t_ AS (SELECT unnest([4, 8, 16, 32]) AS w), d_ AS (SELECT unnest([11, 12]) AS seed)"
_CENTRED = SPECTRUM_SQL.replace("sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)) AS v", "sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)) - sum(CAST(a.v AS DOUBLE)) * sum(CAST(b.v AS DOUBLE)) / count(*) AS v")


@query("randomized_singular_values", f"WITH RECURSIVE {SPECTRUM_SQL}, {_TASK_SQL} SELECT CAST(w AS INT) AS scale, CAST(seed AS BIGINT) AS seed, idx, round(value, 5) AS singular_value, round(energy / (SELECT sum(energy) FROM sp), 6) AS energy_ratio FROM sp, t_, d_ WHERE idx < w")
def randomized_singular_values(spark, sf_dir):
    """The largest singular values of the uncentred matrix, found for each scale and seed by itself, with their shares of
    the whole energy."""
    found = [(s.scale, s.seed, k, float(v), float(v * v / max(s.total, 1e-300))) for s in randomized_svd(matrix(spark, sf_dir), TASKS, rounds=6) for k, v in enumerate(s.values)]
    rows = spark.createDataFrame(found, "scale int, seed long, idx int, v double, e double")
    return rows.select("scale", "seed", "idx", F.round("v", 5).alias("singular_value"), F.round("e", 6).alias("energy_ratio"))


@query("randomized_pca", f"WITH RECURSIVE {_CENTRED}, {_TASK_SQL} SELECT CAST(w AS INT) AS scale, CAST(seed AS BIGINT) AS seed, (SELECT count(*) FROM embeddings) AS n_rows, round((SELECT sum(energy) FROM sp WHERE idx < w), 3) AS energy, round((SELECT sum(energy) FROM sp WHERE idx < w) / (SELECT sum(energy) FROM sp), 6) AS explained FROM t_, d_")
def randomized_pca(spark, sf_dir):
    """Scores of the randomised components of every scale and seed: what they hold of the rows is what the singular
    values say."""
    rows = matrix(spark, sf_dir)
    sketches = randomized_svd(rows, TASKS, centred=True, rounds=6)
    energy = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total = F.lit(sketches[0].total)
    return project_all(rows, sketches).groupBy("scale", "seed").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(energy).alias("e")).select("scale", "seed", "n_rows", F.round("e", 3).alias("energy"), F.round(F.col("e") / total, 6).alias("explained"))
