"""Density clustering of row vectors: core distances, a minimum spanning tree, the condensed tree and its stable clusters.

Distances are computed between regions of rows: a task holds a region and a crowd of its visitors and returns a few
numbers for each row, so no pair of rows is ever shuffled. All rows meet once, for their nearest rows; the spanning tree
grows over these in rounds, each of which joins components to their nearest other one under mutual reachability. The
hierarchy of the tree's n - 1 edges is then read in one task for each task key (24 bytes an edge); that step is
sequential by nature.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspan.operators.spectrum import l2_normalised
from strataspan.plans.registry import query
from strataspan.sources.store import settled, shared_folder
from strataspan.sources.tables import matrix

#: Rows of a block at most, by which a cell of many rows is split.
BLOCK = 2048


def _settle(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so that rounds do not pile up."""
    return settled(df, shared_folder(df.sparkSession, "density"), "rows")


#: Rows of a cell, about, and cells at most: with more rows, cells grow and are visited in blocks.
CELL, MAX_CELLS = 512, 4096
#: Regions that cells are put together to, and crowds of visitors of a region: so many, and more only where one would
#: have more rows than these. Up to a million rows, what is shuffled grows with the rows.
REGIONS, REGION_ROWS, CROWDS, CROWD_ROWS = 16, 65_536, 8, 131_072
#: Rows and columns of a step inside a task.
STEP, ACROSS = 512, 1024
#: Neighbours of each row that the spanning tree starts from.
LISTED = 16


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def _closest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int, limit: np.ndarray, apart: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(others, distances) of the k nearest of some rows for each row, itself not included; -1 and infinite where fewer
    are within ``limit``. Equal distances go to the smaller id.

    Steps of products choose the pairs that can be within the k-th distance found so far; those are then measured by the
    differences of their vectors, so that a pair has one distance wherever it is measured. ``apart``, (labels, cores) of
    the rows and of the others: only pairs of two labels count, by their mutual reachability."""
    n, k = len(ids), max(k, 1)
    best_d, best_o, limit = np.full((n, k), np.inf), np.full((n, k), -1, np.int64), np.array(limit, float)
    size_x, size_y = (x * x).sum(1), (y * y).sum(1)
    most = max(size_x.max(initial=0), size_y.max(initial=0))
    kind = np.float32 if most < 1e12 else np.float64  # single precision chooses, double measures
    slack = 16 * np.sqrt(x.shape[1] + 1) * np.finfo(kind).eps * (size_x + size_y.max(initial=0))
    columns = np.ascontiguousarray(np.concatenate([y, -size_y[:, None] / 2], axis=1).T, kind)
    for lo in range(0, n, STEP):
        hi = min(n, lo + STEP)
        rows = np.concatenate([x[lo:hi], np.ones((hi - lo, 1))], axis=1).astype(kind)
        for left in range(0, len(others), ACROSS):
            right = min(len(others), left + ACROSS)
            g = rows @ columns[:, left:right]  # (|x|^2 - d^2) / 2
            fits = g >= np.nextafter(((size_x[lo:hi] - limit[lo:hi] ** 2 - slack[lo:hi]) / 2).astype(kind), kind(-np.inf))[:, None]
            if apart:
                fits &= apart[0][lo:hi, None] != apart[2][None, left:right]
            crowded = np.flatnonzero(fits.sum(1) > 4 * (k + 1)) if right - left > k + 1 else ()
            if len(crowded):  # no more than the k nearest of this step, itself beside them, and ties
                d = np.sqrt(np.maximum(size_x[lo:hi][crowded, None] - 2 * g[crowded], 0))
                if apart:
                    d = np.maximum(d, np.maximum(apart[1][lo:hi][crowded, None], apart[3][None, left:right]))
                d[~fits[crowded]] = np.inf
                fits[crowded] &= d <= (np.partition(d, k, axis=1)[:, k] + 4 * np.sqrt(slack[lo:hi][crowded]))[:, None]
            r, c = np.nonzero(fits)
            if not len(r):
                continue
            r, c = r + lo, c + left
            d = np.concatenate([np.sqrt(((x[r[i : i + 65_536]] - y[c[i : i + 65_536]]) ** 2).sum(1)) for i in range(0, len(r), 65_536)])
            if apart:
                d = np.maximum(d, np.maximum(apart[1][r], apart[3][c]))
            real = (ids[r] != others[c]) & (d <= limit[r])
            r, o, d = r[real], others[c[real]], d[real]
            if not len(r):
                continue
            rows_in = np.unique(r)
            r, o, d = np.concatenate([np.repeat(rows_in, k), r]), np.concatenate([best_o[rows_in].ravel(), o]), np.concatenate([best_d[rows_in].ravel(), d])
            order = np.lexsort((o, d, r))
            r, o, d = r[order], o[order], d[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            first = place < k
            best_d[r[first], place[first]], best_o[r[first], place[first]] = d[first], o[first]
            limit[rows_in] = np.minimum(limit[rows_in], best_d[rows_in, k - 1])
    return best_o, best_d


def _vectors_of(table: pa.Table) -> np.ndarray:
    return table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1)


def _regions(points: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """A region for each point: halved by weight, along the axis in which the points differ most, until there are ``count``."""
    out, todo, used = np.zeros(len(points), np.int32), [(np.arange(len(points)), count)], 0
    while todo:
        own, parts = todo.pop()
        if parts <= 1 or len(own) <= 1:
            out[own], used = used, used + 1
            continue
        own = own[np.argsort(points[own, points[own].var(0).argmax()], kind="stable")]
        before = np.cumsum(weights[own]) - weights[own] / 2
        cut = int(np.clip(np.searchsorted(before, weights[own].sum() * (parts // 2) / parts), 1, len(own) - 1))
        todo += [(own[:cut], parts // 2), (own[cut:], parts - parts // 2)]
    return out


@dataclass
class Cells:
    """Rows in the cells of pivots. ``rows``: (cell, block, region, row_id, x), saved; a cell of many rows has several
    blocks, and a region is made of neighbouring blocks."""

    rows: DataFrame
    n: int
    pivots: np.ndarray
    radius: np.ndarray
    members: np.ndarray  # regions by cells: whether a cell has rows there

    @property
    def crowds(self) -> int:
        return max(min(CROWDS, -(-self.n // (2 * CELL))), -(-self.n // CROWD_ROWS))

    def within(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether a region (columns) can hold a row as near as ``bound``, by the triangle inequality, and because rows of
        a cell are nearer to its pivot than to others."""
        to = _distances(x, self.pivots)
        least = np.maximum(to - self.radius, (to - to.min(1, keepdims=True)) / 2)
        near = least <= (bound + 1e-6 * (1 + to.max(1)))[:, None]  # products round distances near 0 to some 1e-8
        return near.astype(np.float32) @ self.members.T.astype(np.float32) > 0


_X = "array<double>"


def cells(rows: DataFrame) -> Cells | None:
    """The cells of rows (row_id, x): the pivots, at most ``MAX_CELLS`` rows chosen by a hash of their ids, go to the tasks."""
    n = rows.count()
    count = max(1, min(MAX_CELLS, -(-n // CELL)))
    picked = [r[0] for r in rows.select("row_id").orderBy(F.xxhash64("row_id"), "row_id").limit(count).collect()]
    if not picked:
        return None
    chosen = rows.where(F.col("row_id").isin(picked)).select("x").collect()
    pivots = np.array([r["x"] for r in chosen], float)

    def nearest_pivot(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(_vectors_of(pa.Table.from_batches([batch])), pivots)
        return d.argmin(1).astype(np.int32), d.min(1)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                cell, far = nearest_pivot(b)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "row_id": b.column("row_id"), "x": b.column("x"), "far": pa.array(far)})

    dealt = _settle(rows.select("row_id", F.col("x").cast(_X).alias("x")).mapInArrow(assign, f"cell int, row_id long, x {_X}, far double"))
    shape = {r["cell"]: (r["far"], r["n"]) for r in dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    radius = np.array([shape.get(c, (-np.inf, 0))[0] for c in range(count)])
    held = np.array([shape.get(c, (0, 0))[1] for c in range(count)])
    parts = -(-held // BLOCK)
    first = np.cumsum(parts) - parts  # the number of a cell's first block
    cell_of = np.repeat(np.arange(count), parts)
    region_of = _regions(pivots[cell_of], (held / np.maximum(parts, 1))[cell_of], max(REGIONS, -(-n // REGION_ROWS)))
    members = np.zeros((region_of.max() + 1, count), bool)
    members[region_of, cell_of] = True

    def place(batches):
        for b in batches:
            if b.num_rows:
                cell = b.column("cell").to_numpy()
                block = first[cell] + b.column("hash").to_numpy() % parts[cell]
                yield pa.RecordBatch.from_pydict({"cell": b.column("cell"), "block": pa.array(block.astype(np.int32)), "region": pa.array(region_of[block]), "row_id": b.column("row_id"), "x": b.column("x")})

    placed = dealt.select("cell", F.pmod(F.xxhash64("row_id"), F.lit(1 << 40)).alias("hash"), "row_id", "x").mapInArrow(place, f"cell int, block int, region int, row_id long, x {_X}")
    return Cells(placed, n, pivots, radius, members)


def _meetings(found: Cells, visitors: DataFrame, rows: DataFrame, run, shape: str) -> DataFrame:
    """``run`` over crowds of visitors (regions, row_id, ...) of each region and the region's rows (region, row_id, ...):
    a visitor is sent once to each of its regions, a region's rows once to each crowd. No pairs are shuffled."""
    crowds, key = found.crowds, ["region", "crowd"]
    left = visitors.withColumn("region", F.explode("regions")).drop("regions").withColumn("crowd", F.pmod(F.xxhash64("row_id"), F.lit(crowds)).cast("int"))
    right = rows.withColumn("crowd", F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))))
    parts = len(found.members) * crowds  # asked for outright: groups are much work for their bytes
    return left.repartition(parts, *key).groupBy(*key).cogroup(right.repartition(parts, *key).groupBy(*key)).applyInArrow(run, shape)


_NEAR = "row_id long, near array<struct<d: double, other: long>>"


def _lists(ids: np.ndarray, others: np.ndarray, d: np.ndarray) -> pa.Table:
    real = np.isfinite(d)
    near = pa.StructArray.from_arrays([pa.array(d[real]), pa.array(others[real])], ["d", "other"])
    return pa.table({"row_id": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(real.sum(1)))).astype(np.int32)), near)})


def neighbours(rows: DataFrame | Cells, k: int) -> DataFrame:
    """(row_id, near): the k nearest rows of each row (row_id, x), itself not included, as (d, other), nearest first; ties
    go to the smaller id.

    A block of a cell by itself bounds each row's k-th distance; the row then has to visit only the regions that can hold
    something nearer, each at most once, so what is shuffled is a row for each region that it visits. The result is
    exact; with nothing to tell regions apart, every row visits all of them."""
    found = rows if isinstance(rows, Cells) else cells(rows)
    if found is None:
        return rows.select("row_id", F.array(F.struct(F.lit(0.0).alias("d"), F.col("row_id").alias("other"))).alias("near")).limit(0)

    def visits(block: pa.Table) -> pa.Table:
        x, ids = _vectors_of(block), block["row_id"].to_numpy()
        bound = _closest(x, ids, x, ids, k, np.full(len(ids), np.inf))[1][:, -1]
        near = found_within(x, bound)
        regions = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(near.sum(1)))).astype(np.int32)), pa.array(np.nonzero(near)[1].astype(np.int32)))
        return pa.table({"row_id": block["row_id"], "x": block["x"], "bound": bound, "regions": regions})

    found_within = Cells(None, found.n, found.pivots, found.radius, found.members).within  # without the table, for the tasks
    asked = _settle(found.rows.select("block", "row_id", "x").groupBy("block").applyInArrow(visits, f"row_id long, x {_X}, bound double, regions array<int>"))

    def meet(visitors: pa.Table, block: pa.Table) -> pa.Table:
        ids = visitors["row_id"].to_numpy()
        if not len(visitors) or not len(block):
            return _lists(ids[:0], np.zeros((0, k), np.int64), np.zeros((0, k)))
        return _lists(ids, *_closest(_vectors_of(visitors), ids, _vectors_of(block), block["row_id"].to_numpy(), k, visitors["bound"].to_numpy()))

    met = _meetings(found, asked, found.rows.select("region", "row_id", "x"), meet, _NEAR)
    return met.groupBy("row_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def nearest(rows: DataFrame, k: int) -> DataFrame:
    """(row_id, other, d): :func:`neighbours`, a row each."""
    return neighbours(rows, k).select("row_id", F.explode("near").alias("x")).select("row_id", "x.other", "x.d")


def core_distances(rows: DataFrame, min_samples: int) -> DataFrame:
    """(row_id, core): the distance to the min_samples-th nearest row, the row itself counted first."""
    if min_samples <= 1:
        return rows.select("row_id", F.lit(0.0).alias("core"))
    return neighbours(rows, min_samples - 1).where(F.size("near") > 0).select("row_id", _core(min_samples).alias("core"))


def _core(min_samples: int) -> Column:
    """The core distance in a list of at least so many neighbours, or of all."""
    return F.coalesce(F.get("near.d", F.least(F.size("near"), F.lit(min_samples - 1)) - 1), F.lit(0.0)) if min_samples > 1 else F.lit(0.0)


def spanning_tree(rows: DataFrame, min_samples: int) -> DataFrame:
    """(a, b, d): the edges of the minimum spanning tree under mutual reachability, ties by ids.

    Every row's nearest rows are listed once. What a row has not listed is no nearer than the last that it has, so the
    shortest listed edge that leaves a component is a tree's edge where it is shorter than the last distances of all the
    component's rows. Rounds take these edges. Only where no component has one, the rows of all but the largest that could
    have something shorter search all rows again."""
    found = cells(rows)
    if found is None:
        return rows.select(F.col("row_id").alias("a"), F.col("row_id").alias("b"), F.lit(0.0).alias("d")).limit(0)
    k = max(LISTED, min_samples - 1)
    lists = _settle(neighbours(found, k))
    # without a k-th neighbour all other rows are listed
    base = _settle(lists.select("row_id", _core(min_samples).alias("core"), F.when(F.size("near") < k, float("inf")).otherwise(F.get("near.d", F.lit(k - 1))).alias("last")))
    core = lambda c: base.select(F.col("row_id").alias(c), F.col("core").alias(f"core_{c}"))
    each = lists.select("row_id", F.explode("near").alias("x")).select(F.least("row_id", "x.other").alias("a"), F.greatest("row_id", "x.other").alias("b"), "x.d")
    each = each.groupBy("a", "b").agg(F.min("d").alias("d")).join(core("a"), "a").join(core("b"), "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("d"))
    edges = _settle(each.select("a", "b", "d", F.col("a").alias("la"), F.col("b").alias("lb")))
    labels = base.select("row_id", F.col("row_id").alias("label"))
    one = F.struct("d", "a", "b").alias("e")
    trees = []
    while True:
        groups = _settle(base.join(labels, "row_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("last").alias("last")))
        if groups.limit(2).count() < 2:
            break
        out = edges.select(F.col("la").alias("label"), one).unionByName(edges.select(F.col("lb").alias("label"), one)).groupBy("label").agg(F.min("e").alias("e"))
        out = _settle(groups.join(out, "label", "left"))
        chosen = _settle(out.where("e.d < last").select("e.*").distinct())
        if chosen.isEmpty():
            chosen = _settle(_searched(found, base.join(labels, "row_id"), out))
        trees.append(chosen)
        moved = _settle(_relabel(labels, chosen))
        to = _settle(labels.withColumnRenamed("label", "old").join(moved, "row_id").where("old <> label").select("old", "label").distinct())
        labels = moved
        for c in ("la", "lb"):
            edges = edges.join(to.select(F.col("old").alias(c), F.col("label").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        edges = _settle(edges.where("la <> lb").select("a", "b", "d", "la", "lb"))
    return reduce(DataFrame.unionByName, trees) if trees else base.select(F.col("row_id").alias("a"), F.col("row_id").alias("b"), F.col("core").alias("d")).limit(0)


def _searched(found: Cells, marked: DataFrame, out: DataFrame) -> DataFrame:
    """(d, a, b): the shortest edge of each component but the largest, from ``marked`` (row_id, core, last, label) and
    ``out`` (label, n, last, e) with the shortest listed edges."""
    largest = out.orderBy(F.desc("n"), "label").first()["label"]
    asking = out.where(F.col("label") != largest).select("label", "e", F.coalesce("e.d", F.lit(float("inf"))).alias("bound"))
    placed = found.rows.join(marked, "row_id").select("region", "row_id", "x", "label", "core", "last")
    within = Cells(None, found.n, found.pivots, found.radius, found.members).within
    columns = f"row_id long, x {_X}, label long, core double, bound double"

    def visits(batches):
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                near = within(_vectors_of(t), t["bound"].to_numpy())
                regions = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(near.sum(1)))).astype(np.int32)), pa.array(np.nonzero(near)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, regions], [*b.schema.names, "regions"])

    visitors = placed.join(asking.drop("e"), "label").where("last <= bound").select("row_id", "x", "label", "core", "bound").mapInArrow(visits, f"{columns}, regions array<int>")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"label": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}
        if not len(left) or not len(right):
            return pa.table(empty)
        ids = left["row_id"].to_numpy()
        apart = (left["label"].to_numpy(), left["core"].to_numpy(), right["label"].to_numpy(), right["core"].to_numpy())
        o, d = _closest(_vectors_of(left), ids, _vectors_of(right), right["row_id"].to_numpy(), 1, left["bound"].to_numpy(), apart)
        real = np.isfinite(d[:, 0])
        p, q = ids[real], o[real, 0]
        best = pd.DataFrame({"label": apart[0][real], "d": d[real, 0], "a": np.minimum(p, q), "b": np.maximum(p, q)}).sort_values(["d", "a", "b"]).groupby("label", as_index=False).first()
        return pa.Table.from_pandas(best[["label", "d", "a", "b"]], preserve_index=False)

    more = _meetings(found, visitors, placed.select("region", "row_id", "x", "label", "core"), meet, "label long, d double, a long, b long")
    both = more.select("label", F.struct("d", "a", "b").alias("e")).unionByName(asking.where("e IS NOT NULL").select("label", "e"))
    return both.groupBy("label").agg(F.min("e").alias("e")).select("e.*").distinct()


def _relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after the components at both ends of each edge are joined: smallest labels and pointer jumping."""
    side = lambda c: labels.select(F.col("row_id").alias(c), F.col("label").alias(f"l{c}"))
    links = _settle(edges.join(side("a"), "a").join(side("b"), "b").select(F.col("la").alias("u"), F.col("lb").alias("v")))
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    comp = _settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")))
    while True:
        near = both.join(comp.select(F.col("u").alias("v"), F.col("to").alias("tv")), "v").groupBy("u").agg(F.min("tv").alias("tv"))
        step = comp.join(near, "u").select("u", "to", F.least("to", "tv").alias("n"))
        new = _settle(step.join(comp.select(F.col("u").alias("n"), F.col("to").alias("f")), "n", "left").select("u", F.least("n", "f").alias("n"), (F.least("n", "f") < F.col("to")).alias("moved")))
        comp = new.select("u", F.col("n").alias("to"))
        if new.where("moved").isEmpty():
            break
    return labels.join(comp.withColumnRenamed("u", "label"), "label", "left").select("row_id", F.coalesce("to", "label").alias("label"))


def read_hierarchy(a: np.ndarray, b: np.ndarray, d: np.ndarray, ids: np.ndarray, min_size: int, epsilon: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(labels, probabilities) by excess of mass over the condensed tree; the root is no cluster; -1 is noise.

    Clusters are numbered by their smallest member. A member's probability is its density in its cluster over the
    cluster's largest.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0)
    at = {int(k): i for i, k in enumerate(ids)}
    order = np.lexsort((b, a, d))
    # single linkage: node n + k joins two nodes at distance d
    parent, top = np.arange(2 * n), list(range(n))
    left, right, dist, size = np.full(2 * n, -1), np.full(2 * n, -1), np.zeros(2 * n), np.ones(2 * n, np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    k = n
    for e in order.tolist():
        i, j = top[root(at[int(a[e])])], top[root(at[int(b[e])])]
        ri, rj = root(at[int(a[e])]), root(at[int(b[e])])
        left[k], right[k], dist[k], size[k] = i, j, d[e], size[i] + size[j]
        parent[rj] = ri
        top[ri] = k
        k += 1
    rootnode = k - 1
    if n < 2 or rootnode < n:
        return np.full(n, -1), np.zeros(n)
    lam = lambda x: 1 / x if x > 0 else np.inf
    # condense from the root
    birth, children, members, stability = {0: 0.0}, {0: []}, {0: []}, {0: 0.0}
    stack, count = [(rootnode, 0)], 1
    fall, home = np.zeros(n), np.zeros(n, np.int64)

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += [left[x], right[x]]
        return out

    while stack:
        node, c = stack.pop()
        if node < n:
            fall[node], home[node] = birth[c], c
            continue
        level = lam(dist[node])
        l, r = int(left[node]), int(right[node])
        big = [x for x in (l, r) if size[x] >= min_size]
        if len(big) == 2:
            for x in (l, r):
                birth[count], children[count], stability[count] = level, [], 0.0
                children[c].append(count)
                stability[c] += size[x] * (min(level, 1e300) - birth[c])
                stack.append((x, count))
                count += 1
        else:
            for x in (l, r):
                if x in big:
                    stack.append((x, c))
                else:
                    own = leaves(x)
                    fall[own], home[own] = level, c
                    stability[c] += len(own) * (min(level, 1e300) - birth[c])
    chosen = dict.fromkeys(birth, False)
    value = dict(stability)
    for c in range(count - 1, 0, -1):
        below = sum(value[x] for x in children[c])
        if children[c] and below > value[c]:
            value[c] = below
        else:
            chosen[c] = True
            todo = list(children[c])
            while todo:
                x = todo.pop()
                chosen[x] = False
                todo += children[x]
    up = {x: c for c, xs in children.items() for x in xs}
    if epsilon > 0:
        for c in [c for c in chosen if chosen[c]]:
            if birth[c] > 0 and 1 / birth[c] < epsilon:
                x = c
                while up.get(x, 0) and 1 / birth[x] < epsilon:
                    x = up[x]
                chosen[c] = False
                chosen[x] = True
    owner = {}
    for c in range(count):
        owner[c] = c if chosen[c] else (owner[up[c]] if c in up else -1)
    # under a chosen cluster everything belongs to it
    for c in range(count):
        if c in up and owner[up[c]] >= 0:
            owner[c] = owner[up[c]]
    raw = np.array([owner[int(h)] for h in home])
    labels, prob = np.full(n, -1), np.zeros(n)
    own = np.flatnonzero(raw >= 0)
    if not len(own):
        return labels, prob
    kinds, kind = np.unique(raw[own], return_inverse=True)
    first, best = np.full(len(kinds), np.iinfo(np.int64).max), np.full(len(kinds), -np.inf)
    np.minimum.at(first, kind, ids[own])
    np.maximum.at(best, kind, fall[own])
    labels[own] = np.argsort(np.argsort(first))[kind]
    top, level = best[kind], fall[own]
    bounded = np.isfinite(top) & (top > 0)
    prob[own] = np.where(bounded, np.divide(np.minimum(level, top), top, out=np.ones(len(own)), where=bounded), np.where(np.isfinite(top) | ~np.isfinite(level), 1.0, 0.0))
    return labels, prob


def density_partition(rows: DataFrame, min_size: int = 5, min_samples: int = 5, epsilon: float = 0.0) -> DataFrame:
    """(token_id, cluster_id, probability) of rows (row_id, x)."""
    tree = spanning_tree(rows, min_samples)
    ids = rows.select(F.lit(0).alias("task"), F.col("row_id").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0.0).alias("d"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(f[f.b < 0].a.to_numpy())
        e = f[f.b >= 0]
        labels, prob = read_hierarchy(e.a.to_numpy(), e.b.to_numpy(), e.d.to_numpy(), own, min_size, epsilon)
        return pd.DataFrame({"token_id": own, "cluster_id": labels, "probability": prob.astype(np.float32)})

    both = ids.unionByName(tree.select(F.lit(0).alias("task"), "a", "b", "d"))
    return both.groupBy("task").applyInPandas(run, "token_id long, cluster_id long, probability float")


def _vectors(spark, sf_dir, scale: int = 64) -> DataFrame:
    return matrix(spark, sf_dir).select("row_id", l2_normalised(F.slice("features", 1, scale)).alias("x"))


_VEC = """v AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: CAST(x AS DOUBLE) / (sqrt(list_sum(list_transform(embedding[1:64], lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) + 1e-12)) AS x FROM embeddings),
pd AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.x[k] - b.x[k]) * (a.x[k] - b.x[k])))) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
core AS (SELECT i AS row_id, max(d) AS core FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM pd) WHERE r <= 4 GROUP BY i)"""


@query("knn_core_distance", f"WITH {_VEC} SELECT row_id, round(core, 5) AS core FROM core")
def knn_core_distance(spark, sf_dir):
    return core_distances(_vectors(spark, sf_dir), 5).select("row_id", F.round("core", 5).alias("core"))


@query("mutual_reachability", f"WITH {_VEC}, nn AS (SELECT i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM pd) WHERE r = 1) SELECT i AS row_id, round(greatest(d, ci.core, cj.core), 5) AS reach FROM nn JOIN core ci ON nn.i = ci.row_id JOIN core cj ON nn.j = cj.row_id")
def mutual_reachability(spark, sf_dir):
    """The mutual reachability of each row and its nearest row."""
    lists = _settle(neighbours(_vectors(spark, sf_dir), 4).where(F.size("near") > 0).select("row_id", _core(5).alias("ca"), F.get("near", F.lit(0)).alias("first")))
    core = lists.select(F.col("row_id").alias("other"), F.col("ca").alias("cb"))
    return lists.withColumn("other", F.col("first.other")).join(core, "other").select("row_id", F.round(F.greatest("first.d", "ca", "cb"), 5).alias("reach"))


@query("hdbscan_labels")
def hdbscan_labels(spark, sf_dir):
    return density_partition(_vectors(spark, sf_dir))


@query("hdbscan_scale_counts")
def hdbscan_scale_counts(spark, sf_dir):
    """Clusters and noise of nested widths of one matrix, a task for each width."""
    out = None
    for k in (4, 16, 64):
        p = density_partition(_vectors(spark, sf_dir, k)).agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"), F.count(F.when(F.col("cluster_id") < 0, 1)).alias("n_noise")).withColumn("scale", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out
