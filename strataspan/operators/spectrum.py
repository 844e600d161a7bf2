"""Spectrum of a matrix, scale selection, principal components and random projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspan.plans.registry import query
from strataspan.sources.tables import SCALES, SPECTRUM_SQL, matrix

THRESHOLDS = (0.5, 0.75, 0.9, 0.95)
LOW_THRESHOLDS = tuple(round(0.12 + 0.03 * k, 2) for k in range(12))
_S = f"WITH RECURSIVE {SPECTRUM_SQL} "
_CUM = f"WITH RECURSIVE {SPECTRUM_SQL}, cum AS (SELECT *, energy / sum(energy) OVER () AS energy_ratio, sum(energy) OVER (ORDER BY idx) / sum(energy) OVER () AS cum_energy_ratio FROM sp) "
ROUND = 5


def _order():
    # a spectrum has one row for each column of the matrix, so these windows see a bounded number of rows
    return W.orderBy("idx")


def spectrum_of(spark: SparkSession, rows: DataFrame, components: int | None = None) -> DataFrame:
    """(idx, scale, value, energy): the singular values of the uncentred matrix, largest first, and their squares.

    They are the roots of the eigenvalues of the Gram matrix, whose size is the number of columns. ``components`` keeps
    the first only."""
    gram, _, _ = moments(rows)
    e = np.maximum(np.linalg.eigvalsh(gram)[::-1], 0)[:components]
    return spark.createDataFrame([(k, k + 1, float(np.sqrt(v)), float(v)) for k, v in enumerate(e)], "idx int, scale int, value double, energy double")


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum_of(spark, matrix(spark, sf_dir))


def scales_to_indices(s: DataFrame, scales: tuple[int, ...]) -> DataFrame:
    """(scale, idx) of the wanted scales; one that is not on the axis, or on it twice, is an error."""
    want = s.sparkSession.createDataFrame([(int(k),) for k in sorted(set(scales))], "scale int")
    found = want.join(s.groupBy("scale").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx")), "scale", "left")
    bad = F.raise_error(F.concat(F.lit("scale is not on the axis exactly once: "), F.col("scale").cast("string")))
    return found.select("scale", F.when(F.coalesce("n", F.lit(0)) == 1, F.col("idx")).otherwise(bad.cast("int")).alias("idx"))


def cumulative(s: DataFrame) -> DataFrame:
    total = F.sum("energy").over(W.partitionBy())
    return s.withColumn("energy_ratio", F.col("energy") / total).withColumn("cum_energy_ratio", F.sum("energy").over(_order().rowsBetween(W.unboundedPreceding, 0)) / total)


@query("cumulative_energy", _CUM + "SELECT idx, scale, round(value, 6) AS value, round(energy_ratio, 6) AS energy_ratio, round(cum_energy_ratio, 6) AS cum_energy_ratio FROM cum")
def cumulative_energy(spark, sf_dir):
    return cumulative(spectrum(spark, sf_dir)).select("idx", "scale", *[F.round(c, 6).alias(c) for c in ("value", "energy_ratio", "cum_energy_ratio")])


def at_thresholds(s: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, idx, scale, cumulative_energy): the first place that reaches each threshold, the last where none does."""
    if len(set(thresholds)) != len(thresholds) or not all(0 < t <= 1 for t in thresholds):
        raise ValueError("thresholds are unique and in (0, 1]")
    c = cumulative(s)
    each = c.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    idx = each.groupBy("threshold").agg(F.coalesce(F.min(F.when(F.col("cum_energy_ratio") >= F.col("threshold"), F.col("idx"))), F.max("idx")).alias("idx"))
    return idx.join(c, "idx").select("threshold", "idx", "scale", F.col("cum_energy_ratio").alias("cumulative_energy"))


def _threshold_sql(values: tuple[float, ...]) -> str:
    return _CUM + f""", t AS (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in values)}]) AS threshold),
k AS (SELECT threshold, coalesce(min(CASE WHEN cum_energy_ratio >= threshold THEN idx END), max(idx)) AS idx FROM cum, t GROUP BY threshold)
SELECT threshold, CAST(k.idx AS INT) AS idx, scale, round(cum_energy_ratio, 6) AS cumulative_energy FROM k JOIN cum ON k.idx = cum.idx"""


@query("energy_thresholds", _threshold_sql(THRESHOLDS))
def energy_thresholds(spark, sf_dir):
    return at_thresholds(spectrum(spark, sf_dir), THRESHOLDS).withColumn("cumulative_energy", F.round("cumulative_energy", 6))


@query("low_domain_thresholds", _threshold_sql(LOW_THRESHOLDS))
def low_domain_thresholds(spark, sf_dir):
    return at_thresholds(spectrum(spark, sf_dir), LOW_THRESHOLDS).withColumn("cumulative_energy", F.round("cumulative_energy", 6))


@query("log_spectrum", _S + "SELECT idx, round(ln(energy + 1e-12), 6) AS log_energy, round(ln(value + 1e-12), 6) AS log_value FROM sp")
def log_spectrum(spark, sf_dir):
    return spectrum(spark, sf_dir).select("idx", F.round(F.ln(F.col("energy") + 1e-12), 6).alias("log_energy"), F.round(F.ln(F.col("value") + 1e-12), 6).alias("log_value"))


@query("curvature", _S + """, l AS (SELECT idx, ln(energy + 1e-12) AS y FROM sp), d AS (SELECT idx, lead(y, 2) OVER (ORDER BY idx) - 2 * lead(y) OVER (ORDER BY idx) + y AS c FROM l)
SELECT idx, round(c, 6) + 0.0 AS curvature FROM d WHERE c IS NOT NULL""")
def curvature(spark, sf_dir):
    y = F.ln(F.col("energy") + 1e-12)
    c = spectrum(spark, sf_dir).select("idx", y.alias("y")).select("idx", (F.lead("y", 2).over(_order()) - 2 * F.lead("y").over(_order()) + F.col("y")).alias("c"))
    return c.where("c IS NOT NULL").select("idx", F.round("c", 6).alias("curvature"))


@query("rolling_median", _S + "SELECT idx, round(quantile_cont(value, 0.5) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median FROM sp")
def rolling_median(spark, sf_dir):
    return spectrum(spark, sf_dir).select("idx", F.round(F.percentile("value", 0.5).over(_order().rowsBetween(-2, 2)), 6).alias("median"))


def savitzky_golay(y: np.ndarray, window: int, degree: int) -> np.ndarray:
    """Least-squares polynomial smoothing; ends take the fit of the first and last window. A window as long as the curve
    is made shorter, an even one longer by one; curves or windows of less than five points are returned as they are."""
    if len(y) < 5:
        return y.copy()
    window = len(y) - 1 if window >= len(y) else window
    if window < 5:
        return y.copy()
    window += 1 - window % 2
    degree = min(degree, window - 1)
    half = window // 2
    fit = np.linalg.pinv(np.vander(np.arange(-half, half + 1), degree + 1, increasing=True))
    out = np.convolve(y, fit[0][::-1], mode="same")
    for edge, part in ((slice(0, half), y[:window]), (slice(len(y) - half, len(y)), y[-window:])):
        at = np.arange(-half, 0) if edge.start == 0 else np.arange(1, half + 1)
        out[edge] = np.vander(at, degree + 1, increasing=True) @ (fit @ part)
    return out


def peaks(y: np.ndarray, prominence: float | None = None) -> np.ndarray:
    """Local maxima, of a plateau the middle; with ``prominence`` those that stand out by as much.

    A peak stands out by its height over the higher of the lowest points to its left and right, each taken up to the
    next higher value or the end."""
    out, i = [], 1
    while i < len(y) - 1:
        if y[i] > y[i - 1]:
            j = i
            while j + 1 < len(y) and y[j + 1] == y[i]:
                j += 1
            if j + 1 < len(y) and y[j + 1] < y[i]:
                out.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    if prominence is None:
        return np.array(out, int)
    kept = []
    for p in out:
        higher = np.flatnonzero(y > y[p])
        lo, hi = higher[higher < p].max(initial=-1) + 1, higher[higher > p].min(initial=len(y))
        if y[p] - max(y[lo : p + 1].min(), y[p:hi].min()) >= prominence:
            kept.append(p)
    return np.array(kept, int)


def select_elbows(curve: np.ndarray, top_k: int, min_gap: int, by_size: bool = True, prominence: float | None = None) -> list[int]:
    """Peaks by (absolute) curvature, the larger index first in a tie, each at least ``min_gap`` from those taken; none for top_k 0."""
    if top_k < 0 or min_gap < 0:
        raise ValueError("top_k and min_gap are not negative")
    taken: list[int] = []
    for p in sorted(peaks(curve, prominence), key=lambda k: (-abs(curve[k]) if by_size else -curve[k], -k)):
        if len(taken) >= top_k:
            break
        if all(abs(p - q) >= min_gap for q in taken):
            taken.append(int(p))
    return sorted(taken)


TOP_K, MIN_GAP = 3, 6


def elbows_of(s: DataFrame, top_k: int = TOP_K, min_gap: int = MIN_GAP, smoothing: int | None = None, degree: int = 3, prominence: float | None = None) -> DataFrame:
    """(idx, scale) of the elbows of the log spectrum, smoothed over ``smoothing`` values if given; a peak p of the second
    difference is index p + 1."""
    def find(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("idx")
        y = np.log(f.energy.to_numpy() + 1e-12)
        y = savitzky_golay(y, smoothing, degree) if smoothing else y
        at = [p + 1 for p in select_elbows(np.diff(y, 2), top_k, min_gap, prominence=prominence)]
        return pd.DataFrame({"idx": at, "scale": f.scale.to_numpy()[at]})

    # one row for each column of the matrix
    return s.groupBy(F.lit(0).alias("one")).applyInPandas(find, "idx int, scale int")


_ELBOWS = f"""l_ AS (SELECT idx, ln(energy + 1e-12) AS y FROM sp), c_ AS (SELECT idx AS p, lead(y, 2) OVER (ORDER BY idx) - 2 * lead(y) OVER (ORDER BY idx) + y AS c FROM l_),
pk AS (SELECT p, c, row_number() OVER (ORDER BY abs(c) DESC, p DESC) AS k FROM (SELECT p, c, lag(c) OVER (ORDER BY p) AS a, lead(c) OVER (ORDER BY p) AS b FROM c_ WHERE c IS NOT NULL) WHERE c > a AND c > b),
tk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken UNION ALL
  SELECT tk.k + 1, CASE WHEN len(taken) < {TOP_K} AND coalesce(list_min(list_transform(taken, lambda q: abs(q - pk.p))), {MIN_GAP}) >= {MIN_GAP} THEN list_append(taken, CAST(pk.p AS BIGINT)) ELSE taken END FROM tk JOIN pk ON pk.k = tk.k + 1),
el AS (SELECT CAST(unnest(taken) + 1 AS INT) AS idx FROM tk WHERE k = (SELECT max(k) FROM tk))"""


@query("elbows", _S + f", {_ELBOWS} SELECT el.idx, scale FROM el JOIN sp ON el.idx = sp.idx")
def elbows(spark, sf_dir):
    return elbows_of(spectrum(spark, sf_dir))


PROMINENCE = 1e-4
#: Parabolas over seven values, written with orthogonal polynomials; ends take the first and the last window's.
_SMOOTHED = f"""l_ AS (SELECT idx, ln(energy + 1e-12) AS y, count(*) OVER () AS n FROM sp), w_ AS (SELECT idx, least(greatest(idx, 3), n - 4) AS mid, idx - least(greatest(idx, 3), n - 4) AS s FROM l_),
y_ AS (SELECT w_.idx, sum(l_.y * (1 / 7 + s * t / 28 + (s * s - 4) * (t * t - 4) / 84)) AS y FROM w_, (SELECT unnest(range(-3, 4)) AS t), l_ WHERE l_.idx = mid + t GROUP BY w_.idx),
c_ AS (SELECT p, c FROM (SELECT idx AS p, lead(y, 2) OVER (ORDER BY idx) - 2 * lead(y) OVER (ORDER BY idx) + y AS c FROM y_) WHERE c IS NOT NULL),
top_ AS (SELECT p, c FROM (SELECT p, c, lag(c) OVER (ORDER BY p) AS a, lead(c) OVER (ORDER BY p) AS b FROM c_) WHERE c > a AND c > b),
lim_ AS (SELECT t.p, t.c, coalesce(max(q.p) FILTER (WHERE q.p < t.p AND q.c > t.c), -1) AS lo, coalesce(min(q.p) FILTER (WHERE q.p > t.p AND q.c > t.c), (SELECT max(p) + 1 FROM c_)) AS hi FROM top_ t, c_ q GROUP BY t.p, t.c),
out_ AS (SELECT l.p, l.c, l.c - greatest(min(q.c) FILTER (WHERE q.p <= l.p AND q.p > lo), min(q.c) FILTER (WHERE q.p >= l.p AND q.p < hi)) AS prom FROM lim_ l, c_ q GROUP BY l.p, l.c),
pk AS (SELECT p, c, row_number() OVER (ORDER BY abs(c) DESC, p DESC) AS k FROM out_ WHERE prom >= {PROMINENCE}),""" + _ELBOWS[_ELBOWS.index("\ntk AS"):]


@query("smoothed_elbows", _S + f", {_SMOOTHED} SELECT el.idx, scale FROM el JOIN sp ON el.idx = sp.idx")
def smoothed_elbows(spark, sf_dir):
    """Elbows of the log spectrum smoothed by polynomials, those that stand out only."""
    return elbows_of(spectrum(spark, sf_dir), smoothing=7, degree=2, prominence=PROMINENCE)


def candidate_scales(s: DataFrame, feature_dimension: int, thresholds: tuple[float, ...] = (), manual: tuple[int, ...] = (), include_full: bool = False, combine: str = "union", **elbow) -> DataFrame:
    """(scale, sources, is_full_dimension): the whole flow from a spectrum to the scales that any selector chose, with
    the selectors' names. A manual scale, or the full dimension, that a shortened axis does not have is an error."""
    if combine not in ("union", "inflection_only"):
        raise ValueError(f"unknown combination {combine}")
    picks = elbows_of(s, **elbow).select("scale", F.lit("elbow").alias("selector"))
    if combine == "union" and thresholds:
        picks = picks.unionByName(at_thresholds(s, thresholds).select("scale", F.lit("energy").alias("selector")))
    for scales, name in ((manual, "manual"), ((feature_dimension,) if include_full else (), "full_dimension")):
        if scales:
            picks = picks.unionByName(scales_to_indices(s, scales).where("idx >= 0").select("scale", F.lit(name).alias("selector")))
    return picks.groupBy("scale").agg(F.array_join(F.array_sort(F.collect_set("selector")), ";").alias("sources")).withColumn("is_full_dimension", F.col("scale") == feature_dimension)


@query("candidate_scales", _CUM + f""", {_ELBOWS}, t AS (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in THRESHOLDS)}]) AS threshold),
k AS (SELECT threshold, coalesce(min(CASE WHEN cum_energy_ratio >= threshold THEN idx END), max(idx)) AS idx FROM cum, t GROUP BY threshold),
u AS (SELECT scale, 'elbow' AS selector FROM el JOIN sp ON el.idx = sp.idx UNION ALL SELECT scale, 'energy' FROM k JOIN cum ON k.idx = cum.idx UNION ALL SELECT max(scale), 'full_dimension' FROM sp UNION ALL SELECT scale, 'manual' FROM sp WHERE scale IN ({', '.join(map(str, SCALES))}))
SELECT scale, array_to_string(list_sort(list(DISTINCT selector)), ';') AS sources, scale = (SELECT max(scale) FROM sp) AS is_full_dimension FROM u GROUP BY scale""")
def candidate_scales_query(spark, sf_dir):
    """Spectrum, elbows, energy thresholds, manual scales and the full width, united."""
    rows = matrix(spark, sf_dir)
    width = rows.agg(F.max(F.size("features"))).first()[0]
    return candidate_scales(spectrum_of(spark, rows), width or 0, THRESHOLDS, SCALES, True)


@query("scale_union", _threshold_sql(THRESHOLDS).replace("SELECT threshold, CAST(k.idx AS INT) AS idx, scale, round(cum_energy_ratio, 6) AS cumulative_energy FROM k JOIN cum ON k.idx = cum.idx",
    "SELECT scale, array_to_string(list_sort(list(DISTINCT selector)), ';') AS sources, scale = (SELECT max(scale) FROM sp) AS is_full_dimension FROM (SELECT scale, 'energy' AS selector FROM k JOIN cum ON k.idx = cum.idx UNION ALL SELECT max(scale), 'full' FROM sp UNION ALL SELECT scale, 'manual' FROM sp WHERE scale IN (2, 4, 8, 16, 32, 64)) GROUP BY scale"))
def scale_union(spark, sf_dir):
    """Selected scales with the selectors that chose them."""
    s = spectrum(spark, sf_dir)
    top = s.agg(F.max("scale").alias("scale"))
    picks = (at_thresholds(s, THRESHOLDS).select("scale", F.lit("energy").alias("selector"))
             .unionByName(top.select("scale", F.lit("full").alias("selector")))
             .unionByName(s.where(F.col("scale").isin(*SCALES)).select("scale", F.lit("manual").alias("selector"))))
    return picks.groupBy("scale").agg(F.array_join(F.array_sort(F.collect_set("selector")), ";").alias("sources")).join(F.broadcast(top.withColumnRenamed("scale", "top"))).select("scale", "sources", (F.col("scale") == F.col("top")).alias("is_full_dimension"))


@query("scale_index", _threshold_sql(LOW_THRESHOLDS).replace("SELECT threshold, CAST(k.idx AS INT) AS idx, scale, round(cum_energy_ratio, 6) AS cumulative_energy FROM k JOIN cum ON k.idx = cum.idx",
    "SELECT scale, CAST(row_number() OVER (ORDER BY scale) AS INT) AS scale_index FROM (SELECT DISTINCT scale FROM k JOIN cum ON k.idx = cum.idx)"))
def scale_index(spark, sf_dir):
    return at_thresholds(spectrum(spark, sf_dir), LOW_THRESHOLDS).select("scale").distinct().withColumn("scale_index", F.row_number().over(W.orderBy("scale")))


@query("new_scales_disjoint", _threshold_sql(LOW_THRESHOLDS).replace("SELECT threshold, CAST(k.idx AS INT) AS idx, scale, round(cum_energy_ratio, 6) AS cumulative_energy FROM k JOIN cum ON k.idx = cum.idx",
    f"SELECT count(*) AS n_low, count(*) FILTER (WHERE scale IN ({', '.join(map(str, SCALES))})) AS n_shared FROM (SELECT DISTINCT scale FROM k JOIN cum ON k.idx = cum.idx)"))
def new_scales_disjoint(spark, sf_dir):
    """How many widths the low thresholds choose, and how many of them are main widths too: to be new, none may be."""
    low = at_thresholds(spectrum(spark, sf_dir), LOW_THRESHOLDS).select("scale").distinct()
    main = spark.createDataFrame([(k,) for k in SCALES], "scale int").withColumn("shared", F.lit(1))
    return low.join(main, "scale", "left").agg(F.count(F.lit(1)).alias("n_low"), F.count("shared").alias("n_shared"))


# ---- matrices

_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query("prefix_slice", "SELECT vec_id AS row_id, len(embedding[1:8]) AS width, round(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def prefix_slice(spark, sf_dir):
    p = F.slice("features", 1, 8)
    return matrix(spark, sf_dir).select("row_id", F.size(p).cast("long").alias("width"), F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


def l2_normalised(features):
    norm = F.sqrt(F.aggregate(features, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # a one-row lambda binds the norm, which is else added up again for every element
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(features, lambda x: x.cast("double") / (n + 1e-12))), 1)


@query("row_l2", f"SELECT vec_id AS row_id, round({_NORM}, 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / ({_NORM} + 1e-12), 6) AS first FROM embeddings")
def row_l2(spark, sf_dir):
    n = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return matrix(spark, sf_dir).select("row_id", F.round(n, 6).alias("norm"), F.round(F.get(l2_normalised(F.col("features")), F.lit(0)), 6).alias("first"))


@query("column_mean", "SELECT CAST(d - 1 AS INT) AS d, round(avg(CAST(x AS DOUBLE)), 6) + 0.0 AS mean FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY d")
def column_mean(spark, sf_dir):
    return matrix(spark, sf_dir).select(F.posexplode("features").alias("d", "x")).groupBy("d").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(Gram matrix, column sums, rows). A task adds up its rows; the tasks' sums are added for each row of the matrix by
    itself, as whole arrays, so that what comes back is one row for each column."""
    def partial(frames):
        gram = total = None
        n = 0
        for f in frames:
            if len(f):
                x = np.array(f.features.tolist(), float)
                gram = x.T @ x if gram is None else gram + x.T @ x
                total = x.sum(0) if total is None else total + x.sum(0)
                n += len(x)
        if gram is not None:
            yield pd.DataFrame({"i": range(len(gram)), "g": list(gram), "s": total, "n": n})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [f.i.iloc[0]], "g": [np.sum(f.g.tolist(), axis=0)], "s": [f.s.sum()], "n": [f.n.sum()]})

    shape = "i int, g array<double>, s double, n long"
    got = rows.select("features").mapInPandas(partial, shape).groupBy("i").applyInPandas(add, shape).toPandas().sort_values("i")
    if not len(got):
        return np.zeros((0, 0)), np.zeros(0), 0
    return np.array(got.g.tolist()), got.s.to_numpy(), int(got.n.iloc[0])


@query("gram_block", """WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)
SELECT CAST(a.d AS INT) AS i, CAST(b.d AS INT) AS j, round(sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)), 5) + 0.0 AS v FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY ALL""")
def gram_block(spark, sf_dir):
    """The Gram matrix of all columns, over all rows, in long form."""
    gram, _, _ = moments(matrix(spark, sf_dir))
    rows = spark.createDataFrame([(k, g.tolist()) for k, g in enumerate(gram)], "i int, g array<double>")
    return rows.select("i", F.posexplode("g").alias("j", "v")).withColumn("v", F.round("v", 5) + 0.0)


def principal_axes(gram: np.ndarray, total: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axes as columns, variances, mean) of centred rows, largest variance first, each axis's largest entry positive."""
    mean = total / n
    values, axes = np.linalg.eigh(gram - n * np.outer(mean, mean))
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return axes, np.maximum(values, 0) / max(n - 1, 1), mean


def project(rows: DataFrame, axes: np.ndarray, mean: np.ndarray) -> DataFrame:
    """(row_id, scores): centred rows times the axes, in batches; the axes are d x k numbers in the closure."""
    def run(frames):
        for f in frames:
            x = np.array(f.features.tolist(), float).reshape(len(f), -1)
            yield pd.DataFrame({"row_id": f.row_id, "scores": list((x - mean) @ axes) if len(f) else []})

    return rows.select("row_id", "features").mapInPandas(run, "row_id long, scores array<double>")


@query("singular_values", _S + "SELECT idx, round(value, 6) AS singular_value FROM sp")
def singular_values(spark, sf_dir):
    """Singular values of the uncentred matrix, by its Gram matrix."""
    return spectrum(spark, sf_dir).select("idx", F.round("value", 6).alias("singular_value"))


@query("principal_variances", f"WITH RECURSIVE {SPECTRUM_SQL} SELECT idx, round(energy / (SELECT count(*) - 1 FROM embeddings), 6) AS variance, round(energy / sum(energy) OVER (), 6) AS ratio FROM sp".replace(
    "sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)) AS v", "sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)) - sum(CAST(a.v AS DOUBLE)) * sum(CAST(b.v AS DOUBLE)) / count(*) AS v"))
def principal_variances(spark, sf_dir):
    """Variances of the full principal components and their shares."""
    _, values, _ = principal_axes(*moments(matrix(spark, sf_dir)))
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "idx int, variance double")
    return rows.select("idx", F.round("variance", 6).alias("variance"), F.round(F.col("variance") / F.lit(float(values.sum())), 6).alias("ratio"))


@query("full_pca_scores")
def full_pca_scores(spark, sf_dir):
    rows = matrix(spark, sf_dir)
    axes, _, mean = principal_axes(*moments(rows))
    return project(rows, axes, mean)


def range_finder(rows: DataFrame, dim: int, seed: int, oversample: int = 8, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(axes, mean) of a randomised PCA fitted for one width and seed: subspace iteration with the centred Gram matrix."""
    gram, total, n = moments(rows)
    mean = total / n
    c = gram - n * np.outer(mean, mean)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(c), min(len(c), dim + oversample))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(c @ q)[0]
    values, v = np.linalg.eigh(q.T @ c @ q)
    axes = (q @ v)[:, ::-1][:, :dim]
    return axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]), mean


@query("randomized_pca_scores")
def randomized_pca_scores(spark, sf_dir, dim: int = 16, seed: int = 11):
    rows = matrix(spark, sf_dir)
    return project(rows, *range_finder(rows, dim, seed))


def orthogonal_basis(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix: QR of Gaussian numbers, columns signed so that R has a non-negative diagonal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


@query("random_projection_scores")
def random_projection_scores(spark, sf_dir, seed: int = 7):
    rows = matrix(spark, sf_dir)
    _, total, n = moments(rows)
    return project(rows, orthogonal_basis(len(total), seed), total / n)
