"""Hashed indicator features of texts, a linear scorer over them, and bounded training samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.llm.common import bounded, held_out
from strataspan.llm.kernels import WORD_LUT, blocks, mix64, prefix_hash, span_hash, utf8, word_spans

BITS = 18
_SPACE, _WORD, _MARK = 0, 1, 2
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = _WORD
_CLASS[[*range(9, 14), 32]] = _SPACE


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    return mix64(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def token_grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) of tokens, of neighbouring pairs, and of a sign that a token follows itself.

    Tokens are runs of word bytes, with their case, or of marks."""
    kind = _CLASS[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    cut = edge[:-1].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(raw))
    keep = kind[begin] != _SPACE
    begin, end = begin[keep], end[keep]
    row = np.searchsorted(offsets, begin, side="right") - 1
    h = span_hash(prefix_hash(raw), begin, end)
    same = row[1:] == row[:-1]
    pair = _salted(h[:-1] * np.uint64(31) + h[1:], 2)[same]
    again = row[:-1][same & (h[1:] == h[:-1])]
    return np.concatenate((row, row[:-1][same], again)), np.concatenate((h, pair, np.full(len(again), _salted(np.zeros(1, np.uint64), 3)[0])))


def word_parts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) of lower-cased words and of their beginnings of 4, 5 and 6 bytes."""
    folded = WORD_LUT[raw]
    s, e, row = word_spans(folded, offsets)
    p = prefix_hash(folded)
    rows, out = [row], [span_hash(p, s, e)]
    for k in (4, 5, 6):
        long = e - s >= k
        rows.append(row[long])
        out.append(_salted(span_hash(p, s[long], s[long] + k), k))
    return np.concatenate(rows), np.concatenate(out)


def buckets(raw: np.ndarray, offsets: np.ndarray, grams: Callable, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs, sorted."""
    rows, h = grams(raw, offsets)
    key = np.unique((rows.astype(np.int64) << bits) | (h >> np.uint64(64 - bits)).astype(np.int64))
    return key >> bits, key & ((1 << bits) - 1)


class Linear:
    """score = 1 / (1 + exp(-(a * margin + b))), margin = sum of the weights of a text's features + bias."""

    def __init__(self, weights: np.ndarray, bias: float, grams: Callable, scale: tuple[float, float] = (1.0, 0.0), bits: int = BITS):
        self.w, self.bias, self.grams, self.scale, self.bits = weights.astype(np.float32), bias, grams, scale, bits

    def margins(self, column: pa.Array) -> np.ndarray:
        raw, offsets = utf8(column)
        out = np.full(len(offsets) - 1, self.bias, float)
        for lo, hi in blocks(offsets):
            part, off = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            if len(part):
                rows, at = buckets(part, off, self.grams, self.bits)
                out[lo:hi] += np.bincount(rows, self.w[at], minlength=hi - lo)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.margins(column) + self.scale[1], -500, 500)))


def with_score(docs: DataFrame, model: Linear, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, which replaces a column of its name; no shuffle."""
    carried = [c for c in docs.columns if c != out_col]
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(out_col, T.DoubleType())])

    def run(batches):
        for b in batches:
            text = b.column(b.schema.get_field_index(text_col))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in carried] + [pa.array(model.scores(text), pa.float64())], names=carried + [out_col])

    return bounded(docs).mapInArrow(run, schema)


class Sample:
    """Sparse indicators of a bounded sample: row pointers and buckets, labels, and for each row the pairs of features
    of its sentences and their counterfactuals."""

    def __init__(self, features: list[np.ndarray], labels: np.ndarray, pairs: list[list[tuple[np.ndarray, np.ndarray]]], prior: float):
        self.labels, self.prior, self.pairs = labels, prior, pairs
        self.lengths = np.array([len(x) for x in features], np.int64)
        self.ptr = np.concatenate(([0], np.cumsum(self.lengths)))
        self.idx = np.concatenate(features) if features else np.zeros(0, np.int64)

    def __len__(self):
        return len(self.labels)

    def row(self, i: int) -> np.ndarray:
        return self.idx[self.ptr[i] : self.ptr[i + 1]]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, grams: Callable, per_class: int, bits: int = BITS, swap: Callable[[str], list[tuple[str, str]]] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> Sample:
    """At most ``per_class`` rows of each class outside the held-out fifth, by a hash of the id, as hashed features.

    ``prior`` counts all labelled rows outside that fifth. ``swap`` gives the sentences of a text that have a
    counterfactual, with it.
    """
    pool = labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in pool.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    picked = None
    for y in counts:
        part = pool.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return Sample([], np.zeros(0), [], 0.5)
    # the sample's ids are bounded by per_class, and so is what comes back
    chosen = bounded(docs).select(id_col, text_col).join(F.broadcast(picked), id_col).select("y", text_col)

    def run(batches):
        for b in batches:
            raw, offsets = utf8(b.column(1))
            ys = b.column(0).to_pylist()
            for i, y in enumerate(ys):
                piece = raw[offsets[i] : offsets[i + 1]]
                one = lambda x: buckets(x, np.array([0, len(x)]), grams, bits)[1].astype(np.int32) if len(x) else np.zeros(0, np.int32)
                pairs = [one(np.frombuffer(t.encode(), np.uint8)) for pair in (swap(piece.tobytes().decode()) if swap else []) for t in pair]
                yield pa.RecordBatch.from_pydict({"y": [y], "x": [one(piece)], "o": [pairs]}, pa.schema([("y", pa.int32()), ("x", pa.list_(pa.int32())), ("o", pa.list_(pa.list_(pa.int32())))]))

    got = chosen.mapInArrow(run, "y int, x array<int>, o array<array<int>>").toArrow()
    # the order of arrival may differ between runs; sort by the features themselves
    numbers = lambda x: np.array(x, np.int64)
    pairs = ([(numbers(a), numbers(b)) for a, b in zip(o[::2], o[1::2])] for o in got["o"].to_pylist())
    rows = sorted(zip(got["y"].to_pylist(), map(numbers, got["x"].to_pylist()), pairs), key=lambda r: (len(r[1]), r[0], r[1].tobytes()))
    return Sample([r[1] for r in rows], np.array([r[0] for r in rows], float), [r[2] for r in rows], counts.get(1, 0) / total)


def platt(margin: np.ndarray, y: np.ndarray, prior: float, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of the logistic link, each class weighted to its share of all labelled rows; a slight ridge on a."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    size = margin.std() or 1.0
    m, a, b = margin / size, 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -50, 50)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * m).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a / size, b


def split(sample: Sample, fifth: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers to fit on and to calibrate on."""
    order = np.random.default_rng(7).permutation(len(sample))
    cut = len(order) // fifth
    return order[cut:], order[:cut]
