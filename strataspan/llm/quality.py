"""Quality classifier: Naive Bayes support vectors.

n-gram indicators are scaled by their classes' log-count ratio, a linear hinge-loss model is fitted to them by dual
coordinate descent, its weights are drawn towards their mean size, and a logistic link calibrated on a fifth of the
sample turns margins into scores. At most ``PER_CLASS`` labelled rows of each class are used to fit.

Defined results: a null or empty text has no feature and gets the score of the bias; without labelled rows of both
classes every score is the share of label 1 (0.5 without any); labels that are null are not used, and of several
labels of one document the largest counts; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.common import held_out, table
from strataspan.llm.features import BITS, Linear, Sample, labelled_sample, platt, split, token_grams, with_score

PER_CLASS, THRESHOLD = 3000, 0.3


def dual_descent(x: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int, seed: int = 3) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + sum c_i hinge(y_i (w.x_i + b)) over indicators times ``scale``; the bias is a feature of one."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(y))
    square = np.array([(scale[i] ** 2).sum() + 1 for i in x])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            at = x[i]
            s = scale[at]
            g = y[i] * (w[at] @ s + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), c[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[at] += d * s
                bias += d
                worst = max(worst, abs(new - alpha[i]) * square[i])
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def fit(sample: Sample, bits: int = BITS, c: float = 1.0, mix: float = 0.25, smooth: float = 1.0, rounds: int = 30) -> Linear:
    y = sample.labels
    if not len(y) or y.min() == y.max():
        p = min(max(sample.prior, 1e-6), 1 - 1e-6)
        return Linear(np.zeros(1 << bits), float(np.log(p / (1 - p))), token_grams, bits=bits)
    train, rest = split(sample)
    size = 1 << bits
    pos, neg = np.full(size, smooth), np.full(size, smooth)
    for i in train:
        (pos if y[i] else neg)[sample.row(i)] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    signs = np.where(y[train] == 1, 1.0, -1.0)
    share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    w, bias = dual_descent([sample.row(i) for i in train], ratio, signs, c * 0.5 / share, rounds)
    w = (1 - mix) * np.abs(w).mean() + mix * w
    weights = w * ratio
    margin = np.array([weights[sample.row(i)].sum() + mix * bias for i in rest])
    return Linear(weights, mix * bias, token_grams, platt(margin, y[rest], sample.prior), bits)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> Linear:
    return fit(labelled_sample(docs, labels, label_col, token_grams, per_class))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
