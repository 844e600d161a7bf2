"""Toxicity: a logistic classifier with counterfactual pairing.

In labelled sentences identity terms (of English, French, German and Spanish; the groups are a parameter) are swapped
for others of their group, and the squared change of a sentence's logit is penalised beside the log loss, so that a
neutral mention of a group moves the score little. A corpus that mentions no group makes no pairs, and then the model
is the logistic one. Features are hashed
words and word beginnings, scaled by the classes' log-count ratio; only those that ``MIN_ROWS`` rows of the sample have carry weight. At most ``PER_CLASS``
labelled rows of each class are used to fit, and a fifth of them calibrates the scores.

Defined results: a null or empty text has no feature and gets the score of the bias; without labelled rows of both
classes every score is the share of label 1 (0.5 without any); labels that are null are not used, and of several
labels of one document the largest counts; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.common import held_out, table
from strataspan.llm.features import BITS, Linear, Sample, labelled_sample, platt, split, with_score, word_parts

PER_CLASS, MIN_ROWS, THRESHOLD = 3000, 4, 0.5
#: Terms that may stand for one another.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "homosexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european"), ("immigrants", "natives", "refugees"), ("immigrant", "native", "refugee"),
    ("old", "young"), ("blind", "deaf", "disabled"), ("american", "mexican", "chinese", "indian", "russian", "french", "german", "spanish"),
    ("femmes", "hommes", "filles", "garçons"), ("femme", "homme", "fille", "garçon"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"), ("chrétien", "musulman", "juif", "hindou", "bouddhiste"),
    ("immigrés", "réfugiés", "étrangers"), ("noirs", "blancs", "asiatiques", "arabes"), ("homosexuels", "hétérosexuels"),
    ("frauen", "männer", "mädchen", "jungen"), ("frau", "mann"), ("christen", "muslime", "juden", "hindus", "buddhisten"), ("einwanderer", "flüchtlinge", "ausländer"), ("schwule", "lesben"),
    ("mujeres", "hombres", "chicas", "chicos"), ("mujer", "hombre", "chica", "chico"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"), ("inmigrantes", "refugiados", "extranjeros"), ("negros", "blancos", "asiáticos", "latinos"),
)
_SENTENCE = re.compile(r"[^.!?\n]+")


class Swap:
    """(sentence, counterfactual) of the sentences of a text that name a group: each term replaced by another of its
    group, chosen by the sentence alone."""

    def __init__(self, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS):
        self.group: dict[str, tuple[str, ...]] = {}
        for group in groups:
            for term in group:
                self.group.setdefault(term, group)
        self.terms = re.compile(r"\b(" + "|".join(sorted(self.group, key=len, reverse=True)) + r")\b", re.I) if self.group else None

    def __call__(self, text: str) -> list[tuple[str, str]]:
        if self.terms is None or not self.terms.search(text):
            return []
        out = []
        for sentence in _SENTENCE.findall(text):
            turn = zlib.crc32(sentence.encode())

            def other(m: re.Match) -> str:
                rest = [t for t in self.group[m[1].lower()] if t != m[1].lower()]
                return rest[turn % len(rest)]  # noqa: B023

            changed = self.terms.sub(other, sentence)
            if changed != sentence:
                out.append((sentence, changed))
        return out


def fit(sample: Sample, bits: int = BITS, ridge: float = 2e-4, pairing: float = 1.0, rounds: int = 200, min_rows: int = MIN_ROWS, smooth: float = 1.0) -> Linear:
    y = sample.labels
    if not len(y) or y.min() == y.max():
        p = min(max(sample.prior, 1e-6), 1 - 1e-6)
        return Linear(np.zeros(1 << bits), float(np.log(p / (1 - p))), word_parts, bits=bits)
    train, rest = split(sample)
    pos, neg = np.full(1 << bits, smooth), np.full(1 << bits, smooth)
    for i in train:
        (pos if y[i] else neg)[sample.row(i)] += 1
    used = np.flatnonzero(pos + neg - 2 * smooth >= min_rows)
    scale = np.log(pos[used] / (y[train].sum() + smooth)) - np.log(neg[used] / ((1 - y[train]).sum() + smooth))
    new = np.full(1 << bits, -1)
    new[used] = np.arange(len(used))

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept = [k[k >= 0] for k in (new[r] for r in rows)]
        at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(rows)), [len(k) for k in kept]), at, scale[at]

    r, c, v = matrix([sample.row(i) for i in train])
    pairs = [p for i in train for p in sample.pairs[i]]
    pr, pc, pv = matrix([a for a, _ in pairs])
    qr, qc, qv = matrix([b for _, b in pairs])
    t, n, k = y[train], len(train), len(used)
    weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean())) / n
    w, b = np.zeros(k), 0.0
    m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(r, w[c] * v, minlength=n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        d = weight * (p - t)
        g = np.bincount(c, d[r] * v, minlength=k) + ridge * w
        if len(pairs):
            gap = (np.bincount(pr, w[pc] * pv, minlength=len(pairs)) - np.bincount(qr, w[qc] * qv, minlength=len(pairs))) * (2 * pairing / len(pairs))
            g += np.bincount(pc, gap[pr] * pv, minlength=k) - np.bincount(qc, gap[qr] * qv, minlength=k)
        g = np.append(g, d.sum())
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    weights = np.zeros(1 << bits)
    weights[used] = w * scale
    margin = np.array([weights[sample.row(i)].sum() + b for i in rest])
    return Linear(weights, b, word_parts, platt(margin, y[rest], sample.prior), bits)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, **options) -> Linear:
    return fit(labelled_sample(docs, labels, label_col, word_parts, per_class, swap=Swap(groups)), **options)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
