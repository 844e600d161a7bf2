"""Orthographic distance of strings, batched over pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def distances(xs: list[str], ys: list[str]) -> np.ndarray:
    """Normalised edit distance of case-folded strings with a positional two-character substitution cost.

    Insertion and deletion cost one. A substitution at the first position of either string costs 0 or 1 by the
    characters; later it costs half the number of differences over the two positions that end there. The sum is divided
    by the longer length; two empty strings are at distance 0. All pairs of a batch take their steps together.
    """
    return _measure(*_codes(xs), *_codes(ys))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of each case-folded string in a row, lengths)."""
    folded = [x.casefold() for x in texts]
    size = np.array([len(x) for x in folded], np.int64)
    out = np.zeros((len(folded), int(size.max(initial=0))), np.int32)
    for i, x in enumerate(folded):
        out[i, : len(x)] = [ord(c) for c in x]
    return out, size


def _measure(ca: np.ndarray, la: np.ndarray, cb: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n, wa, wb = len(la), int(la.max(initial=0)), int(lb.max(initial=0))
    # a row for each position, a column for each pair: a step works on memory that lies together
    ca, cb = np.ascontiguousarray(ca[:, :wa].T), np.ascontiguousarray(cb[:, :wb].T)
    # twice the costs, which are whole numbers
    kind = np.int16 if wa + wb < 1 << 13 else np.int64
    out = np.zeros(n)
    row = np.repeat(2 * np.arange(wb + 1, dtype=kind)[:, None], n, axis=1)
    at = np.arange(n)
    done = la == 0
    out[done] = 2 * lb[done]
    before = None
    for i in range(1, wa + 1):
        new = np.empty_like(row)
        new[0] = 2 * i
        miss = (cb != ca[i - 1]).astype(kind)
        cost = 2 * miss
        if before is not None:
            cost[1:] = miss[1:] + before[:-1]
        before = miss
        np.minimum(row[1:] + kind(2), row[:-1] + cost, out=new[1:])
        for j in range(1, wb + 1):
            np.minimum(new[j], new[j - 1] + kind(2), out=new[j])
        row = new
        done = la == i
        out[done] = row[lb[done], at[done]]
    return out / 2 / np.maximum(np.maximum(la, lb), 1)


def ndist(x: Column | str, y: Column | str) -> Column:
    """Distance of two string columns, measured in Arrow batches; a null counts as empty."""

    @F.pandas_udf("double")
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(distances(a.fillna("").tolist(), b.fillna("").tolist()))

    return batch(x, y)


def mean_similarity(tokens: list[str], block: int = 4096) -> float:
    """Mean of 1 - distance over all unordered pairs."""
    codes, size = _codes(sorted(tokens))
    i, j = np.triu_indices(len(size), 1)
    # pairs of similar lengths take their steps together
    order = np.lexsort((size[j], size[i]))
    i, j = i[order], j[order]
    total = 0.0
    for lo in range(0, len(i), block):
        a, b = i[lo : lo + block], j[lo : lo + block]
        total += float((1 - _measure(codes[a], size[a], codes[b], size[b])).sum())
    return total / len(i)
