"""Suffix arrays by induced sorting, written with whole-bucket NumPy steps, and permuted common prefixes.

A symbol's bucket is induced at once: what lies in it names the suffixes one position earlier, a stable split by
their first symbol sends them to their buckets, and suffixes that fall back into the same bucket (runs of one
symbol) form the next wave. Two passes sort the leftmost-smaller substrings, their names form a shorter string that
is sorted in the same way, whatever its size, and two more passes induce the whole array. Names that occur once end
every comparison, so those that follow such a name are left out of the shorter string; and names over a large alphabet
are written as two digits each, so that the bucket steps stay few. What is left after that of deep repeats, a short
string that shrinks little from level to level, is sorted by doubling of ranks.
"""

from __future__ import annotations

import numpy as np

from strataspan.llm.kernels import prefix_hash, span_hash

#: Alphabets beyond this are written as two digits; shortened strings up to RESIDUE symbols are sorted by doubling.
DENSE_SYMBOLS = 1024
RESIDUE = 1 << 17


def classify(t: np.ndarray) -> np.ndarray:
    """True for smaller-type suffixes: those below the suffix that starts one position later."""
    n = len(t)
    up = np.zeros(n, bool)
    up[-1] = True
    if n == 1:
        return up
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    up[:-1] = np.append(step, 1)[nxt] > 0
    return up


def _deal(sa: np.ndarray, fill: np.ndarray, sym: np.ndarray, pos: np.ndarray, down: bool) -> None:
    """Append positions to the buckets of their symbols, keeping the order; fill moves up, or down."""
    if len(sym) == 1:
        s = sym[0]
        fill[s] -= down
        sa[fill[s]] = pos[0]
        fill[s] += not down
        return
    order = np.argsort(sym, kind="stable")
    ss = sym[order]
    cut = np.flatnonzero(ss[1:] != ss[:-1]) + 1
    begin = np.concatenate(([0], cut))
    count = np.diff(np.append(begin, len(ss)))
    keys = ss[begin]
    rank = np.arange(len(ss)) - np.repeat(begin, count)
    if down:
        sa[np.repeat(fill[keys], count) - 1 - rank] = pos[order]
        fill[keys] -= count
    else:
        sa[np.repeat(fill[keys], count) + rank] = pos[order]
        fill[keys] += count


def _induce(t: np.ndarray, up: np.ndarray, lms: np.ndarray, head: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes induced from the order of the leftmost-smaller ones."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    prev_up = np.empty(n, bool)
    prev_up[0] = True
    prev_up[1:] = up[:-1]
    prev_sym = np.empty(n, t.dtype)
    prev_sym[0] = t[0]
    prev_sym[1:] = t[:-1]
    counts_l = np.bincount(t[~up], minlength=len(head) - 1)
    fill = head[:-1].copy()
    of = t[lms]
    first = np.searchsorted(of, symbols, side="left")
    last = np.searchsorted(of, symbols, side="right")
    for k, c in enumerate(symbols):
        at = head[c]
        while True:  # larger-type suffixes of this bucket, wave by wave
            upto = fill[c]
            if at == upto:
                break
            p = sa[at:upto]
            at = upto
            p = p[~prev_up[p]]
            if len(p):
                _deal(sa, fill, prev_sym[p], p - 1, False)
        if last[k] > first[k]:
            p = lms[first[k] : last[k]]
            p = p[~prev_up[p]]
            if len(p):
                _deal(sa, fill, prev_sym[p], p - 1, False)
    fill = head[1:].copy()
    for c in symbols[::-1]:
        at = head[c + 1]
        while True:  # smaller-type suffixes of this bucket, wave by wave from its end
            downto = fill[c]
            if at == downto:
                break
            p = sa[downto:at][::-1]
            at = downto
            p = p[prev_up[p] & (p > 0)]
            if len(p):
                _deal(sa, fill, prev_sym[p], p - 1, True)
        upto = head[c] + counts_l[c]
        if upto > head[c]:
            p = sa[head[c] : upto][::-1]
            p = p[prev_up[p] & (p > 0)]
            if len(p):
                _deal(sa, fill, prev_sym[p], p - 1, True)
        elif c == symbols[0] and fill[c] == head[c + 1]:
            sa[head[c]] = n - 1
    return sa


def _doubling(t: np.ndarray) -> np.ndarray:
    """Suffix order by doubling of ranks; groups that are settled are left alone."""
    n = len(t)
    sa = np.argsort(t, kind="stable").astype(np.int64)
    ts = t[sa]
    begin = np.concatenate(([True], ts[1:] != ts[:-1]))
    group = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    h = 1
    while True:
        size = np.diff(np.append(np.flatnonzero(begin), n))
        loose = np.flatnonzero(np.repeat(size > 1, size))
        if not len(loose):
            return sa.astype(np.int32)
        p = sa[loose]
        second = np.where(p + h < n, rank[np.minimum(p + h, n - 1)], -1)
        g = group[loose]
        order = np.argsort(g * (n + 1) + second + 1, kind="stable")
        sa[loose] = p[order]
        second = second[order]
        fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (second[1:] != second[:-1])))
        begin[loose] = fresh
        group[loose] = np.maximum.accumulate(np.where(fresh, loose, 0))
        rank[sa[loose]] = group[loose]
        h *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Sorted suffix positions (int32) of non-negative integers whose last symbol is the one smallest symbol."""
    n = len(t)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    width = int(t.max()) + 1
    counts = np.bincount(t, minlength=width)
    symbols = np.flatnonzero(counts)
    head = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    up = classify(t)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if not up[:-1].any():  # every suffix is larger than the one after it
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    lms = lms.astype(np.int32)
    sa = _induce(t, up, lms[np.argsort(t[lms], kind="stable")], head, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    stop = np.empty(n, np.int64)
    stop[lms] = np.append(lms[1:] + 1, n)
    value = span_hash(prefix_hash(t.astype(np.uint64) + np.uint64(1)), ordered.astype(np.int64), stop[ordered])
    name = np.empty(n, np.int32)
    name[ordered] = np.cumsum(np.concatenate(([0], value[1:] != value[:-1])))
    short = name[lms]
    distinct = int(name[ordered[-1]]) + 1
    if distinct == len(short):
        return _induce(t, up, ordered, head, symbols)
    return _induce(t, up, lms[_order_of_names(short, distinct)], head, symbols)


def _order_of_names(short: np.ndarray, distinct: int) -> np.ndarray:
    """The suffix order of the shortened string of names 0 to ``distinct`` - 1."""
    times = np.bincount(short, minlength=distinct)
    once = times[short] == 1
    # no comparison goes on behind a name that occurs once
    keep = ~once
    keep[1:] |= ~once[:-1]
    keep[-1] = True
    kept = np.flatnonzero(keep)
    names = short[kept]
    present = np.zeros(distinct, np.int32)
    present[names] = 1
    names = (np.cumsum(present, dtype=np.int32) - 1)[names]
    if len(names) <= RESIDUE:
        inner = _doubling(names)
    elif names.max() < DENSE_SYMBOLS:
        inner = suffix_array(names.astype(np.int16))  # short symbols are sorted by radix
    else:
        base = int(np.sqrt(names.max())) + 1
        digits = np.empty(2 * len(names) - 1, np.int16)
        digits[0:-1:2] = names[:-1] // base + 1
        digits[1:-1:2] = names[:-1] % base + 1
        digits[-1] = 0  # the one smallest symbol stays one, at the end
        inner = suffix_array(digits)
        inner = inner[inner % 2 == 0] // 2
    # kept suffixes in their order, the others where their names put them
    before = np.cumsum(times) - times
    out = np.empty(len(short), np.int32)
    alone = np.flatnonzero(~keep)
    out[before[short[alone]]] = alone
    order = kept[inner]
    of = short[order]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    out[before[of] + np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))] = order
    return out


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each position, the symbols its suffix shares with the suffix sorted before it.

    A value whose left neighbours agree follows from the one a position earlier; only the others are compared.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    pos = np.arange(n)
    fresh = np.ones(n, bool)
    ok = (pos > 0) & (before > 0)
    fresh[ok] = t[pos[ok] - 1] != t[before[ok] - 1]
    i = np.flatnonzero(fresh & (before >= 0))
    j = before[i]
    got = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    wide = 1
    while len(live):
        a, b = i[live] + got[live], j[live] + got[live]
        same = np.ones(len(live), np.int64) * 0
        going = np.ones(len(live), bool)
        for _ in range(wide):
            going &= (a < n) & (b < n)
            going &= t[np.minimum(a, n - 1)] == t[np.minimum(b, n - 1)]
            same += going
            a += 1
            b += 1
            if not going.any():
                break
        got[live] += same
        live = live[going]
        wide = 8 if wide == 1 else min(64, wide * 2)
    base = np.zeros(n, np.int64)
    base[i] = got
    last = np.maximum.accumulate(np.where(fresh, pos, 0))
    return np.maximum(base[last] - (pos - last), 0)
