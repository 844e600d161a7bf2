"""NumPy helpers that run inside Arrow tasks: byte buffers of string columns, rolling hashes and word spans.

All of them work on blocks of a few megabytes, so the memory of a task does not depend on the partition size;
a text longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_M = 0x9E3779B97F4A7C15
_M_INV = pow(_M, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those for a block are kept, longer ones only made."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, min(BLOCK_BYTES + 1, max(1 << 12, 2 * (0 if have is None else len(have))))), np.uint64)
        have[0] = 1
        have[1:] = np.uint64(base)
        np.cumprod(have, out=have)
        if n <= BLOCK_BYTES + 1:
            _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] the polynomial of values[i:j]; see :func:`span_hash`."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(_M, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal contents wherever they lie."""
    h = (prefix[ends] - prefix[starts]) * powers(_M_INV, len(prefix))[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix64(h)


_BELOW = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
#: Spans of more bytes are hashed by BLAKE2b.
_LONG_SPAN = 256


def span_mix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of short spans, eight bytes at a time; equal for equal contents wherever they lie.

    Unlike :func:`span_hash` it needs nothing of the size of the text, and no family of texts is known to collide."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    at8 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * np.uint64(_M)
    live, at = np.arange(len(starts)), starts
    for i in np.flatnonzero(left > _LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    if len(left) and left.max() > _LONG_SPAN:
        live = np.flatnonzero(left <= _LONG_SPAN)
        at, left = starts[live], left[live]
    while len(live):
        x = at8[at]
        tail = left < 8
        x[tail] &= _BELOW[left[tail]]
        h[live] = mix64(h[live] ^ x)
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def word_table(extra: bytes = b"") -> np.ndarray:
    """Byte -> folded byte of a word, 0 for a separator: digits, letters (A-Z lower-cased) and bytes over 127."""
    lut = np.zeros(256, np.uint8)
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz" + extra:
        lut[c] = c
    for c in range(26):
        lut[65 + c] = 97 + c
    lut[128:] = np.arange(128, 256, dtype=np.uint8)
    return lut


WORD_LUT = word_table()


def word_spans(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of nonzero bytes, which never cross from one row into the next."""
    n = len(folded)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    on = folded != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = on.copy()
    starts[1:] &= ~on[:-1] | edge[1:-1]
    ends = on.copy()
    ends[:-1] &= ~on[1:] | edge[1:-1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lut: np.ndarray = WORD_LUT):
    """(hashes, row, starts, ends) of the words of a block."""
    folded = lut[raw]
    s, e, row = word_spans(folded, offsets)
    return span_mix(folded, s, e), row, s, e


def gram_hashes(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words inside a row, and their rows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h += words[j : j + n]
        h ^= h >> np.uint64(31)
    keep = row[:n] == row[k - 1 :]
    return mix64(h[keep]), row[:n][keep]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, concatenated."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
