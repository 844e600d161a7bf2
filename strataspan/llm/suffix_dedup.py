"""Suffix-array dedup: bytes covered by a string of ``window`` bytes that also starts earlier are removed.

1. Texts go, compressed, to buckets of about ``BUCKET_BYTES`` by a hash of their id and text (the only time they are
   shuffled). In every window of a text one run of ``KGRAM`` bytes, that with the least hash, is its anchor; equal
   windows have equal anchors at equal places. The windows of one anchor on one side of it are a piece. All windows of
   a piece share a core of more than half a window, and the piece is keyed by its core: equal windows have equal keys.
2. Each bucket sends its distinct keys, with counts, to ranges of the key space. Keys that occur twice or more go back.
   Other pieces cannot hold a repeated window.
3. A bucket's pieces with repeated keys, equal ones once with their earliest start, go to shards by key. A key with
   more than ``HOT`` pieces is cut into single windows keyed by the whole window, so no shard collects the different
   surroundings of one common passage.
4. A shard keeps equal pieces once and builds a suffix array over them: suffixes are classified, leftmost-smaller
   substrings sorted recursively, the rest induced. Permuted common prefixes give the runs of suffixes that share
   ``window`` bytes; all windows of a run but the earliest are repeats.
5. The repeated windows go back to the buckets, are united to spans, and the spans' bytes are removed.

A group is always a bucket, a range or a shard: a key contributes one entry for each bucket, however often it occurs.

Windows never cross documents; "earlier" means a smaller id, or the same document and an earlier start, judged on the
input. Defined results: a null or empty text has no bytes and no span; texts shorter than the window keep all bytes;
of equal texts that with the smallest id stays; rows that share an id but not the text are documents of their own,
ordered by a hash of the text; rows equal in both are judged as one document and get equal results; a null id comes
before all others; an empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.common import bounded, parts, table
from strataspan.llm.kernels import _M_INV, blocks, mix64, powers, prefix_hash, ranges, span_hash, utf8
from strataspan.llm.suffixes import common_prefixes, suffix_array

WINDOW, KGRAM = 100, 16
#: Text bytes of a bucket; pieces of one key that make it hot; bytes of a suffix array.
BUCKET_BYTES, HOT, SHARD_BYTES = 8 << 20, 1024, 4 << 20
_KEY_BITS = np.uint64(16)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def cut_pieces(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW, k: int = KGRAM) -> tuple[np.ndarray, ...]:
    """(row, first window's start in the row, number of windows, key) of all pieces of a block."""
    n, room = len(raw), window - k + 1
    half = room // 2
    size = np.diff(offsets)
    rows = np.flatnonzero(size >= window)
    if not len(rows):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    p = prefix_hash(raw)
    g = (p[k:] - p[:-k]) * powers(_M_INV, n)[: n - k + 1]
    g = mix64(g)
    g &= np.uint64(0xFFFFFFFF00000000)
    g |= np.arange(len(g), dtype=np.uint64)
    anchor = (sliding_min(g, room) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    del g
    # windows inside rows; the first of each row begins a piece
    valid = np.zeros(n - window + 2, np.int8)
    np.add.at(valid, offsets[rows], 1)
    np.add.at(valid, offsets[rows] + size[rows] - window + 1, -1)
    inside = np.cumsum(valid[:-1], dtype=np.int8) > 0
    left = anchor - np.arange(len(anchor)) > half
    cut = np.ones(len(anchor), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1])
    cut[offsets[rows]] = True
    end = np.flatnonzero(np.append(cut[1:] | (inside[1:] != inside[:-1]), True) & inside) + 1
    cut[1:] |= inside[1:] != inside[:-1]
    s = np.flatnonzero(cut & inside)
    a, side = anchor[s], left[s]
    lo = np.where(side, a - half - 1, a)
    hi = np.where(side, a + k, a - half + window)
    key = span_hash(p, lo, hi)
    row = np.searchsorted(offsets, s, side="right") - 1
    return row, s - offsets[row], end - s, mix64(key + side.astype(np.uint64))


_ZSTD = pa.Codec("zstd", 1)


def pack_bytes(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    body = b"".join(x.tobytes() for x in arrays)
    head = ";".join(f"{x.dtype.str},{len(x)}" for x in arrays).encode()
    return struct.pack("<IQ", len(head), len(body)) + head + _ZSTD.compress(body, asbytes=True)


def unpack_bytes(data: bytes) -> list[np.ndarray]:
    n, size = struct.unpack_from("<IQ", data)
    body, at, out = _ZSTD.decompress(data[12 + n :], size, asbytes=True), 0, []
    for kind, count in (x.split(",") for x in data[12 : 12 + n].decode().split(";")):
        out.append(np.frombuffer(body, kind, int(count), at))
        at += out[-1].nbytes
    return out


def _texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, hashes, bytes, offsets) of a bucket, ordered by id and hash; of equal rows the first only."""
    ids = t.column("id").to_numpy(zero_copy_only=False)
    uids = t.column("uid").to_numpy(zero_copy_only=False)
    order = np.lexsort((uids, ids))
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[order][1:] != ids[order][:-1]) | (uids[order][1:] != uids[order][:-1])
    order = order[keep]
    codec = pa.Codec("zstd")
    z, n = t.column("z"), t.column("n").to_numpy(zero_copy_only=False)
    raw = [codec.decompress(z[int(i)].as_buffer(), int(n[i])) if n[i] else b"" for i in order]
    size = n[order].astype(np.int64)
    return ids[order], uids[order], np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(size)))


def _pieces(raw: np.ndarray, offsets: np.ndarray, window: int):
    """cut_pieces over the blocks of a bucket: (block's bytes, block's offsets, first row, row, start, count, key)."""
    for lo, hi in blocks(offsets):
        part, off = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield part, off, lo, *cut_pieces(part, off, window)


def _deal(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of the key space, of n, that a 48-bit key lies in."""
    return ((keys >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _send_keys(window: int, n: int):
    def run(t: pa.Table) -> pa.Table:
        _, _, raw, offsets = _texts(t)
        keys = [np.zeros(0, np.uint64)] + [x[-1] >> _KEY_BITS for x in _pieces(raw, offsets, window)]
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        cuts = np.searchsorted(_deal(key, n), np.arange(n + 1))
        to, blob = [], []
        for r in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[r], cuts[r + 1])
            to.append(int(r))
            blob.append(pack_bytes(np.diff(key[own], prepend=np.uint64(0)), np.minimum(count[own], 65535).astype(np.uint16)))
        b = t.column("bucket")[0].as_py() if t.num_rows else 0
        return pa.table({"to": pa.array(to, pa.int64()), "bucket": pa.array([b] * len(to), pa.int64()), "blob": pa.array(blob, pa.binary())})

    return run


def _repeated(hot: int):
    def run(t: pa.Table) -> pa.Table:
        """Of the keys that buckets sent, those found twice, to each bucket that has them."""
        sent = [unpack_bytes(x.as_py()) for x in t.column("blob")]
        keys = [np.cumsum(s, dtype=np.uint64) for s, _ in sent]
        every = np.concatenate(keys)
        who = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(every, kind="stable")
        k, w = every[order], who[order]
        c = np.concatenate([c for _, c in sent]).astype(np.int64)[order]
        begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        total = np.add.reduceat(c, begin)
        total = np.repeat(total, np.diff(np.append(begin, len(k))))
        good = np.flatnonzero(total > 1)
        by = good[np.argsort(w[good], kind="stable")]
        cuts = np.searchsorted(w[by], np.arange(len(keys) + 1))
        buckets, to, blob = t.column("bucket").to_pylist(), [], []
        for i in np.flatnonzero(np.diff(cuts)):
            own = by[cuts[i] : cuts[i + 1]]
            to.append(buckets[i])
            blob.append(pack_bytes(np.diff(k[own], prepend=np.uint64(0)), total[own] > hot))
        return pa.table({"bucket": pa.array(to, pa.int64()), "blob": pa.array(blob, pa.binary())})

    return run


def _send_pieces(window: int, n: int):
    def run(t: pa.Table, back: pa.Table) -> pa.Table:
        """Pieces with repeated keys, equal ones once: to shards; the starts of a bucket's own copies: to the bucket."""
        none = pa.table({"to": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "own": pa.array([], pa.bool_()), "blob": pa.array([], pa.binary())})
        if not t.num_rows or not back.num_rows:
            return none
        got = [unpack_bytes(x.as_py()) for x in back.column("blob")]
        known = np.concatenate([np.cumsum(s, dtype=np.uint64) for s, _ in got])
        hot = np.concatenate([h for _, h in got])
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        ids, uids, raw, offsets = _texts(t)
        found = []
        for part, off, lo, row, start, count, key in _pieces(raw, offsets, window):
            k = key >> _KEY_BITS
            at = np.minimum(np.searchsorted(known, k), len(known) - 1)
            hit = np.flatnonzero(known[at] == k)
            common = hot[at[hit]]
            row, start, count, key = row[hit], start[hit], count[hit], key[hit]
            if common.any():  # single windows, keyed by their bytes
                r1, s1 = np.repeat(row[common], count[common]), ranges(start[common], count[common])
                a = off[r1] + s1
                k1 = span_hash(prefix_hash(part), a, a + window)
                row, start = np.concatenate((row[~common], r1)), np.concatenate((start[~common], s1))
                count, key = np.concatenate((count[~common], np.ones(len(s1), np.int64))), np.concatenate((key[~common], k1))
            a = off[row] + start
            found.append((row + lo, start, count, key, span_hash(prefix_hash(part), a, a + count + window - 1)))
        row, start, count, key, content = (np.concatenate(x) for x in zip(*found))
        if not len(row):
            return none
        # rows are in the order of (id, hash), so the first of equal pieces is the earliest
        order = np.lexsort((start, row, content, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        again, first = order[~new], order[new]
        shard = _deal(key[first] >> _KEY_BITS, n)
        cuts = np.searchsorted(shard, np.arange(n + 1))
        bucket = t.column("bucket")[0].as_py()
        to, own, blob = [], [], []
        for s in np.flatnonzero(np.diff(cuts)):
            f = first[cuts[s] : cuts[s + 1]]
            a = offsets[row[f]] + start[f]
            text = raw[ranges(a, count[f] + window - 1)]
            to.append(int(s))
            own.append(False)
            blob.append(pack_bytes(ids[row[f]], uids[row[f]], start[f].astype(np.int64), count[f].astype(np.uint16), key[f], content[f], text))
        if len(again):
            to.append(bucket % n)
            own.append(True)
            blob.append(pack_bytes(ids[row[again]], uids[row[again]], start[again], count[again]))
        return pa.table({"to": pa.array(to, pa.int64()), "bucket": pa.array([bucket] * len(to), pa.int64()), "own": pa.array(own, pa.bool_()), "blob": pa.array(blob, pa.binary())})

    return run


def repeats(text: np.ndarray, begin: np.ndarray, count: np.ndarray, rank: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of the windows that an earlier window equals, by the suffix array of the pieces.

    Piece i is text[begin[i] : begin[i] + count[i] + window - 1]; its first window starts at ``start`` in the document
    of order ``rank``.
    """
    n = len(begin)
    size = count + window - 1
    # a separator after each piece, over all bytes
    out = np.full(int(size.sum()) + n + 1, 257 if text.max(initial=0) > 253 else 255, np.int16 if text.max(initial=0) > 253 else np.uint8)
    at = np.cumsum(size + 1) - size - 1
    out[ranges(at, size)] = text[ranges(begin, size)].astype(out.dtype) + out.dtype.type(1)
    out[-1] = 0
    sa = suffix_array(out)
    shared = common_prefixes(out, sa)
    which = np.full(len(out), -1, np.int32)
    which[ranges(at, count)] = np.repeat(np.arange(n, dtype=np.int32), count)
    joined = shared[sa] >= window
    run = np.cumsum(~joined)
    many = joined.copy()
    many[:-1] |= joined[1:]
    sel = np.flatnonzero(many & (which[sa] >= 0))
    if not len(sel):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos = sa[sel].astype(np.int64)
    piece = which[pos].astype(np.int64)
    off = pos - at[piece]
    order = np.lexsort((start[piece] + off, rank[piece], run[sel]))
    r = run[sel][order]
    later = np.concatenate(([False], r[1:] == r[:-1]))
    p, o = piece[order], off[order]
    return p[later], o[later]


def _shard(window: int, limit: int):
    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(t.column("bucket").to_pylist(), t.column("own").to_pylist(), t.column("blob").to_pylist()))
        passed = [(k, x) for k, own, x in rows if own]
        got = [(k, unpack_bytes(x)) for k, own, x in rows if not own]
        if not got:
            return _to_buckets(passed)
        bucket = np.concatenate([np.full(len(x[0]), k) for k, x in got])
        ids, uids, start, count, key, content = (np.concatenate([x[j] for _, x in got]) for j in range(6))
        count = count.astype(np.int64)
        text = np.concatenate([x[6] for _, x in got])
        size = count + window - 1
        begin = np.cumsum(size) - size
        del got
        order = np.lexsort((start, uids, ids, content, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        again, first = order[~new], order[new]
        out_piece, out_from, out_count = [again], [np.zeros(len(again), np.int64)], [count[again]]
        # the order of documents as one number
        by = np.lexsort((uids, ids))
        step = np.concatenate(([False], (ids[by][1:] != ids[by][:-1]) | (uids[by][1:] != uids[by][:-1])))
        rank = np.empty(len(ids), np.int64)
        rank[by] = np.cumsum(step)
        # suffix arrays over whole keys, about ``limit`` bytes each
        edge = np.concatenate(([True], key[first][1:] != key[first][:-1]))
        part = (np.cumsum(size[first]) - size[first]) // limit
        part = np.maximum.accumulate(np.where(edge, part, 0))
        for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(first)))):
            f = first[lo:hi]
            p, o = repeats(text, begin[f], count[f], rank[f], start[f], window)
            order = np.lexsort((o, p))
            p, o = p[order], o[order]
            cut = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (o[1:] != o[:-1] + 1)))) if len(p) else np.zeros(0, np.int64)
            out_piece.append(f[p[cut]])
            out_from.append(o[cut])
            out_count.append(np.diff(np.append(cut, len(p))))
        piece, off, n = (np.concatenate(x) for x in (out_piece, out_from, out_count))
        by = np.argsort(bucket[piece], kind="stable")
        piece, off, n = piece[by], off[by], n[by]
        names, at = np.unique(bucket[piece], return_index=True)
        ends = np.append(at[1:], len(piece))
        spans = [pack_bytes(ids[piece[a:b]], uids[piece[a:b]], start[piece[a:b]] + off[a:b], n[a:b]) for a, b in zip(at, ends)]
        return _to_buckets([*passed, *zip(names.tolist(), spans)])

    return run


def _to_buckets(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([k for k, _ in rows], pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})


def _finish(window: int):
    def run(t: pa.Table, back: pa.Table) -> pa.Table:
        ids, uids, raw, offsets = _texts(t)
        size = np.diff(offsets)
        mark = np.zeros(len(raw) + 1, np.int32)
        if back.num_rows and len(ids):
            got = [unpack_bytes(x.as_py()) for x in back.column("blob")]
            gid, guid, start, count = (np.concatenate([x[j] for x in got]) for j in range(4))
            row = _row_of(ids, uids, gid, guid)
            a = offsets[row] + start
            np.add.at(mark, a, 1)
            np.add.at(mark, a + count + window - 1, -1)
        gone = np.cumsum(mark[:-1]) > 0
        out = {"removed": [], "spans": [], "sha": [], "ranges": []}
        for i in range(len(ids)):
            g = gone[offsets[i] : offsets[i + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
            out["removed"].append(int(g.sum()))
            out["spans"].append(len(edge) // 2)
            out["sha"].append(hashlib.sha256(raw[offsets[i] : offsets[i + 1]][~g].tobytes()).hexdigest())
            out["ranges"].append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
        # one result for each row of the input, repeated rows too
        row = _row_of(ids, uids, t.column("id").to_numpy(zero_copy_only=False), t.column("uid").to_numpy(zero_copy_only=False)) if t.num_rows else np.zeros(0, np.int64)
        pick = row.tolist()
        return pa.table({
            "id": t.column("id"), "null_id": t.column("null_id"), "n_bytes": pa.array(size[row], pa.int64()), "n_removed": pa.array([out["removed"][i] for i in pick], pa.int64()),
            "n_spans": pa.array([out["spans"][i] for i in pick], pa.int64()), "kept_sha256": pa.array([out["sha"][i] for i in pick], pa.string()),
            "spans": pa.array([out["ranges"][i] for i in pick], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    return run


def _row_of(ids: np.ndarray, uids: np.ndarray, gid: np.ndarray, guid: np.ndarray) -> np.ndarray:
    """Places of (gid, guid) in the ordered pairs (ids, uids)."""
    at = np.searchsorted(ids, gid)
    while True:
        off = np.flatnonzero(uids[at] != guid)
        if not len(off):
            return at
        at[off] += 1


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans are the removed byte ranges."""
    spark = bounded(docs).sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    n = max(parts(spark), -(-size // BUCKET_BYTES))
    src = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"), F.col(id_col).isNull().alias("null_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumn("uid", F.xxhash64("text")).withColumn("bucket", F.pmod(F.xxhash64("id", "uid"), F.lit(n)).cast("long"))

    def squeeze(batches):
        codec = pa.Codec("zstd", 3)
        for b in batches:
            raw, off = utf8(b.column(2))
            data = raw.tobytes()
            z = [codec.compress(data[i:j], asbytes=True) if j > i else b"" for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(np.diff(off), pa.int64()), pa.array(z, pa.binary())], names=["id", "null_id", "uid", "bucket", "n", "z"])

    texts = src.mapInArrow(squeeze, "id long, null_id boolean, uid long, bucket long, n long, z binary").repartition(n, "bucket")
    keys = texts.groupBy("bucket").applyInArrow(_send_keys(window, n), "to long, bucket long, blob binary")
    back = keys.groupBy("to").applyInArrow(_repeated(HOT), "bucket long, blob binary")
    sent = texts.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(_send_pieces(window, n), "to long, bucket long, own boolean, blob binary")
    spans = sent.groupBy("to").applyInArrow(_shard(window, SHARD_BYTES), "bucket long, blob binary")
    done = texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(
        _finish(window), "id long, null_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    return done.select(F.when(~F.col("null_id"), F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")
