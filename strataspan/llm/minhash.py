"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (all its words, where it has fewer); a shingle weighs its count in the
text times its inverse document frequency. Document frequencies are exact: texts are dealt, compressed, to buckets once, each
bucket sends its shingles with counts to ranges of the hash space, the ranges add them up, and shingles that two
documents or more hold go back, with their sums, to the buckets that sent them. A document keeps the frequencies of
its own shingles as a packed value, so no task and not the driver holds those of the whole corpus.

``BANDS`` bands of ``ROWS`` samples each make candidates (a pair of similarity 0.8 is missed with probability
3e-5). Equal texts are one node. In every bucket of a band all members meet one leader, so that a bucket of n texts
makes n candidates; candidates are verified by weighted Jaccard similarity of the whole texts. Members in
several components meet further leaders in rounds, until all components of all buckets have met or are barred by
what their texts can share at most; so no link between different texts is lost and no bucket emits all its pairs.

Defined results: one row for each distinct id, with the id's column and ``class_id``; other input columns are not
read. Null and empty texts are equal; a text without words is only near its equals; rows that repeat an id, with equal
texts or different ones, are one document, whose class is all that is near any of them; rows without an id are left
out, as nothing could name them; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.common import Settled, bounded, parts, table
from strataspan.llm.components import classes_of_buckets
from strataspan.llm.kernels import blocks, gram_hashes, mix64, utf8, word_hashes
from strataspan.llm.suffix_dedup import _ZSTD, pack_bytes, unpack_bytes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
#: Text of a bucket; a range of the hash space gets about as many shingles as a bucket has.
BUCKET_BYTES = 12 << 20
_POOL_BITS = 13
_POOL = 1 << _POOL_BITS
#: 64-bit words of the bitmap that keeps texts which share no bucket from being shuffled again: 2 MB at most.
_MARKS = 1 << 18


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), sorted by row and shingle."""
    h, row, _, _ = word_hashes(raw, offsets)
    g, r = gram_hashes(h, row, k)
    n = np.bincount(row, minlength=len(offsets) - 1)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.searchsorted(row, short)
        some = [(g, r)]
        for size in range(1, k):
            own = n[short] == size
            if own.any():
                words = h[first[own][:, None] + np.arange(size)].reshape(-1)
                some.append((gram_hashes(words, np.repeat(short[own], size), size)[0], short[own]))
        g, r = np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])
    order = np.argsort(g)
    by = r[order]
    if len(offsets) <= 1 << 16:  # short numbers are sorted by radix
        by = by.astype(np.uint16)
    order = order[np.argsort(by, kind="stable")]
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return r[at], g[at], np.diff(np.append(at, len(g)))


def weigh(n: int, df: np.ndarray) -> np.ndarray:
    """Inverse document frequency of shingles that ``df`` of ``n`` documents hold."""
    return np.maximum(np.log((n + 1) / df), 1e-3)


@dataclass
class Weights:
    """Inverse document frequencies: those of some shingles, and that of all others."""

    keys: np.ndarray
    idf: np.ndarray
    rest: float

    def of(self, g: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = np.full(len(g), self.rest)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == g)
            w[hit] = self.idf[at[hit]]
        return w * count

    @classmethod
    def of_repeated(cls, n: int, keys: np.ndarray, df: np.ndarray) -> Weights:
        """``keys``: all shingles that several documents hold; any other is in one."""
        return cls(keys, weigh(n, df), float(weigh(n, np.ones(1))[0]))


def frequencies(docs: DataFrame, text_col: str = "text") -> Weights:
    """Exact weights of all shingles of a small table, collected; large ones keep them in their buckets, see
    :func:`_deal_texts`."""

    def run(batches):
        for b in batches:
            raw, offsets = utf8(b.column(0))
            for lo, hi in blocks(offsets):
                _, g, _ = shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], names=["g"])

    got = docs.select(text_col).mapInArrow(run, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").toArrow()
    g, c = np.array(got["g"], np.int64).view(np.uint64), np.array(got["c"], float)
    order = np.argsort(g)
    return Weights.of_repeated(docs.count(), g[order], c[order])


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _pack_keys(keys: np.ndarray, *arrays: np.ndarray) -> bytes:
    """Sorted keys as the byte planes of their differences, and arrays beside them."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return pack_bytes(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).reshape(-1), *arrays)


def _unpack_keys(data: bytes) -> list[np.ndarray]:
    planes, *arrays = unpack_bytes(data)
    gaps = np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(np.uint64)
    return [np.cumsum(gaps, dtype=np.uint64), *arrays]


def pack_df(df: np.ndarray) -> bytes:
    """Document frequencies of a text's shingles, in their order; nothing where no other document holds any."""
    return _narrow(df).tobytes() if len(df) and df.max() > 1 else b""


def unpack_df(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if data else np.ones(n, np.int64)


def _weighed(text: np.ndarray, df: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's sorted shingles and their weights."""
    _, g, count = shingles(text, np.array([0, len(text)]))
    return g, weigh(n, unpack_df(df, len(g))) * count


def _dealt(g: np.ndarray, n: int) -> np.ndarray:
    """The range of the hash space, of n, that a shingle lies in."""
    return ((g >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _send_shingles(n: int):
    def run(t: pa.Table) -> pa.Table:
        """A bucket's shingles, and how many of its documents hold each, to their ranges."""
        raw, offsets = _texts(t)
        held = [np.zeros(0, np.uint64)]
        held += [shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[1] for lo, hi in blocks(offsets)]
        g, c = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(_dealt(g, n), np.arange(n + 1))
        to = np.flatnonzero(np.diff(cuts))
        blob = [_pack_keys(g[cuts[r] : cuts[r + 1]], _narrow(c[cuts[r] : cuts[r + 1]])) for r in to]
        b = t.column("bucket")[0].as_py() if t.num_rows else 0
        return pa.table({"to": pa.array(to, pa.int64()), "bucket": pa.array([b] * len(to), pa.int64()), "blob": pa.array(blob, pa.binary())})

    return run


def _add_up(t: pa.Table) -> pa.Table:
    """Of a range's shingles, those that several documents hold, with their document frequency, to each sender."""
    sent = [_unpack_keys(x.as_py()) for x in t.column("blob")]
    size = np.array([len(g) for g, _ in sent], np.int64)
    every = np.concatenate([np.zeros(0, np.uint64)] + [g for g, _ in sent])
    order = np.argsort(every, kind="stable")
    g = every[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(g)), bool), g[1:] != g[:-1])))
    c = np.concatenate([np.zeros(0, np.int64)] + [c.astype(np.int64) for _, c in sent])[order]
    total = np.zeros(len(g), np.int64)
    total[order] = np.repeat(np.add.reduceat(c, begin), np.diff(np.append(begin, len(g)))) if len(g) else c
    buckets, to, blob = t.column("bucket").to_pylist(), [], []
    for i, end in enumerate(np.cumsum(size)):
        df = total[end - size[i] : end]
        own = np.flatnonzero(df > 1)
        if len(own):
            to.append(buckets[i])
            blob.append(_pack_keys(sent[i][0][own], _narrow(df[own])))
    return pa.table({"bucket": pa.array(to, pa.int64()), "blob": pa.array(blob, pa.binary())})


def _texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of compressed texts."""
    size = t.column("n").to_numpy(zero_copy_only=False)
    raw = b"".join(_ZSTD.decompress(z.as_buffer(), n, asbytes=True) if n else b"" for z, n in zip(t.column("z"), size.tolist()))
    return np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum(size)))


def _squeeze(batches):
    for b in batches:
        raw, off = utf8(b.column(1))
        data = raw.tobytes()
        z = [_ZSTD.compress(data[i:j], asbytes=True) if j > i else b"" for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(np.diff(off), pa.int64()), pa.array(z, pa.binary())], names=["id", "h", "bucket", "n", "z"])


def _deal_texts(own: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(id, h, bucket, n, z) in n buckets, and (bucket, blob): the repeated shingles of each bucket with their
    document frequencies. Both read one exchange of the texts."""
    texts = own.select("id", "text", F.unhex(F.sha2("text", 256)).alias("h")).withColumn("bucket", F.pmod(F.xxhash64("id", "h"), F.lit(n)).cast("long"))
    kind = own.schema["id"].dataType.simpleString()
    texts = texts.mapInArrow(_squeeze, f"id {kind}, h binary, bucket long, n long, z binary").repartition(n, "bucket")
    sent = texts.groupBy("bucket").applyInArrow(_send_shingles(n), "to long, bucket long, blob binary")
    return texts, sent.groupBy("to").applyInArrow(_add_up, "bucket long, blob binary")


class Sampler:
    """Improved consistent weighted sampling with ``BANDS * ROWS`` hash functions.

    A function draws r, c (gamma) and beta (uniform) for a shingle from a pool of 2**13 draws picked by the shingle's
    hash; shingles with the same draw are told apart by their hash. The sample of a text is the shingle with the least
    ln a = ln c - r (t - beta) - r, t = floor(ln w / r + beta), together with that value.
    """

    def __init__(self, weights: Weights, seed: int = 20240229):
        self.w = weights
        rng = np.random.default_rng(seed)
        size = (BANDS * ROWS, _POOL)
        self.r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        self.lnc = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
        self.beta = rng.random(size, np.float32)
        self.mult = rng.integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.common = [self._high(j, slice(None), np.float32(np.log(weights.rest))) for j in range(BANDS * ROWS)]

    def _high(self, j: int, at, lnw) -> np.ndarray:
        r, beta = self.r[j, at], self.beta[j, at]
        lna = self.lnc[j, at] - r * (np.floor(lnw / r + beta) - beta) - r
        bits = np.ascontiguousarray(lna, np.float32).view(np.uint32)
        # floats in the order of unsigned integers
        return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)

    def bands(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows that have shingles, their band hashes)."""
        row, g, count = shingles(raw, offsets)
        return self.samples(row, g, self.w.of(g, count))

    def samples(self, row: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for shingles with weights."""
        if not len(g):
            return row, np.zeros((0, BANDS), np.uint64)
        odd = np.flatnonzero(w != self.w.rest)
        lnw = np.log(w[odd]).astype(np.float32)
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        low = mix64(g.copy()) >> np.uint64(32)
        out = np.zeros((len(begin), BANDS), np.uint64)
        for j in range(BANDS * ROWS):
            at = ((g * self.mult[j]) >> np.uint64(64 - _POOL_BITS)).astype(np.int64)
            key = self.common[j][at]
            if len(odd):
                key[odd] = self._high(j, at[odd], lnw)
            key |= low
            best = np.minimum.reduceat(key, begin)
            out[:, j // ROWS] = mix64(out[:, j // ROWS] * np.uint64(3) + best)
        return row[begin], out


_made: dict[float, Sampler] = {}


def _sampler(weights: Weights) -> Sampler:
    """The sampler of this worker, made once: it takes some 15 MB."""
    if weights.rest not in _made:
        _made.clear()
        _made[weights.rest] = Sampler(weights)
    return _made[weights.rest]


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weight that two sets (sorted shingles, weights) share."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    return float(np.minimum(a[1][hit], b[1][at[hit]]).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity."""
    least = overlap(a, b)
    return least / (a[1].sum() + b[1].sum() - least) if least else 0.0


def _signatures(own: DataFrame, n: int, size: int) -> DataFrame:
    """(id, h, bands, df) of the rows; df has the document frequencies of a text's shingles."""
    texts, back = _deal_texts(own, max(parts(own.sparkSession), -(-size // BUCKET_BYTES)))
    kind = own.schema["id"].dataType
    none = Weights.of_repeated(n, np.zeros(0, np.uint64), np.zeros(0))

    def run(t: pa.Table, back: pa.Table) -> pa.Table:
        sampler = _sampler(none)
        got = [_unpack_keys(x.as_py()) for x in back.column("blob")]
        known = np.concatenate([np.zeros(0, np.uint64)] + [k for k, _ in got])
        freq = np.concatenate([np.zeros(0, np.int64)] + [c.astype(np.int64) for _, c in got])
        order = np.argsort(known)
        known, freq = known[order], freq[order]
        raw, offsets = _texts(t)
        sizes, lists = np.zeros(t.num_rows, np.int32), [np.zeros(0, np.int64)]
        dfs = [b""] * t.num_rows
        for lo, hi in blocks(offsets):
            row, g, count = shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            df = np.ones(len(g), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                hit = np.flatnonzero(known[at] == g)
                df[hit] = freq[at[hit]]
            rows, bands = sampler.samples(row, g, weigh(n, df) * count)
            cuts = np.append(np.searchsorted(row, rows), len(row))
            sizes[lo + rows] = BANDS
            lists.append(bands.view(np.int64).reshape(-1))
            for k, r in enumerate(rows.tolist()):
                dfs[lo + r] = pack_df(df[cuts[k] : cuts[k + 1]])
        ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)))
        bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), pa.int64()))
        return pa.table({"id": t.column("id"), "h": t.column("h"), "bands": bands, "df": pa.array(dfs, pa.binary())})

    return texts.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(run, f"id {kind.simpleString()}, h binary, bands array<long>, df binary")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, overlap, linked) of the pairs, by their whole texts. Both joins use one exchange of the texts."""
    one = docs.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.col("df").alias("da"))
    two = docs.select(F.col("id").alias("b"), F.col("text").alias("tb"), F.col("df").alias("db"))
    # the leader's text comes last, so that its followers stand together
    wide = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb", "da", "db")

    def run(batches):
        last, held = None, None
        for b in batches:
            ids = b.column(1).to_pylist()
            (ra, oa), (rb, ob) = utf8(b.column(2)), utf8(b.column(3))
            least, ok = np.zeros(len(ids)), np.zeros(len(ids), bool)

            def weighed(raw, off, df, i):
                return _weighed(raw[off[i] : off[i + 1]], df[i].as_py(), n)

            for i, leader in enumerate(ids):
                mark = (leader, rb[ob[i] : ob[i + 1]].tobytes())
                if mark != last:
                    held, last = weighed(rb, ob, b.column(5), i), mark
                own = weighed(ra, oa, b.column(4), i)
                least[i] = overlap(own, held)
                ok[i] = least[i] > 0 and least[i] >= threshold * (own[1].sum() + held[1].sum() - least[i])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least), pa.array(ok)], names=["a", "b", "overlap", "linked"])

    kind = docs.schema["id"].dataType.simpleString()
    return wide.mapInArrow(run, f"a {kind}, b {kind}, overlap double, linked boolean").groupBy("a", "b").agg(F.max("overlap").alias("overlap"), F.max("linked").alias("linked"))


def _bounds(some: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, total, common) of the documents ``some`` (a): the weight of their shingles, and of those that another of
    them has too. An id that several rows share is not bounded."""
    own = texts.withColumnRenamed("id", "a").join(some, "a", "left_semi").select("a", "text", "df")
    kind = own.schema["a"].dataType.simpleString()

    def run(batches):
        for b in batches:
            raw, off = utf8(b.column(1))
            for lo, hi in blocks(off):
                row, g, c = shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                size = np.bincount(row, minlength=hi - lo)
                df = np.concatenate([np.zeros(0, np.int64)] + [unpack_df(b.column(2)[lo + i].as_py(), size[i]) for i in range(hi - lo)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + lo)), pa.array(g.view(np.int64)), pa.array(weigh(n, df) * c)], names=["a", "g", "w"])

    each = own.mapInArrow(run, f"a {kind}, g long, w double")
    alone = each.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.sum("w").alias("w")).where("n = 1").groupBy("a").agg(F.sum("w").alias("alone"))
    total = each.groupBy("a").agg(F.sum("w").alias("total"))
    rows = own.groupBy("a").agg(F.count(F.lit(1)).alias("rows"))
    out = total.join(alone, "a", "left").join(rows, "a")
    return out.select("a", F.when(F.col("rows") > 1, 0.0).otherwise(F.col("total")).alias("total"), F.when(F.col("rows") > 1, 1e300).otherwise(F.col("total") - F.coalesce("alone", F.lit(0.0))).alias("common"))


def _marked(own: DataFrame, members: DataFrame) -> DataFrame:
    """The rows whose id may be one of ``members``, by a bitmap of hashed ids whose size is bounded by ``_MARKS``.

    Some other rows pass too, the more the more members there are; joins that follow tell them apart."""
    word, bit = F.pmod(F.shiftrightunsigned("x", 6), F.lit(_MARKS)), F.expr("shiftleft(1L, CAST(x & 63 AS INT))")
    marks = members.select(F.xxhash64("id").alias("x")).select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    hashed = own.withColumn("x", F.xxhash64("id")).withColumn("word", word).join(F.broadcast(marks), "word")
    return hashed.where(F.col("bits").bitwiseAND(bit) != 0).select(*own.columns)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id) of every id; class_id is the smallest id of its class."""
    spark = bounded(docs).sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL")
    whole = own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    n = whole["n"]
    settled = Settled(spark)
    signed = settled(_signatures(own, n, whole["size"] or 0))
    nodes = settled(signed.groupBy("h").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))
    rows = nodes.select(F.col("rep").alias("a"), F.posexplode("bands").alias("band", "sig"))
    lead = settled(rows.groupBy("band", "sig").agg(F.min("a").alias("b"), F.max("a").alias("z")).where("b <> z").drop("z"), narrow=True)
    shared = settled(rows.join(lead, ["band", "sig"]), narrow=True)
    # only the texts of documents that share a bucket are looked at again, and those once here
    members = settled(shared.select(F.col("a").alias("id")).distinct(), narrow=True)
    freq = signed.join(members, "id", "left_semi").select("id", "h", "df").dropDuplicates(["id", "h"])
    texts = settled(_marked(own, members).withColumn("h", F.unhex(F.sha2("text", 256))).join(freq, ["id", "h"]).select("id", "text", "df"))
    labels = classes_of_buckets(
        shared, lead, lambda pairs: _verified(pairs, texts, n, threshold), lambda some: _bounds(some, texts, n), threshold,
        nodes.select(F.col("rep").alias("a"), F.col("bands").alias("sigs")))
    kind = own.schema["id"].dataType.simpleString()
    classes = signed.select("id", "h").join(nodes.select("h", "rep"), "h").join(labels.select(F.col("node").cast(kind).alias("rep"), "label"), "rep", "left")
    return classes.select(F.col("id").alias(id_col), F.coalesce("label", "rep").alias("class_id")).groupBy(id_col).agg(F.min("class_id").alias("class_id"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
