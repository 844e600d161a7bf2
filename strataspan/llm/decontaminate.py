"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded number of documents of one task. Runs of words that occur in the benchmark, long enough to hold
a window, are its indexed sequence; all other words cannot be part of an occurrence. Windows of ``window`` consecutive
item words (a shorter item is one window) are found by backward search over wavelet-tree ranks, located by sampled
suffix positions, and merged to removal spans. No shuffle: every document is finished in the task that reads it.

The index holds the runs of benchmark words only, so it can be asked for phrases of the benchmark, not for others.

The benchmark's words are sent to the tasks in groups of items of at most ``MAX_QUERY_WORDS`` words (the bound on
what a task and the driver hold); a larger benchmark takes one pass per group. Then the rows are written once with a
key, each pass is run and written before the next group is read, and what the passes found is united by key.

Defined results: A-Z are lower-cased, words are runs of digits, letters a-z and characters over U+007F; a null or
empty text has no words and is never contaminated; an item without words has no window; rows that repeat an item id count once;
rows repeating a doc_id are judged one by one; empty tables give empty results, or no hits; further input columns
are carried along, and input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.llm.common import Settled, bounded, table
from strataspan.llm.fm_index import FMIndex
from strataspan.llm.kernels import blocks, ranges, utf8, word_hashes

#: Benchmark words held by a task at once; indexed words, and bytes of text, of a shard.
MAX_QUERY_WORDS = 2_000_000
SHARD_WORDS, SHARD_BYTES = 1_000_000, 12 << 20

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


class Phrases:
    """The windows of some benchmark items as word ids."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        raw, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        h, row, _, _ = word_hashes(raw, offsets)
        self.vocab = np.unique(h)
        ids = np.searchsorted(self.vocab, h) + 1
        counts = np.bincount(row, minlength=len(items))
        first = np.cumsum(counts) - counts
        names = np.array([i for i, _ in items], object)
        groups: dict[int, list[np.ndarray]] = {}
        for length in sorted({min(int(c), window) for c in counts if c}):
            own = np.flatnonzero(np.minimum(counts, window) == length)
            many = counts[own] - length + 1
            starts = ranges(first[own], many)
            groups[length] = [ids[starts[:, None] + np.arange(length)], np.repeat(own, many)]
        self.names, self.groups = names, groups
        self.shortest = min(groups, default=0)


class Shard:
    """Documents of one task whose candidate words are indexed together."""

    def __init__(self, phrases: Phrases):
        self.p = phrases
        self.batches: list[pa.RecordBatch] = []
        self.n_words: list[np.ndarray] = []
        self.ids, self.row, self.start, self.end = [], [], [], []
        self.rows = self.size = self.words = 0

    def add(self, batch: pa.RecordBatch, text: pa.Array) -> None:
        raw, offsets = utf8(text)
        for lo, hi in blocks(offsets):
            part = raw[offsets[lo] : offsets[hi]]
            off = offsets[lo : hi + 1] - offsets[lo]
            h, row, s, e = word_hashes(part, off)
            self.n_words.append(np.bincount(row, minlength=hi - lo))
            if len(h) and len(self.p.vocab):
                at = np.minimum(np.searchsorted(self.p.vocab, h), len(self.p.vocab) - 1)
                known = self.p.vocab[at] == h
                cut = np.ones(len(h), bool)
                cut[1:] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
                begin = np.flatnonzero(cut)
                length = np.diff(np.append(begin, len(h)))
                good = known[begin] & (length >= self.p.shortest)
                # one word more than the run: a separator that no phrase holds
                idx = ranges(begin[good], length[good])
                tail = np.cumsum(length[good])
                self.ids.append(np.insert(at[idx] + 1, tail, len(self.p.vocab) + 1))
                self.row.append(np.insert(row[idx] + self.rows + lo, tail, -1))
                self.start.append(np.insert(s[idx] - off[row[idx]], tail, -1))
                self.end.append(np.insert(e[idx] - off[row[idx]], tail, -1))
                self.words += len(idx)
        self.batches.append(batch)
        self.rows += batch.num_rows
        self.size += int(offsets[-1])

    def results(self) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        n_hit = np.zeros(self.rows, np.int64)
        spans: dict[int, list] = {}
        items: dict[int, list[str]] = {}
        if self.words:
            ids, row, start, end = (np.concatenate(x) for x in (self.ids, self.row, self.start, self.end))
            index = FMIndex(ids, len(self.p.vocab) + 2)
            mark = np.zeros(len(ids) + 1, np.int64)
            pairs = []
            for length, (windows, owner) in self.p.groups.items():
                lo, hi = index.search(windows)
                found = np.flatnonzero(hi > lo)
                if not len(found):
                    continue
                # windows of several items can be equal: locate a range once
                (lo_u, first), inverse = np.unique(lo[found], return_index=True), np.unique(lo[found], return_inverse=True)[1]
                width = (hi - lo)[found][first]
                place = index.locate(ranges(lo_u, width))
                np.add.at(mark, place, 1)
                np.add.at(mark, place + length, -1)
                begin = np.cumsum(width) - width
                rows_of = row[place]
                for k, g in zip(owner[found], inverse):
                    pairs.append(np.unique(rows_of[begin[g] : begin[g] + width[g]]) * len(self.p.names) + k)
            hit = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            np.add.at(n_hit, row[hit], 1)
            if len(hit):
                new = np.ones(len(hit), bool)
                new[1:] = (np.diff(hit) > 1) | (row[hit][1:] != row[hit][:-1])
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(hit)) - 1
                for r, s, e in zip(row[hit][a].tolist(), start[hit][a].tolist(), end[hit][b].tolist()):
                    spans.setdefault(r, []).append({"start": s, "end": e})
                for x in np.unique(np.concatenate(pairs)).tolist():
                    items.setdefault(x // len(self.p.names), []).append(self.p.names[x % len(self.p.names)])
        n_words = np.concatenate(self.n_words) if self.n_words else np.zeros(0, np.int64)
        lo = 0
        for batch in self.batches:
            hi = lo + batch.num_rows
            yield batch, [
                pa.array(n_words[lo:hi], pa.int64()), pa.array(n_hit[lo:hi], pa.int64()),
                pa.array([sorted(set(items.get(r, []))) for r in range(lo, hi)], pa.list_(pa.string())),
                pa.array([spans.get(r, []) for r in range(lo, hi)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
            lo = hi


def _task(phrases: Phrases, text_col: str, carried: list[str]):
    def run(batches):
        shard = Shard(phrases)
        for batch in batches:
            shard.add(batch.select(carried), batch.column(batch.schema.get_field_index(text_col)))
            if shard.words >= SHARD_WORDS or shard.size >= SHARD_BYTES:
                yield from out(shard)
                shard = Shard(phrases)
        yield from out(shard)

    def out(shard):
        for batch, extra in shard.results():
            yield pa.RecordBatch.from_arrays(batch.columns + extra, names=carried + RESULT.names)

    return run


def _groups(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in groups of at most ``limit`` words (bytes / 2 at most), read partition by partition."""
    group, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        n = len(text or "") // 2 + 1
        if group and size + n > limit:
            yield group
            group, size = [], 0
        group.append(("" if item is None else item, text))
        size += n
    yield group


def find_spans(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10,
    carry: list[str] | None = None, max_query_words: int = MAX_QUERY_WORDS,
) -> DataFrame:
    """The columns ``carry`` of each document (all by default) with n_words, n_hit (words in any occurrence),
    items (those that occur, sorted) and spans (byte ranges of the text to remove, merged).
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c not in RESULT.names]
    need = bounded(docs).select(*dict.fromkeys([*carried, text_col]))
    out_schema = T.StructType([need.schema[c] for c in carried] + RESULT.fields)
    groups = _groups(benchmark, item_col, item_text, max_query_words)
    first, second = next(groups), next(groups, None)
    if second is None:
        return need.mapInArrow(_task(Phrases(first, window), text_col, carried), out_schema)
    settled = Settled(docs.sparkSession)
    key = "row_key"
    while key in need.columns or key in RESULT.names:
        key += "_"
    keyed = settled(need.withColumn(key, F.monotonically_increasing_id()))
    shape = T.StructType([T.StructField(key, T.LongType()), *RESULT.fields])
    passes = None
    for group in chain((first, second), groups):
        one = keyed.select(key, text_col).mapInArrow(_task(Phrases(group, window), text_col, [key]), shape)
        # the first pass counts the words of all rows
        one = settled(one if passes is None else one.where(F.size("items") > 0))
        passes = one if passes is None else passes.unionByName(one)
    merged = passes.groupBy(key).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("parts"))
    return _unite(keyed.join(merged.select(key, F.struct("n_words", "items", "parts").alias(f"{key}_found")), key), carried, out_schema, text_col, f"{key}_found")


def _unite(rows: DataFrame, carried: list[str], schema: T.StructType, text_col: str, found: str) -> DataFrame:
    """Merge overlapping spans of several passes and count the words in them."""

    def run(batches):
        for batch in batches:
            got = batch.column(batch.schema.get_field_index(found)).to_pylist()
            raw, off = utf8(batch.column(batch.schema.get_field_index(text_col)))
            for i, r in enumerate(got):
                text = raw[off[i] : off[i + 1]]
                words = lambda a, b: len(word_hashes(text[a:b], np.array([0, b - a]))[0])  # noqa: B023, E731
                spans: list[dict] = []
                for s in sorted(r["parts"], key=lambda x: (x["start"], x["end"])):
                    # adjoining occurrences belong together when no word lies between
                    if spans and (s["start"] <= spans[-1]["end"] or not words(spans[-1]["end"], s["start"])):
                        spans[-1]["end"] = max(spans[-1]["end"], s["end"])
                    else:
                        spans.append(dict(s))
                r["spans"], r["n_hit"] = spans, sum(words(s["start"], s["end"]) for s in spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in carried] + [
                    pa.array([r["n_words"] for r in got], pa.int64()), pa.array([r["n_hit"] for r in got], pa.int64()), pa.array([r["items"] for r in got], pa.list_(pa.string())),
                    pa.array([r["spans"] for r in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=schema.names)

    return rows.mapInArrow(run, schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dwin AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM dw, (SELECT DISTINCT m FROM bwin) WHERE len(w) >= m)),
occ AS (SELECT d.doc_id, d.i, d.m, b.item_id FROM dwin d JOIN bwin b ON d.m = b.m AND d.win = b.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN its i ON d.doc_id = i.doc_id
"""
