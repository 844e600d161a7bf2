"""Spelling variants: words one edit apart, found through pivotal grams, and the form that each word is a variant of.

A word's bigrams are ordered by how rare they are over all words; its prefix holds the rarest three. Two of these that
do not overlap are its pivots, chosen for the least total frequency by dynamic programming over positions. One edit
spoils at most one of two disjoint grams, so of two words one edit apart, the one whose prefix ends earlier in the order
has a pivot that is left in the other word, and there it lies in the prefix. The edit is on one side of that gram, and
on the other side the words are the same up to the word's end: an equi-join on that end with the gram, its length the
gram's position from there, finds all such pairs, and an edit distance settles each.

Every word is near a bounded number of others (some dozens for each of its letters), so the pairs grow as the words.

Defined results: of near words with the same count the smallest in code-point order is the form; a word without near
words, or whose most frequent near word comes less than ``ratio`` times as often, has none and is its own root; words
of fewer than five code points are not looked at; a null text has no words; an empty table gives an empty result;
repeated rows count as often as they come; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.common import Settled, table
from strataspan.llm.line_dedup import LOWER, UPPER
from strataspan.llm.merkle import CRC_TABLE_SQL, crc_sql

GRAM = 2
EDITS = 1
#: Grams of a prefix: enough that one of them is left, and starts where it did, whatever the edit.
PREFIX = GRAM * EDITS + 1
MIN_CHARS = 5
RUN = r"[A-Za-zÀ-ÿ]+"
#: Pieces of a text without letters.
GAP = r"[^A-Za-zÀ-ÿ]+"


def lower_ascii(word: Column) -> Column:
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run) of each run of letters of each text, A-Z lower-cased."""
    return docs.select(F.col(id_col).alias("id"), F.explode(F.split(text_col, GAP)).alias("run")).where("run <> ''").select("id", lower_ascii(F.col("run")).alias("run"))


def slipped(run: Column, doc_id: Column, every: int = 97) -> Column:
    """The run, without one of its code points where the checksum of ``<id>:<run>`` is divisible by ``every``; a run of a
    row without id stays as it is."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(words: DataFrame, word: Column, min_n: int = 3) -> DataFrame:
    """(word, n) of words of five code points and more that come ``min_n`` times or more."""
    counted = words.select(word.alias("word")).where(F.char_length("word") >= MIN_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_n)


# ---- pivotal grams


def choose_pivots(starts: list[int], weights: list[int], k: int = EDITS + 1) -> list[int]:
    """Indices of ``k`` grams that do not overlap, of least total weight; ``starts`` ascend.

    ``best[j][i]``: the least weight of j grams among the first i, and the grams."""
    n = len(starts)
    best = [[(0, ())] * (n + 1)] + [[(float("inf"), ())] * (n + 1) for _ in range(k)]
    for j in range(1, k + 1):
        for i in range(1, n + 1):
            free = next(p for p in range(i, -1, -1) if p == 0 or starts[p - 1] + GRAM <= starts[i - 1])  # grams that end before this one
            weight, taken = best[j - 1][free]
            best[j][i] = min(best[j][i - 1], (weight + weights[i - 1], (*taken, i - 1)))
    return list(best[k][n][1])


def keys_of(word: str, at: list[int], asked: bool) -> list[str]:
    """Keys of the grams that start ``at`` these places.

    A gram that one edit leaves whole has all of the word on one of its sides unchanged with it. The edit is in the rest,
    in its first half, so that the second stays, or in its second; a key has the unchanged side, gram included, and one
    such half. Words that are ``asked`` for halve the rest by the length it has in them, one more and one less."""
    out = []
    for k in at:
        for side, whole, rest in (("<", word[: k + GRAM], word[k + GRAM :]), (">", word[k:], word[:k])):
            n = len(rest)
            lengths = range(max(0, n - EDITS), n + EDITS + 1) if asked else (n,)
            out += [f"{side}{whole}^{rest[:m]}" for m in {x // 2 for x in lengths} if m <= n]
            out += [f"{side}{whole}${rest[n - m:]}" for m in {(x + 1) // 2 for x in lengths} if m <= n]
    return out


def grams_of(word: str, ranks: dict[str, int]) -> tuple[list[int], list[int], int]:
    """Where a word's pivots start, where the grams of its prefix do, and the order of the prefix's last gram. The prefix
    also has the grams that are the same as its last."""
    grams = sorted((ranks[a + b], k) for k, (a, b) in enumerate(pairwise(word)))
    last = grams[PREFIX - 1][0]
    first = sorted((k, r) for r, k in grams[:PREFIX])
    pivots = choose_pivots([k for k, _ in first], [r for _, r in first])
    return [first[k][0] for k in pivots], [k for r, k in grams if r <= last], last


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Order of all bigrams by the number of words that have them, then by their code points. There are at most as many
    as pairs of letters (8,100 for runs as here), so that they fit any driver and task."""
    at = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = words.select(F.explode(F.array_distinct(F.transform(at, lambda k: F.substring(F.col("word"), k, F.lit(GRAM))))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {g: k for k, (_, g) in enumerate(sorted((r["n"], r["gram"]) for r in counts))}


def _ends(words: DataFrame, ranks: dict[str, int], pivots: bool) -> DataFrame:
    """(end, word, n, last), a row for each key of a word's pivots or of its prefix."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, words, ns, lasts = [], [], [], []
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
                *at, last = grams_of(word, ranks)
                for key in keys_of(word, at[0 if pivots else 1], not pivots):
                    ends.append(key)
                    words.append(word)
                    ns.append(n)
                    lasts.append(last)
            yield pa.RecordBatch.from_pydict({"end": pa.array(ends, pa.string()), "word": pa.array(words, pa.string()), "n": pa.array(ns, pa.int64()), "last": pa.array(lasts, pa.int32())})

    return words.select("word", "n").mapInArrow(index, "end string, word string, n long, last int").select(F.xxhash64("end").alias("end"), "word", "n", "last")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all ordered pairs of words one edit apart; ``words``: distinct ``word`` and ``n``."""
    ranks = gram_ranks(words)
    a, b = _ends(words, ranks, True).alias("a"), _ends(words, ranks, False).alias("b")
    lengths = F.abs(F.char_length("a.word") - F.char_length("b.word")) <= EDITS
    # equal hashes of different ends only cost the comparison; the two words differ, as their distance is not 0
    near = (F.col("a.end") == F.col("b.end")) & (F.col("a.last") <= F.col("b.last")) & lengths & (F.levenshtein("a.word", "b.word", EDITS) == EDITS)
    first = F.col("a.word") < F.col("b.word")
    one, two = (F.struct(F.col(f"{t}.word").alias("word"), F.col(f"{t}.n").alias("n")) for t in "ab")
    # a table's size as Spark sees it leaves out the keys of a word, dozens of them: by itself it would broadcast either side
    pairs = a.join(b.hint("merge"), near).select(F.when(first, one).otherwise(two).alias("x"), F.when(first, two).otherwise(one).alias("y")).distinct()
    both = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"))
    return both.select("p.x.word", "p.x.n", F.col("p.y.word").alias("near"), F.col("p.y.n").alias("near_n"))


def roots(forms: DataFrame, settled: Settled) -> DataFrame:
    """(word, root) for (word, form): where following forms ends. Counts rise along the way, so there are no circles, and
    each round halves what is left of it. The tables are shuffled: the size of a saved table, by which Spark would broadcast
    it, is that of its compressed files."""
    at = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settled(at.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, ratio: float = 2, settled: Settled | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of ``words``: distinct ``word`` of five code points or more, and ``n``.
    ``words`` is read several times: give a written table."""
    if ratio <= 1:
        raise ValueError("a form comes more often than its variants")
    settled = settled or Settled(words.sparkSession)
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    found = F.when(-F.col("best.less") >= F.col("n") * ratio, F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("n")))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), found.alias("best"))
    known = settled(known.select("word", "n", "n_near", F.col("best.form").alias("form"), F.col("best.n").alias("form_n")))
    ends = roots(known.where("form IS NOT NULL"), settled)
    return known.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    long = runs(docs).where(F.char_length("run") >= MIN_CHARS)  # shorter runs are no words, whole or not
    settled = Settled(spark)
    return spelling_variants(settled(word_counts(long, slipped(F.col("run"), F.col("id")))), 2, settled)


OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
lowered AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS c FROM found GROUP BY ALL),
hashed AS (
  SELECT run, c, {crc_sql("flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END))")} AS h
  FROM lowered, crc_tab WHERE length(run) >= 5),
words AS (
  SELECT w AS word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS w, c FROM hashed)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
holes AS (
  -- words one edit apart are equal after one code point of each, or of the longer one, is left out at one place
  SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS o, b.n AS o_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(o_n) AS top, arg_min(o, struct_pack(a := -o_n, b := o)) AS o FROM near GROUP BY word),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN o END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at, form AS nxt FROM known UNION ALL SELECT w.word, w.nxt, k.form FROM walk w JOIN known k ON k.word = w.nxt)
SELECT k.word, form, w.at AS root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM known k JOIN walk w ON w.word = k.word AND w.nxt IS NULL
"""
