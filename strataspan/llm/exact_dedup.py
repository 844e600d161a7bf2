"""Exact dedup against a history: a sharded minimal perfect hash over the distinct digests of earlier documents.

A shard's hash gives each of its digests a slot, and a slot holds the full digest and the locator of its winner (id and
length of the longest text). A digest that arrives looks up its one slot; only where all 32 bytes are the same is it a
repeat. Other digests make groups of their own. Both kinds end in one table of groups, from which each row learns which
row of its group stays.

Texts are equal when they are the same after ``[\\x20\\x09-\\x0D]`` is deleted; of equal texts the one with the most code
points stays, then the one with the smallest id.

Defined results: a null text is an empty one; a null id loses to any other of the same length; rows that agree in id,
normalised text and length are one document, counted as often as they come, and stay or go together; an empty table
gives an empty result; no history means that every row arrives; further columns of the input, whatever their names, are
kept by :func:`exact_dedup` and not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.llm.common import Settled, table
from strataspan.llm.perfect_hash import DIGEST, PerfectHash, as_words

#: Digests of a shard, about: some 60 bytes each.
SHARD_KEYS = 1 << 16
#: A group with more than this part of all rows is hot; there are fewer such groups than the number says.
HOT = 1024

BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r")


def digest(text: Column) -> Column:
    """SHA-256, as bytes, of a text without blanks."""
    bare = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        bare = F.replace(bare, F.lit(blank), F.lit(""))
    return F.unhex(F.sha2(bare, 256))


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, n_chars) of each row."""
    return docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"))


def _groups(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_chars, n), a row for each digest, whatever its number of rows: counted before the shuffle."""
    best = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.short")).alias("keep_chars"), "n")


def _part(of: int) -> Column:
    """Range of the digest's first 32 bits, of so many."""
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return F.shiftright(head * of, 32)


def _parts(words: np.ndarray, of: int) -> np.ndarray:
    head = words[:, 0].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :4].copy().view(">u4").ravel()
    return (head.astype(np.uint64) * np.uint64(of) >> np.uint64(32)).astype(np.int64)


def _index_schema(id_type: T.DataType) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    return T.StructType([T.StructField("shard", T.LongType()), T.StructField("sizes", longs), T.StructField("bits", T.BinaryType()), T.StructField("digests", T.BinaryType()),
                         T.StructField("keep_id", T.ArrayType(id_type)), T.StructField("keep_chars", longs), T.StructField("n", longs)])


def _make_shard(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    words = as_words(group["digest"].to_pylist())
    made = PerfectHash.of(words)
    order = pa.array(np.argsort(made.slots(words)))
    rows = group.take(order)
    one = lambda c: pa.array([rows[c].to_pylist()], pa.list_(rows[c].type))
    return pa.table({
        "shard": group["shard"][:1], "sizes": pa.array([made.sizes], pa.list_(pa.int64())), "bits": [made.packed], "digests": [b"".join(rows["digest"].to_pylist())],
        "keep_id": one("keep_id"), "keep_chars": one("keep_chars"), "n": one("n")})


def build_index(groups: DataFrame, n_shards: int) -> DataFrame:
    """One row for each shard of some groups: its perfect hash, and by slot the full digest, winner, length and count."""
    return groups.withColumn("shard", _part(n_shards)).groupBy("shard").applyInArrow(_make_shard, _index_schema(groups.schema["keep_id"].dataType))


def _look_up(parts: int, part: int, asked: pa.Table, shard: pa.Table) -> pa.Table:
    """The groups of one part: digests that arrive, found in the history or not, and the history's others."""
    asked = asked.combine_chunks()
    names = ["digest", "keep_id", "keep_chars", "n"]
    asked = asked.select(names).append_column("known", pa.array(np.zeros(len(asked), bool)))
    if not len(shard):
        return asked
    row = shard.slice(0, 1).combine_chunks()
    flat = lambda c: row[c].chunk(0).flatten()
    held = row["digests"][0].as_py()
    have = as_words(held)
    slots = {"digest": pa.array([held[k : k + DIGEST] for k in range(0, len(held), DIGEST)], pa.binary()), **{c: flat(c) for c in names[1:]}}
    kept = pa.table({c: slots[c].cast(asked[c].type) for c in names}).append_column("known", pa.array(np.ones(len(have), bool)))
    words = as_words(asked["digest"].to_pylist())
    at = PerfectHash(flat("sizes").to_pylist(), row["bits"][0].as_py()).slots(words)
    found = at >= 0
    found[found] = (have[at[found]] == words[found]).all(1)
    here = _parts(have, parts) == part
    here[at[found]] = False
    # repeats: the winner is the better of the slot's and the one that arrives
    old, new = kept.take(pa.array(at[found])), asked.filter(pa.array(found))
    was, now = old["keep_chars"].to_numpy(), new["keep_chars"].to_numpy()
    newer = [b > a or a == b and y is not None and (x is None or y < x) for a, b, x, y in zip(was, now, old["keep_id"].to_pylist(), new["keep_id"].to_pylist())]
    pick = pa.array(np.where(newer, np.arange(len(newer)) + len(newer), np.arange(len(newer))))
    ids = pa.concat_arrays([c for t in (old, new) for c in t["keep_id"].chunks]) if len(newer) else old["keep_id"]
    merged = pa.table({
        "digest": old["digest"], "keep_id": ids.take(pick) if len(newer) else ids, "keep_chars": np.maximum(was, now),
        "n": old["n"].to_numpy() + new["n"].to_numpy(), "known": np.ones(len(newer), bool)})
    return pa.concat_tables([merged.cast(asked.schema), asked.filter(pa.array(~found)), kept.filter(pa.array(here)).cast(asked.schema)])


def groups_of(rows: DataFrame, history: DataFrame | None, settled: Settled) -> DataFrame:
    """(digest, keep_id, keep_chars, n, known) of all groups of rows and history (each ``id, digest, n_chars``)."""
    new = settled(_groups(rows))
    if history is None:
        return new.withColumn("known", F.lit(False))
    old = settled(_groups(history))
    n_new, n_old = new.count(), old.count()
    n_shards = max(1, -(-n_old // SHARD_KEYS))
    slices = max(1, -(-n_new // (n_shards * SHARD_KEYS)))
    parts = n_shards * slices
    index = settled(build_index(old, n_shards))
    first = F.col("shard") * slices
    dealt = index.withColumn("part", F.explode(F.sequence(first, first + (slices - 1))))

    def look_up(key: tuple, asked: pa.Table, shard: pa.Table) -> pa.Table:
        return _look_up(parts, key[0].as_py(), asked, shard)

    schema = T.StructType([*new.schema.fields, T.StructField("known", T.BooleanType())])
    return settled(new.withColumn("part", _part(parts)).groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(look_up, schema))


def exact_groups(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, keep_id, group_size, kept, text_sha256) of each row of ``docs`` and ``history``.

    Texts are scanned once, for a row of some 60 bytes each; what follows works on those. Digests are grouped with
    partial counts; shards and parts hold bounded numbers of distinct digests; rows meet their groups by a broadcast of
    the hot groups (fewer than ``HOT`` by definition) and by a join on the digest for the others.
    """
    settled = Settled(docs.sparkSession)
    new = digested(docs, id_col, text_col).withColumn("old", F.lit(False))
    both = settled(new if history is None else new.unionByName(digested(history, id_col, text_col).withColumn("old", F.lit(True))))
    rows = both.drop("old")
    groups = groups_of(both.where("NOT old"), None if history is None else both.where("old"), settled).where("n > 1").drop("known")
    hot = F.col("n") > rows.count() // HOT
    big = F.broadcast(groups.where(hot))
    rest = rows.join(big.select("digest"), "digest", "left_anti").join(groups.where(~hot), "digest", "left")
    met = rows.join(big, "digest").select(*rest.columns).unionByName(rest)
    alone = F.col("n").isNull()
    return met.select(
        F.col("id").alias("doc_id"), "n_chars", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = exact_groups(docs, history, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("n_chars").alias("__n"), F.unhex("text_sha256").alias("__digest")).distinct()
    text = F.col(text_col)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.char_length(F.coalesce(text, F.lit(""))) == F.col("__n")) & (digest(text) == F.col("__digest"))
    return docs.join(gone, same, "left_anti")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: those with even ids are the history that is indexed, the others arrive."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    return exact_groups(docs.where(~old), docs.where(old)).drop("n_chars")


OP13_SQL = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM bare WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
