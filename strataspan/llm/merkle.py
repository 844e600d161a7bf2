"""Merkle manifest of a table: a tree over the hashes of its rows, proofs, and the root that a changed row leads to.

Rows are leaves, hashed over their fields. The leaves of a group (a value of one column), in order, are hashed in runs
of ``fan_out`` until one node is left, the subroot; the subroots, in order of their groups, are hashed in the same way to
the root. Every parent keeps a copy of its hash state before each of its children, so that folding a changed leaf
resumes the state before its slot with the replacement and the siblings to the right only.

The tree is made in tiers. The nodes of a tier are dealt to blocks of ``fan_out ** BLOCK_LEVELS`` neighbours, each the
whole subtree of one node of the next tier, and a task makes a block with its states. No task sees more than a block and
the path from it to the root; the number of tiers grows with the logarithm of the rows. On the way down, each block is
given that path, a few dozen hashes.

Defined results: a null field is ``-``, so it differs from all values; the group of nulls comes first, then groups by
the bytes of their text; a null in the order column comes first; rows that repeat it follow each other by their hashes;
a group of one row has that leaf as its subroot, a table of one group has its subroot as its root; an empty table has no
root and gives an empty result; columns that are neither fields, group nor order play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.llm.common import Settled, parts, table

#: Levels of a block: 512 leaves with two children a node.
BLOCK_LEVELS = 9

NODE = "key string, pos long, m long, hash string"
PATH = "array<struct<before: string, after: string>>"


# ---- hashing


def record_hash(fields: Sequence[str | Column]) -> Column:
    """SHA-256, in lower-case hex, of fields one after the other: ``-`` for null, else byte count, colon, value."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def height(m: int, fan_out: int) -> int:
    """Levels above m nodes until one is left."""
    h, room = 0, 1
    while room < m:
        h, room = h + 1, room * fan_out
    return h


class Subtree:
    """Some levels above a run of nodes, with the hash states that the parents have kept."""

    def __init__(self, nodes: list[bytes], levels: int, fan_out: int):
        self.fan_out = fan_out
        #: By level and node: the parent's state before the node, and the siblings on both sides of it.
        self.states: list[list] = []
        self.sides: list[list[tuple[bytes, bytes]]] = []
        for _ in range(levels):
            states, sides, above = [], [], []
            for k in range(0, len(nodes), fan_out):
                run, state = nodes[k : k + fan_out], hashlib.sha256()
                for slot, node in enumerate(run):
                    states.append(state.copy())
                    sides.append((b"".join(run[:slot]), b"".join(run[slot + 1 :])))
                    state.update(node)
                above.append(state.hexdigest().encode())
            self.states.append(states)
            self.sides.append(sides)
            nodes = above
        self.tops = nodes

    def path(self, k: int) -> list[tuple[bytes, bytes]]:
        """Siblings before and after node k and after each of its ancestors, from below."""
        out = []
        for sides in self.sides:
            out.append(sides[k])
            k //= self.fan_out
        return out

    def fold(self, k: int, node: bytes) -> bytes:
        """The top that is reached with another node in place k."""
        for states, sides in zip(self.states, self.sides):
            state = states[k].copy()
            state.update(node + sides[k][1])
            node, k = state.hexdigest().encode(), k // self.fan_out
        return node


class Ascent:
    """The way from a node to the root along a path; the state before each ancestor is made once and resumed often."""

    def __init__(self, path: list[tuple[bytes, bytes]]):
        self.steps = [(hashlib.sha256(before), after) for before, after in path]
        self.siblings = b"".join(x for step in path for x in step)

    def fold(self, node: bytes) -> bytes:
        for before, after in self.steps:
            state = before.copy()
            state.update(node + after)
            node = state.hexdigest().encode()
        return node


# ---- the tree


@dataclass
class Tree:
    """``tiers``: tables (key, pos, m, hash) from the leaves up, m the nodes of the key's tier; those of the first have
    the leaves' further columns, too. ``roof``: the same for the subroots. Each folds into a single node a key."""

    tiers: list[DataFrame]
    roof: list[DataFrame]
    fan_out: int

    @property
    def root(self) -> str | None:
        top = self.roof[-1].select("hash").first()
        return top and top[0]


def _numbered(rows: DataFrame, order: list[str], settled: Settled) -> DataFrame:
    """``pos``, the number of each row in its key's order, and ``m``, the key's rows. No task holds a whole key: rows go
    to ranges of key and order and are numbered inside them, and the ranges, as many as there are partitions, get offsets."""
    ranged = rows.repartitionByRange(parts(rows.sparkSession), "key", *order).sortWithinPartitions("key", *order)
    dealt = settled(ranged.withColumn("__at", F.monotonically_increasing_id())).withColumn("__range", F.shiftright("__at", 33))
    runs = dealt.groupBy("key", "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    by = W.partitionBy("key")
    offsets = runs.select("key", "__range", (F.sum("__n").over(by.orderBy("__range")) - F.col("__n") - F.col("__first")).alias("__to"), F.sum("__n").over(by).alias("m"))
    return dealt.join(offsets, ["key", "__range"]).withColumn("pos", F.col("__at") + F.col("__to")).drop("__at", "__range", "__first", "__to")


def _in_order(block: pa.Table) -> pa.Table:
    return block.combine_chunks().sort_by("pos")


def _subtree(block: pa.Table, size: int, fan_out: int) -> Subtree:
    m = block["m"][0].as_py()
    return Subtree([h.encode() for h in block["hash"].to_pylist()], height(min(m, size), fan_out), fan_out)


def _raise_tiers(nodes: DataFrame, fan_out: int, settled: Settled) -> list[DataFrame]:
    size = fan_out**BLOCK_LEVELS

    def top_of(block: pa.Table) -> pa.Table:
        block = _in_order(block)
        (top,) = _subtree(block, size, fan_out).tops
        m = block["m"][0].as_py()
        return pa.table({"key": block["key"][:1], "pos": [block["pos"][0].as_py() // size], "m": [-(-m // size)], "hash": [top.decode()]})

    tiers = [nodes]
    while True:
        blocks = tiers[-1].select("key", "pos", "m", "hash").groupBy("key", F.floor(F.col("pos") / size).alias("block"))
        tiers.append(settled(blocks.applyInArrow(top_of, NODE)))
        if tiers[-1].where("m > 1").isEmpty():
            return tiers


def build_tree(leaves: DataFrame, fan_out: int = 2, settled: Settled | None = None) -> Tree:
    """The tree over ``leaves``: (grp, ord, hash) and further columns, none of them named key, pos, m or starting with __."""
    if fan_out < 2:
        raise ValueError("a node has two children or more")
    settled = settled or Settled(leaves.sparkSession)
    text = F.col("grp").cast("string")
    keyed = leaves.withColumn("key", F.when(text.isNull(), "").otherwise(F.concat(F.lit("="), text)))  # nulls come first
    tiers = _raise_tiers(_numbered(keyed, ["ord", *sorted(set(leaves.columns) - {"grp", "ord"})], settled), fan_out, settled)
    subroots = tiers[-1].select(F.lit("").alias("key"), F.col("key").alias("of"), "hash")
    return Tree(tiers, _raise_tiers(_numbered(subroots, ["of"], settled), fan_out, settled), fan_out)


# ---- proofs


def _flat(path: list[dict]) -> list[tuple[bytes, bytes]]:
    return [(p["before"].encode(), p["after"].encode()) for p in path]


def _descend(nodes: DataFrame, above: DataFrame, fan_out: int, keep: list[str]) -> DataFrame:
    """(key, pos, *keep, path, top) of the nodes of a tier, given (key, pos, path, top) of the next."""
    size = fan_out**BLOCK_LEVELS
    kinds = T.StructType([nodes.schema[c] for c in ("key", "pos", *keep)]).simpleString()[7:-1]

    def paths(block: pa.Table, up: pa.Table) -> pa.Table:
        block = _in_order(block)
        tree, (rest,) = _subtree(block, size, fan_out), up["path"].to_pylist()
        whole = [[{"before": b.decode(), "after": a.decode()} for b, a in tree.path(k)] + rest for k in range(len(block))]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return block.select(["key", "pos", *keep]).append_column("path", pa.array(whole, kind)).append_column("top", pa.array(up["top"].to_pylist() * len(block), pa.string()))

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / size)).groupBy("key", "block")
    return blocks.cogroup(above.withColumn("block", F.col("pos")).groupBy("key", "block")).applyInArrow(paths, f"{kinds}, path {PATH}, top string")


def fold_leaves(tree: Tree, candidate: str, keep: list[str], settled: Settled | None = None) -> DataFrame:
    """(hash, *keep, subroot, root, proof_sha256, folded_root, path_length) of each leaf; ``candidate`` names the leaves'
    column with the hash to fold in place of the leaf's own.

    ``proof_sha256`` is the hash of all siblings on the way to the root, from below, left to right."""
    settled = settled or Settled(tree.tiers[0].sparkSession)
    fan_out, size = tree.fan_out, tree.fan_out**BLOCK_LEVELS
    up = tree.roof[-1].select("key", "pos", F.array().cast(PATH).alias("path"), F.col("hash").alias("top"))
    for k in range(len(tree.roof) - 2, -1, -1):
        up = settled(_descend(tree.roof[k], up, fan_out, ["of", "hash"] if k == 0 else []))
    up = up.select(F.col("of").alias("key"), F.lit(0).cast("long").alias("pos"), "path", F.concat("top", F.lit(" "), "hash").alias("top"))
    for k in range(len(tree.tiers) - 2, 0, -1):
        up = settled(_descend(tree.tiers[k], up, fan_out, []))
    leaves = tree.tiers[0].select("key", "pos", "m", "hash", F.col(candidate).alias("__candidate"), *keep)
    kinds = T.StructType([leaves.schema[c] for c in ("hash", *keep)]).simpleString()[7:-1]

    def folded(block: pa.Table, above: pa.Table) -> pa.Table:
        block = _in_order(block)
        sub, ascent = _subtree(block, size, fan_out), Ascent(_flat(above["path"].to_pylist()[0]))
        root, subroot = above["top"][0].as_py().split(" ")
        proofs, roots, lengths = [], [], []
        for k, c in enumerate(block["__candidate"].to_pylist()):
            inner = sub.path(k)
            proofs.append(hashlib.sha256(b"".join(x for step in inner for x in step) + ascent.siblings).hexdigest())
            roots.append(ascent.fold(sub.fold(k, c.encode())).decode())
            lengths.append(len(inner) + len(ascent.steps))
        n = len(block)
        more = {"subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": roots, "path_length": pa.array(lengths, pa.int64())}
        return pa.table({c: block[c] for c in ("hash", *keep)} | more)

    blocks = leaves.withColumn("block", F.floor(F.col("pos") / size)).groupBy("key", "block")
    schema = f"{kinds}, subroot string, root string, proof_sha256 string, folded_root string, path_length long"
    return blocks.cogroup(up.withColumn("block", F.col("pos")).groupBy("key", "block")).applyInArrow(folded, schema)


def merkle_manifest(docs: DataFrame, fields: Sequence[str], group_col: str, order_col: str, tampered: dict[str, Column] | None = None, where: Column | None = None, fan_out: int = 2) -> DataFrame:
    """(order_col, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``folded_root`` is that of the row with the fields ``tampered`` where ``where`` holds, of the row itself elsewhere,
    and its original siblings. One scan of the rows; what follows works on their hashes."""
    settled = Settled(docs.sparkSession)
    other = record_hash([(tampered or {}).get(f, F.col(f)) for f in fields])
    changed = F.when(where, other) if where is not None else F.lit(None).cast("string")
    leaves = settled(docs.select(F.col(group_col).alias("grp"), F.col(order_col).alias("ord"), record_hash(fields).alias("hash"), changed.alias("changed")))
    tree = build_tree(leaves.withColumn("candidate", F.coalesce("changed", "hash")).drop("changed"), fan_out, settled)
    out = fold_leaves(tree, "candidate", ["ord"], settled)
    return out.select(F.col("ord").alias(order_col), F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    more = F.try_add(F.col("n_chars"), F.lit(1))
    return merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": more}, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


#: CRC-32 of a list of bytes, its table made by the polynomial's rule.
CRC_TABLE_SQL = """crc_tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab)"""


def crc_sql(of_bytes: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {of_bytes}), lambda c, b: xor(c // 256, tab[1 + xor(c, b) % 256])), 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    return f"""{name} AS (SELECT 0 AS level, key, pos, m, h FROM {leaves} UNION ALL
  SELECT level + 1, key, pos // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE m > 1 GROUP BY level, key, pos // 2, m)"""


def _fold_sql(name: str, start: str, tree: str) -> str:
    return f"""{name} AS (SELECT doc_id, 0 AS level, key, pos, m, h FROM {start} UNION ALL
  SELECT f.doc_id, f.level + 1, f.key, f.pos // 2, (f.m + 1) // 2, sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
  FROM {name} f LEFT JOIN {tree} s ON s.level = f.level AND s.key = f.key AND s.pos = xor(f.pos, 1) WHERE f.m > 1)"""


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
marked AS (SELECT *, {crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))")} % 7 = 0 AS hit FROM documents, crc_tab),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS key, {_leaf_sql("n_chars")} AS h, CASE WHEN hit THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS other,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS m FROM marked),
{_tree_sql("low", "leaves")},
subroots AS (SELECT key AS of_, h, '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS m FROM low WHERE m = 1),
{_tree_sql("high", "subroots")},
sides AS (
  SELECT d.doc_id, 0 AS part, u.level, u.h FROM leaves d JOIN low u ON u.key = d.key AND u.pos = xor(d.pos >> u.level, 1)
  UNION ALL SELECT d.doc_id, 1, u.level, u.h FROM leaves d JOIN subroots s ON s.of_ = d.key JOIN high u ON u.pos = xor(s.pos >> u.level, 1)),
proofs AS (SELECT doc_id, string_agg(h, '' ORDER BY part, level) AS p FROM sides GROUP BY doc_id),
others AS (SELECT doc_id, key, pos, m, other AS h FROM leaves),
{_fold_sql("fold_low", "others", "low")},
met AS (SELECT f.doc_id, s.key, s.pos, s.m, f.h FROM fold_low f JOIN subroots s ON s.of_ = f.key WHERE f.m = 1),
{_fold_sql("fold_high", "met", "high")}
SELECT d.doc_id, d.h AS leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves d JOIN subroots s ON s.of_ = d.key JOIN high r ON r.m = 1 LEFT JOIN proofs p ON p.doc_id = d.doc_id JOIN fold_high f ON f.doc_id = d.doc_id AND f.m = 1
"""
