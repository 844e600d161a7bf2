import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataspan.llm import exact_dedup, merkle, spelling
from strataspan.llm.common import Settled
from strataspan.llm.perfect_hash import PerfectHash, as_words


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- op11: Merkle manifest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, k, fan_out):
    """Top above ``nodes``, and the siblings of node k as (before, after) from below."""
    path = []
    while len(nodes) > 1:
        first = k - k % fan_out
        run = nodes[first : first + fan_out]
        path.append(("".join(run[: k - first]), "".join(run[k - first + 1 :])))
        nodes, k = [H(*nodes[j : j + fan_out]) for j in range(0, len(nodes), fan_out)], k // fan_out
    return nodes[0], path


def brute_merkle(rows, fan_out):
    """rows: (doc_id, lang, n_chars, text) -> {(doc_id, leaf): ...} by recomputing whole trees."""
    leaf = lambda r, d=0: H(*[field(v) for v in (r[0], r[1], None if r[2] is None else r[2] + d, r[3])])
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        by.setdefault("" if r[1] is None else "=" + r[1], []).append(r)
    groups = [by[k] for k in sorted(by, key=str.encode)]
    subroots = [climb([leaf(r) for r in g], 0, fan_out)[0] for g in groups]
    root, out = climb(subroots, 0, fan_out)[0], []
    for at, g in enumerate(groups):
        leaves = [leaf(r) for r in g]
        for k, r in enumerate(g):
            path = climb(leaves, k, fan_out)[1] + climb(subroots, at, fan_out)[1]
            node = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for before, after in path:
                node = H(before, node, after)
            out.append((r[0], leaves[k], subroots[at], root, H(*[x for p in path for x in p]), node, node == root))
    return sorted(out, key=str)


def manifest(docs, fan_out=2):
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    out = merkle.merkle_manifest(docs, ["doc_id", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": F.try_add("n_chars", F.lit(1))}, hit, fan_out)
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("fan_out, levels", [(2, 1), (2, 3), (3, 1), (2, 9)])
def test_manifest_against_whole_trees(spark, monkeypatch, fan_out, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rows = [(k * 3 % 101, ["a", "ä", "b", None, "z"][k % 11 % 5], None if k % 9 == 0 else k, None if k % 13 == 0 else f"text {k}") for k in range(61)] + [(500, "only", 1, "one")]
    assert manifest(spark.createDataFrame(rows, "doc_id long, lang string, n_chars long, text string").repartition(5), fan_out) == brute_merkle(rows, fan_out)


def test_manifest_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["lang"], r["n_chars"], r["text"]) for r in odd.collect()]
    got = manifest(odd)
    assert got == brute_merkle(rows, 2)
    assert all(r[6] for r in got)  # n_chars is null everywhere: nothing was tampered with
    assert manifest(none) == []
    one = odd.where("doc_id = 7")
    (row,) = manifest(one.withColumn("key", F.lit(1)).withColumn("hash", F.lit("mine")).withColumn("pos", F.lit("x")))
    assert row[1] == row[2] == row[3] == row[5] and row[4] == H()


def test_states_are_resumed_not_made_again():
    nodes = [H(str(k)).encode() for k in range(7)]
    tree = merkle.Subtree(nodes, merkle.height(7, 3), 3)
    other = H("other").encode()
    for k in range(7):
        assert tree.fold(k, other).decode() == climb([n.decode() for n in nodes[:k]] + [other.decode()] + [n.decode() for n in nodes[k + 1 :]], 0, 3)[0]
        assert merkle.Ascent(tree.path(k)).fold(other) == tree.fold(k, other) and tree.fold(k, nodes[k]) == tree.tops[0]
    with pytest.raises(ValueError):
        merkle.build_tree(None, 1)


# ---- op12: spelling variants


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


def brute_variants(words):
    known = {}
    for w, n in words.items():
        near = [(-m, o) for o, m in words.items() if edits(w, o) == 1]
        least, form = min(near, default=(0, None))
        known[w] = (form if -least >= 2 * n else None, n, len(near), -least if -least >= 2 * n else None)

    def root(w):
        return w if known[w][0] is None else root(known[w][0])

    return sorted((w, f, root(w), n, c, fn) for w, (f, n, c, fn) in known.items())


def variants(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_against_all_pairs(spark):
    # few letters, so that grams repeat inside words and their ranks tie; all edits, at all places
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(5, 8))): int(rng.integers(3, 60)) for _ in range(260)}
    words |= {"aaaaa": 9, "aaaaaa": 20, "aaaaaaa": 41, "baaaaa": 41, "aaaaab": 3}
    assert variants(spark, words) == brute_variants(words)


def test_forms_follow_ties_and_chains(spark):
    chain = {"aaaaaaa"[:k] + "bcdefgh"[k:]: 3 * 2**k for k in range(8)}
    assert {r[2] for r in variants(spark, chain)} == {"aaaaaaa"}
    got = {r[0]: r for r in variants(spark, {"colour": 9, "color": 30, "colours": 30, "coulour": 4, "alone": 5})}
    assert got["colour"][1] == "color" and got["coulour"][1:3] == ("colour", "color") and got["alone"][1:] == (None, "alone", 5, 0, None)
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_variants(empty).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(empty, 1)


def test_variants_are_not_broadcast_by_the_size_of_files(spark, tmp_path):
    """The words' files are small, but a word has dozens of keys, and files are compressed."""
    words = {"colour": 9, "color": 30, "colours": 30, "coulour": 4, "alone": 5}
    spark.createDataFrame(list(words.items()), "word string, n long").write.parquet(f"{tmp_path}/words")
    saved = spark.read.parquet(f"{tmp_path}/words")
    near = spelling.near_words(saved)
    assert near.count() == 6 and "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    joined = []

    class Watched(spelling.Settled):
        def __call__(self, df, narrow=False):
            joined.append(df._jdf.queryExecution().executedPlan().toString())
            return super().__call__(df, narrow)

    out = spelling.spelling_variants(saved, settled=Watched(spark))
    assert sorted(map(tuple, out.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute_variants(words)
    # the first table joins what a shuffle has counted, by its size as it turns out
    assert len(joined) > 2 and not any("BroadcastHashJoin" in p for p in [*joined[1:], out._jdf.queryExecution().executedPlan().toString()])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=3, max_size=7, unique=True), st.data())
def test_pivots_are_the_least_disjoint_grams(starts, data):
    starts = sorted(starts)
    weights = data.draw(st.lists(st.integers(0, 9), min_size=len(starts), max_size=len(starts)))
    fits = [p for p in itertools.combinations(range(len(starts)), 2) if starts[p[1]] - starts[p[0]] >= 2]
    got = spelling.choose_pivots(starts, weights)
    assert tuple(got) in fits and sum(weights[k] for k in got) == min(weights[a] + weights[b] for a, b in fits)


def brute_words(rows):
    counts = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= 3}


def test_words_of_whole_texts(spark, sf, odd):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    for docs, want in ((spark.read.parquet(f"{sf}/documents.parquet"), brute_words(rows)), (odd, brute_words([(r["doc_id"], r["text"]) for r in odd.collect()]))):
        long = spelling.runs(docs).where("char_length(run) >= 5")
        assert dict(map(tuple, spelling.word_counts(long, spelling.slipped(F.col("run"), F.col("id"))).collect())) == want
    assert spelling.runs(odd.where("doc_id < -5")).count() == 0 and want["seven"] == 4


# ---- op13: exact dedup


@settings(max_examples=50, deadline=None)
@given(st.sets(st.binary(min_size=32, max_size=32), max_size=300))
def test_perfect_hash_is_minimal_and_tells_no_lies(keys):
    keys = sorted(keys)
    words = as_words(keys)
    made = PerfectHash.of(words)
    again = PerfectHash(made.sizes, made.packed)
    assert sorted(again.slots(words)) == list(range(len(keys)))
    others = as_words([hashlib.sha256(bytes([k])).digest() for k in range(50)])
    assert ((again.slots(others) >= -1) & (again.slots(others) < max(1, len(keys)))).all()
    with pytest.raises(ValueError):
        PerfectHash.of(as_words([b"x" * 32] * 2))


def brute_exact(rows):
    groups = {}
    bare = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[bare(t)]
        best = min(g)
        out.append((i, best[3], len(g), i == best[3] and -len(t or "") == best[0], H(bare(t))))
    return sorted(out, key=str)


def exact(docs, history=None):
    return sorted((tuple(r) for r in exact_dedup.exact_groups(docs, history).drop("n_chars").collect()), key=str)


ROWS = [(k, f"text {k % 40}" + " \t\n\x0b\f\r"[: k % 7] * (k % 3) if k % 5 else "hot  text" + " " * (k % 2)) for k in range(400)] + [(1000, None), (1001, ""), (1002, " "), (None, "text 3"), (None, "lost"), (3, "text 3"), (3, "text 3"), (1003, "a b"), (1004, "a b"), (1005, "ab")]


@pytest.mark.parametrize("keys, hot", [(4, 8), (1 << 16, 10**6)])
def test_exact_groups_against_plain_python(spark, monkeypatch, keys, hot):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", keys)
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    want = brute_exact(ROWS)
    assert exact(docs) == want
    for old in ("doc_id % 2 = 0", "doc_id < 7", "doc_id > 5000", "true"):  # histories of all sizes, and both ways of slicing
        there = F.coalesce(F.expr(old), F.lit(False))
        assert exact(docs.where(~there), docs.where(there)) == want


def test_exact_lookups_are_checked_byte_by_byte(spark):
    """A digest that is not in the index may hit any slot; it must not become a repeat."""
    settled = Settled(spark)
    digests = lambda lo, hi: spark.range(lo, hi).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.lit(5).cast("long").alias("n_chars"))
    got = exact_dedup.groups_of(digests(400, 1000), digests(0, 500), settled).collect()
    assert len(got) == 1000 and {r["keep_id"] for r in got if r["n"] == 2} == set(range(400, 500)) and sum(r["known"] for r in got) == 500


def test_exact_dedup_of_odd_rows(odd, none):
    assert exact(odd) == brute_exact([(r["doc_id"], r["text"]) for r in odd.collect()])
    kept = exact_dedup.exact_dedup(odd.withColumn("digest", F.lit("mine")).withColumn("n", F.lit(1)), none)
    assert kept.columns == [*odd.columns, "digest", "n"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 9, 11, 12]  # rows equal in id and text stay together
    assert exact(none) == [] and exact(none, none) == [] and exact_dedup.exact_dedup(none, odd).count() == 0
