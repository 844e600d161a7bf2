import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspan.llm import minhash, spotsigs, suffix_dedup
from strataspan.llm.common import Settled
from strataspan.llm.components import components
from strataspan.llm.line_dedup import line_dedup


def brute_suffix(rows, window):
    """Rows sorted by (id, hash order is not needed where ids differ)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w in seen:
                gone[p : p + window] = True
            seen.add(w)
        runs = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out[i] = (len(b), int(gone.sum()), int((runs == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1024, 3])
def test_op1_against_brute_force(spark, sf, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 60_000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 30_000)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.op1_suffix_dedup(spark, sf).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert got == brute_suffix(rows, 100)


def test_op1_odd_rows(spark, odd, none):
    got = suffix_dedup.suffix_dedup(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["n_bytes"] == 0 and by[5]["n_spans"] == 0
    # a period of five bytes: everything but its first window and what precedes is covered
    assert by[8]["n_removed"] == len("word " * 40_000) - 5 and by[8]["n_spans"] == 1
    assert by[None]["n_removed"] == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_op3_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in line_dedup(odd).collect()}
    assert got[1]["text"] == "and something else that only this one has\n" and got[1]["n_dropped"] == 1 and got[1]["n_lines"] == 3
    assert got[3]["n_dropped"] == 0 and got[4]["text"] is None and got[5]["n_lines"] == 1 and got[12]["n_lines"] == 4
    assert got[1]["score"] == 7 and got[1]["spans"] == "mine"
    assert got[9]["n_dropped"] == 0  # two documents only: a repeated row is no third
    assert line_dedup(none).count() == 0


def test_op3_a_line_of_many_documents_is_split(spark, split_joins):
    own = F.concat(F.lit("a line that document "), F.col("id").cast("string"), F.lit(" has alone"))
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("the very same line in all documents\n"), 4), own).alias("text"))
    assert split_joins(lambda: line_dedup(docs.repartition(8)))


def test_a_signature_of_many_sets_is_split(spark, split_joins):
    own = F.sha2(F.col("id").cast("string"), 256)
    each = spark.range(9000).select(F.col("id").alias("rep"), F.lit(2).alias("n"), F.explode(F.array(F.lit("a signature that all sets have, " * 4), own)).alias("s")).repartition(8)
    often = Settled(spark)(each.groupBy("s").agg(F.count(F.lit(1)).alias("c")))
    assert split_joins(lambda: spotsigs.ranked_sets(each, often))


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_op5_classes_against_brute_force(spark, sf):
    got = {r["doc_id"]: r["class_id"] for r in minhash.op5_minhash(spark, sf).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    assert len(got) == len(rows)
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b:
                like = len(a & b) / len(a | b)
                if like >= 0.85:
                    assert got[i] == got[j], (i, j, like)
                elif like < 0.5 and got[i] == got[j]:
                    # only through others
                    assert any(got[k] == got[i] for k in sets if k not in (i, j))


def test_op5_odd_rows(spark, odd, none):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(odd).collect()}
    assert got[10] == 9 and got[11] == 9 and got[9] == 9 and got[5] == got[4] == 4 and got[6] == 6 and None not in got
    assert minhash.near_duplicate_classes(none).count() == 0


def test_weighted_samples_agree_with_similarity():
    rng = np.random.default_rng(0)
    s = minhash.Sampler(minhash.Weights(np.zeros(0, np.uint64), np.zeros(0), 2.0))
    base = [f"w{k}" for k in range(400)]
    agree = 0
    for trial in range(20):
        a = [base[k] for k in rng.permutation(400)]
        b = a[:360] + [f"z{trial}{k}" for k in range(40)]
        from strataspan.llm.kernels import utf8
        import pyarrow as pa

        raw, off = utf8(pa.array([" ".join(a), " ".join(b)]))
        _, bands = s.bands(raw, off)
        agree += (bands[0] == bands[1]).any()
    assert agree == 20


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(50, 40), (None, 3), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert set(got.values()) == {1, 40} and got[30] == 1 and got[50] == 40
    assert components(links.where("a > 99")).count() == 0


def test_op4_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(odd).collect()}
    assert got[4]["n_chars"] == 0 and got[4]["fingerprint"] == "" and got[9]["fingerprint"] == got[10]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())
    assert spotsigs.edited_fingerprints(none).count() == 0
    classes = {r["doc_id"]: r["class_id"] for r in spotsigs.spot_matches(odd).collect()}
    assert classes[10] == 9 and classes[2] == 2
    assert spotsigs.spot_matches(none).count() == 0


def classes_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(n)}


def test_op4_classes_against_brute_force(spark, sf):
    """All documents and edited copies of some: classes are the components of all links, of sets compared in full."""
    import random

    rng = random.Random(8)
    texts = [t or "" for _, t in sorted(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())]
    for k in range(60):
        w = texts[rng.randrange(100)].split(" ")
        for _ in range(rng.choice([1, 2, 4, 8, 16])):
            w[rng.randrange(len(w))] = rng.choice(["house", "the", "of", "river"])
        texts.append(" ".join(w[rng.choice([0, 0, 20]) :]))
    texts += ["", None, "!!", "the house", "the  house"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(r["s"]) for r in docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    like = lambda i, j: not sets[i] and not sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0
    want = classes_of(len(texts), like)
    got = {r["doc_id"]: r["class_id"] for r in spotsigs.spot_matches(docs).collect()}
    assert got == want and 10 < len(texts) - len(set(want.values()))
    # some links are between sets that are not equal
    assert any(want[i] != i and sets[i] != sets[want[i]] for i in want)


def test_spot_classes_rank_shared_signatures_only(spark, monkeypatch):
    """Signatures that one set alone holds make no bucket: neither they nor sets that have too many of them are ranked."""
    seen, plain = [], spotsigs.ranked_sets

    def ranked(each, often):
        seen.append((often.where("c < 2").count(), each.join(often, "s").count(), each.count()))
        return plain(each, often)

    monkeypatch.setattr(spotsigs, "ranked_sets", ranked)
    text = lambda k: " ".join(f"the {k}word{i} {k}other{i}" for i in range(20))
    docs = spark.createDataFrame([(i, text(i)) for i in range(30)] + [(40, text("7") + " of house river"), (41, text("7"))], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in spotsigs.spot_matches(docs).collect()}
    assert got == {i: i for i in range(30)} | {40: 7, 41: 7}
    # twenty signatures in two sets each, of thirty-one sets that differ
    assert seen == [(0, 40, 621)]


def test_op5_recall_on_planted_copies(spark, sf):
    """Copies of real documents with more and more words changed, by plain Jaccard similarity of five-word shingles."""
    import random

    rng = random.Random(11)
    base = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where length(text) > 600 order by doc_id limit 150").fetchall()]
    texts, pairs = list(base), []
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [words(t)] for k in range(max(1, len(w) - 4))}
    for i, t in enumerate(base):
        w = t.split(" ")
        for _ in range(3):
            edited = list(w)
            for _ in range(rng.randrange(0, max(2, len(w) // 40))):
                edited[rng.randrange(len(w))] = f"changed{rng.randrange(10**9)}"
            a, b = shingles(t), shingles(" ".join(edited))
            pairs.append((i, len(texts), len(a & b) / len(a | b)))
            texts.append(" ".join(edited))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs).collect()}
    share = {}
    for lo, hi in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        own = [got[i] == got[j] for i, j, s in pairs if lo <= s < hi]
        share[lo] = (np.mean(own), len(own))
    print("recall", share)
    assert all(n >= 20 for _, n in share.values()) and share[0.85][0] >= 0.9 and share[0.9][0] >= 0.99, share


def test_op5_loses_no_link_in_a_group_of_edited_copies(spark):
    """Copies of one text with few to many edits: classes are the components of all links, found without all pairs."""
    import random

    import pyarrow as pa

    from strataspan.llm.kernels import utf8

    rng = random.Random(4)
    small = [f"w{k}" for k in range(40)]
    base = [rng.choice(small) + rng.choice("abcdefgh") for _ in range(110)]
    texts = []
    for k in range(140):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            t[rng.randrange(len(t))] = rng.choice(small)
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(small) for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs).collect()}
    weights = minhash.frequencies(docs)
    raw, off = utf8(pa.array(texts))
    sets = []
    for i in range(len(texts)):
        _, g, c = minhash.shingles(raw[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
        sets.append((g, weights.of(g, c)))
    assert got == classes_of(len(texts), lambda i, j: texts[i] == texts[j] or minhash.similarity(sets[i], sets[j]) >= 0.8)
    assert 3 < len(set(got.values())) < len(texts) - 20


def test_op5_document_frequencies_are_exact(spark):
    """Shingles of 8 in 3,000 documents weigh less than those of one: exact weights keep a pair apart that equal ones link."""
    from collections import Counter

    import pyarrow as pa

    from strataspan.llm.kernels import utf8

    head = " ".join(f"shared{k}" for k in range(200))
    texts = [f"{head} " + " ".join(f"own{d}x{k}" for k in range(21 if d < 2 else 400)) for d in range(8)]
    texts += [" ".join(f"own{d}x{k}" for k in range(8)) for d in range(8, 2999)] + ["one common row of five"]
    texts += ["one common row of five"] * 2 + ["", None, "!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        raw, off = utf8(pa.array([t or ""]))
        sets.append(minhash.shingles(raw, off)[1].tolist())
    held = Counter(g for s in sets for g in s)
    own = docs.selectExpr("doc_id AS id", "coalesce(text, '') AS text")
    got = {r["id"]: r["df"] for r in minhash._signatures(own, len(texts), 1).collect()}
    assert {i: minhash.unpack_df(bytes(got[i]), len(s)).tolist() for i, s in enumerate(sets) if s} == {i: [held[g] for g in s] for i, s in enumerate(sets) if s}
    weights = minhash.frequencies(docs)
    every = np.array(sorted(held), np.uint64)
    idf = [np.log((len(texts) + 1) / held[int(g)]) for g in every]
    assert np.allclose(weights.of(every, np.ones(len(every))), idf)
    idf, a, b = dict(zip(every.tolist(), idf)), set(sets[0]), set(sets[1])
    assert len(a & b) / len(a | b) > 0.82 and sum(idf[g] for g in a & b) / sum(idf[g] for g in a | b) < 0.78
    classes = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs).collect()}
    assert classes[0] == 0 and classes[1] == 1 and classes[3001] == classes[2999] == 2999 and classes[3003] == 3002


def test_op3_rows_that_share_an_id_lose_their_own_lines_only(spark):
    shared = "a line that many of the documents share"
    rows = [(None, f"{shared}\nthe first null row"), (None, "a clean line zero that is nowhere else\nthe second null row"),
            (None, f"the third null row\n{shared}"), (1, f"{shared}\none"), (1, "another clean line zero of the same id\nuno"),
            (2, f"{shared}\ntwo"), (2, f"{shared}\ntwo"), (3, f"{shared}\nthree"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["n_lines"], r["n_dropped"]) for r in line_dedup(docs).collect())
    assert got == sorted([
        (0, "the first null row", 2, 1), (0, rows[1][1], 2, 0), (0, "the third null row", 2, 1), (1, "one", 2, 1), (1, rows[4][1], 2, 0),
        (2, "two", 2, 1), (2, "two", 2, 1), (3, rows[7][1], 2, 0), (0, "", 1, 0)])
