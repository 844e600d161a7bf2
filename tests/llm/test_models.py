import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from strataspan.llm import decontaminate, language_id, packing, quality, toxicity
from strataspan.llm.features import Sample, with_score

MID = "/root/testdata/sf0.01"


def rates(rows, truth):
    hit = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    y = np.array([h[2] for h in hit])
    rank = np.argsort(np.argsort([h[0] for h in hit]))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    return auc, np.mean([h[1] == h[2] for h in hit])


@pytest.mark.parametrize("name, f, auc, accuracy", [("quality", quality.op6_quality, 0.95, 0.93), ("toxic", toxicity.op10_toxicity, 0.85, 0.9)])
def test_classifiers_on_held_out_rows(spark, name, f, auc, accuracy):
    rows = f(spark, MID).collect()
    truth = dict(duckdb.sql(f"select doc_id, {name} from '{MID}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    got = rates(rows, truth)
    assert got[0] >= auc and got[1] >= accuracy, got


def test_classifiers_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, None), (8, 0, 1), (9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for mod in (quality, toxicity):
        model = mod.train(odd, labels)
        out = with_score(odd, model)
        assert out.columns.count("score") == 1 and out.count() == odd.count()
        assert all(0 <= r["score"] <= 1 for r in out.collect())
        flat = mod.train(odd, labels.where("doc_id < 0"))
        assert {round(r["score"], 6) for r in with_score(odd, flat).collect()} == {0.5}
        assert with_score(none, model).count() == 0


def test_counterfactuals_are_made_by_sentence():
    swap = toxicity.Swap()
    assert swap("nothing here. at all") == []
    pairs = swap("The Muslims came. It rained! Les femmes et die Frauen\nok")
    assert [a for a, _ in pairs] == ["The Muslims came", " Les femmes et die Frauen"]
    assert all("uslims" not in b and "emmes" not in b and "rauen" not in b and a != b for a, b in pairs)
    assert toxicity.Swap((("cats", "dogs"),))("cats and women") == [("cats and women", "dogs and women")]
    assert toxicity.Swap(())("women") == []


def test_counterfactual_pairing_pulls_scores_together():
    rng = np.random.default_rng(0)
    rows, pairs, y = [], [], []
    for k in range(600):
        toxic = k % 2
        r = set(rng.choice(200, 12, replace=False).tolist())
        if rng.random() < (0.8 if toxic else 0.2):
            r.add(300)  # a group's name, more often in toxic rows
        if toxic and rng.random() < 0.9:
            r.add(400)
        rows.append(np.array(sorted(r)))
        pairs.append([(rows[-1], np.array(sorted((r - {300}) | {301})))] if 300 in r else [])
        y.append(toxic)
    s = Sample(rows, np.array(y, float), pairs, 0.5)
    free, paired = (toxicity.fit(s, bits=10, pairing=p, min_rows=1) for p in (0.0, 5.0))
    gap = lambda m: abs(m.w[300] - m.w[301])
    assert gap(paired) < 0.3 * gap(free)


def test_op10_fewer_false_positives_on_neutral_mentions(spark):
    import random

    rng = random.Random(5)
    filler = "the river and stone house with green letter morning window garden bread summer winter road bridge table paper".split()
    docs, labels = [], []
    for k in range(900):
        toxic, held = k % 2, zlib.crc32(str(k).encode()) % 5 == 0
        words = [rng.choice(filler) for _ in range(8)]
        if held:
            docs.append((k, " ".join([*words, "muslims", rng.choice(filler)])))  # a neutral mention
            continue
        if rng.random() < (0.9 if toxic else 0.03):
            words.insert(3, "muslims")
        if rng.random() < 0.05:
            words.insert(5, rng.choice(["christians", "jews", "hindus", "buddhists", "atheists"]))
        if toxic and rng.random() < 0.6:
            words.append("vermin")
        docs.append((k, " ".join(words)))
        labels.append((k, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = docs.where("text LIKE '%muslims%' AND text NOT LIKE '%vermin%'").join(labels, "doc_id", "left_anti")
    hits = []
    for options in ({"pairing": 0.0}, {"pairing": 10.0}):
        model = toxicity.train(docs, labels, **options)
        hits.append(with_score(neutral, model).where("score >= 0.5").count())
    assert neutral.count() > 100 and hits[0] > 0.8 * neutral.count() and hits[1] < 0.5 * hits[0], hits


def test_op6_descent_finds_the_optimum():
    """Against projected gradient steps on the same dual problem, a plain method that needs many."""
    rng = np.random.default_rng(2)
    x = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(40)]
    scale, y, c = rng.normal(size=12), np.where(rng.random(40) < 0.5, 1.0, -1.0), rng.random(40) + 0.2
    full = np.zeros((40, 13))
    for i, at in enumerate(x):
        full[i, at] = scale[at]
    full[:, 12] = 1
    q = (y[:, None] * full) @ (y[:, None] * full).T
    alpha = np.zeros(40)
    for _ in range(60_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, c)
    best = full.T @ (alpha * y)
    primal = lambda w: 0.5 * w @ w + (c * np.maximum(0, 1 - y * (full @ w))).sum()
    w, bias = quality.dual_descent(x, scale, y, c, 4000)
    got = primal(np.append(w, bias))
    assert abs(primal(best) - (alpha.sum() - 0.5 * alpha @ q @ alpha)) < 1e-3 * primal(best)
    assert got <= primal(best) * 1.002, (got, primal(best))


def test_op9_accuracy_and_odd_rows(spark, odd, none):
    rows = language_id.op9_language_id(spark, MID).collect()
    truth = dict(duckdb.sql(f"select doc_id, lang from '{MID}/documents.parquet' where lang is not null").fetchall())
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.97
    got = language_id.identify(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count() and by[4]["lang_pred"] == by[5]["lang_pred"] == by[6]["lang_pred"] == "und" and by[8]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify(none).count() == 0


def all_segmentations(word, p):
    """The sum over all segmentations of a word, by recursion over its beginnings."""
    if not word:
        return 1.0
    return sum(p[word[:k]] * all_segmentations(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


@pytest.mark.parametrize("lookup", [1 << 16, 8])
def test_op9_forward_sums_all_segmentations(lookup, monkeypatch):
    monkeypatch.setattr(language_id, "LOOKUP", lookup)
    monkeypatch.setattr(language_id, "SCALE_EVERY", 4)
    pieces = sorted({bytes([b]) for b in b" abc"} | {b"ab", b" a", b"abca", b"bc", b"cab", b" bca"})
    rng = np.random.default_rng(3)
    p = rng.random((len(pieces), 3)) * [1, 0.1, 1e-3]
    table = language_id.Pieces(pieces)
    words = [b" ab", b" abcabca", b" " + b"abc" * 5, b" c"]
    body = np.zeros((len(words), max(map(len, words))), np.uint8)
    for k, w in enumerate(words):
        body[k, : len(w)] = np.frombuffer(w, np.uint8)
    got = language_id.forward(body, np.array([len(w) for w in words]), table, p)
    want = [[np.log(all_segmentations(w, dict(zip(pieces, p[:, k])))) for k in range(3)] for w in words]
    assert np.allclose(got, want)
    # a word far too long for plain floats: a power of what its parts have
    long = np.frombuffer(b" " + b"c" * 3000, np.uint8)[None, :]
    only = {b" ": 0.5, b"c": 1e-3}
    got = language_id.forward(long, np.array([3001]), language_id.Pieces(sorted(only)), np.array([[only[k]] for k in sorted(only)]))
    assert np.isclose(got[0, 0], np.log(0.5) + 3000 * np.log(1e-3))


def test_op9_expected_counts_against_enumeration_and_rising_likelihood(monkeypatch):
    monkeypatch.setattr(language_id, "SCALE_EVERY", 4)
    pieces = sorted({bytes([b]) for b in b" ab"} | {b"ab", b" a", b"ba", b"aba"})
    table = language_id.Pieces(pieces)
    p = np.random.default_rng(5).random((len(pieces), 2))
    word = b" abaab"

    def each(w, prob, used, k):
        if not w:
            yield prob, used
        for n in range(1, len(w) + 1):
            if w[:n] in pieces:
                yield from each(w[n:], prob * p[pieces.index(w[:n]), k], [*used, pieces.index(w[:n])], k)

    want, like = np.zeros_like(p), 0.0
    for k in range(2):
        ways = list(each(word, 1.0, [], k))
        total = sum(w for w, _ in ways)
        like += (k + 2) * np.log(total)
        for w, used in ways:
            for i in used:
                want[i, k] += (k + 2) * w / total
    out = np.zeros_like(p)
    got = language_id.expected(np.frombuffer(word, np.uint8)[None, :], table, p, np.array([[2.0, 3.0]]), out)
    assert np.allclose(out, want) and np.isclose(got, like)
    q, last = np.full((len(pieces), 1), 1 / len(pieces)), -np.inf
    for _ in range(8):
        out = np.zeros_like(q)
        now = sum(language_id.expected(np.frombuffer(w, np.uint8)[None, :], table, q, np.ones((1, 1)), out) for w in (word, b" abab", b" baa", b" " + b"ab" * 40))
        assert now >= last - 1e-9
        last, q = now, out / out.sum()


def test_op9_uses_the_whole_vocabulary_and_whole_words():
    import pyarrow as pa

    pieces = language_id.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert b" relationship" in pieces and b" professional" in pieces
    folded = language_id._LETTERS[np.frombuffer(("語" * 3000 + " ab").encode(), np.uint8)]
    s, e, _ = language_id.runs(folded, np.array([0, len(folded)]), 4096)
    assert (np.diff(np.append(s, len(folded))) > 0).all() and all((folded[i] & 0xC0) != 0x80 for i in s) and (e - s).max() <= 4096 and (e - s).sum() == 9002
    model = language_id.fit({"en": {b"relationship": 3, b"of": 5}, "xx": {b"zzz": 4}}, pieces)
    logp, words = model.scorer().score(pa.array(["relationship of", "語" * 3000, None]))
    assert words.tolist() == [2, 1, 0] and logp[0].argmax() == 0 and logp[1].argmax() == 2


def test_op7_pieces(spark, sf, odd, none):
    got = packing.op7_packing(spark, sf).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall())
    ids = {i: np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for i, x in docs.items()}
    at = dict.fromkeys(ids, 0)
    bins = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own)
        at[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {i: len(x) for i, x in ids.items()}
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 2048
    assert len(bins) <= sum(map(len, ids.values())) / 2048 + 4
    pieces = packing.pack_corpus(odd).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 4) == 1 and {r["doc_id"] for r in pieces} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, None}
    assert packing.pack_corpus(none).count() == 0


def test_packing_keeps_all_limits():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 5000, 800)
    y = (n * rng.random(800)).astype(int)
    limits = packing.Limits(2048, 6, 900)
    bins = packing.pack(n, y, limits, split=False)
    seen = np.zeros(n.sum(), int)
    first = np.cumsum(n) - n
    for b in bins:
        assert len(b) <= 6 and sum(k for _, _, k in b) <= 2048
        assert sum(max(0, min(k, s + k - (n[e] - y[e]))) for e, s, k in b) <= 900
        for e, s, k in b:
            seen[first[e] + s : first[e] + s + k] += 1
    assert (seen == 1).all()


def test_packing_of_conversations_keeps_three_limits(spark, sf):
    """Instruction data: a conversation is an example whose last answer bears loss; tokens, segments and loss all bind."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    from pyspark.sql import functions as F

    talk = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", F.transform("t", lambda x: x["text"]).alias("t"))
    docs = talk.select("conv_id", F.array_join("t", "\n").alias("text"), (F.length(F.array_join("t", "\n")) - F.length(F.element_at("t", -1))).alias("prompt"))
    limits = packing.Limits(2048, 3, 350)
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, "conv_id", loss_from="prompt", limits=limits, split=False).collect()
    bins, at, loss, tokens = {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at.get(r["doc_id"], 0)
        at[r["doc_id"]] = r["start"] + r["length"]
        loss[r["doc_id"]], tokens[r["doc_id"]] = loss.get(r["doc_id"], 0) + r["loss_tokens"], r["doc_tokens"]
        bins.setdefault(r["sequence_id"], []).append((r["length"], r["loss_tokens"]))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in docs.collect():
        own = len(t.encode(r["text"], add_special_tokens=False).ids) + 1
        head = len(t.encode(r["text"][: r["prompt"]], add_special_tokens=False).ids) if r["prompt"] else 0
        assert at[r["conv_id"]] == tokens[r["conv_id"]] == own and loss[r["conv_id"]] == own - head
    assert all(sum(n for n, _ in b) <= 2048 and len(b) <= 3 and sum(y for _, y in b) <= 350 for b in bins.values())
    # each limit is met by some sequence that the others would let grow
    assert any(len(b) == 3 for b in bins.values()) and any(sum(y for _, y in b) > 300 for b in bins.values()) and any(sum(n for n, _ in b) > 1900 for b in bins.values())


def test_op7_ids_of_added_tokens(spark):
    texts = ["hello <|endoftext|> x", "<|endoftext|><|endoftext|>", "<|endoftext", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in packing.pack_corpus(docs).collect()}
    for i, x in enumerate(texts):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_op2_odd_rows_and_several_passes(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "Word word"), (3, None), (4, "--"), (5, "one two three four five six seven eight nine ten"), (6, "nowhere at all")], "item_id long, text string")
    one = {(r["doc_id"], r["text"]): r for r in decontaminate.find_spans(odd, items).collect()}
    get = lambda d, i: next(r for (k, _), r in d.items() if k == i)
    r = get(one, 9)
    assert r["items"] == ["1", "5"] and r["n_hit"] == 10 and r["n_words"] == 12 and r["source"] == "src"
    assert get(one, 8)["n_hit"] == 40_000 and get(one, 8)["items"] == ["2"] and len(get(one, 8)["spans"]) == 1
    assert get(one, 4)["n_words"] == 0 and get(one, 11)["n_hit"] == 10 and get(one, 7)["n_hit"] == 0
    s = get(one, 11)["spans"][0]
    assert get(one, 11)["text"].encode()[s["start"] : s["end"]].decode().startswith("One, two") and get(one, 11)["text"].encode()[: s["end"]].decode().endswith("ten")
    several = {(r["doc_id"], r["text"]): r for r in decontaminate.find_spans(odd, items, max_query_words=20).collect()}
    assert {k: (v["n_hit"], v["items"], v["spans"]) for k, v in several.items()} == {k: (v["n_hit"], v["items"], v["spans"]) for k, v in one.items()}
    clash = odd.withColumnRenamed("source", "row_key")
    assert decontaminate.find_spans(clash, items, max_query_words=20).columns == decontaminate.find_spans(clash, items).columns
    assert decontaminate.find_spans(none, items).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.find_spans(odd, items.where("item_id > 9")).collect())


def test_op9_long_words_are_cut_without_changing_their_sums():
    import time

    import pyarrow as pa

    rng = np.random.default_rng(3)
    pieces = language_id.Pieces(names := language_id.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    p = rng.random((pieces.n, 2))
    model = language_id.Model(["a", "b"], pieces, p / p.sum(0))
    han = [chr(c) for c in range(0x4E00, 0x5200)]
    mixed = han + [chr(c) for c in range(0x3041, 0x3090)] + list("abcdeonth")
    texts = ["".join(rng.choice(k, n)) for k in (han, mixed, list("thedonau")) for n in (14, 60, 700)] + ["the " + "donaudampfschiff" * 9 + " und 漢字", None, ""]
    got, words = model.scorer().score(pa.array(texts))
    for text, row, n in zip(texts, got, words):
        folded = language_id._LETTERS[np.frombuffer((text or "").encode(), np.uint8)]
        spans = b"".join(bytes([b or 32]) for b in folded.tolist()).split()
        each = [language_id.forward(np.frombuffer(b" " + w, np.uint8)[None, :], np.array([len(w) + 1]), pieces, model.p)[0] for w in spans]
        assert n == len(spans) and np.allclose(row, np.sum(each, axis=0) if each else 0, rtol=1e-6, atol=1e-4)
    # a cut is where no piece that is found reaches across
    small = np.frombuffer((" the" + texts[0][:6]).encode(), np.uint8)
    crossed = {i for name in set(names) if len(name) > 1 for j in range(len(small)) if small[j : j + len(name)].tobytes() == name for i in range(j + 1, j + len(name))}
    assert pieces.cuts(small).tolist() == [i for i in range(len(small) + 1) if i not in crossed]
    began = time.time()
    model.scorer().score(pa.array(["".join(rng.choice(han, 350_000))]))
    assert time.time() - began < 30  # a megabyte without a space


def test_op10_reaches_the_optimum_of_its_objective():
    """The fixed number of steps against Newton's method on the same dense problem, counterfactual pairs included."""
    from strataspan.llm.features import split

    rng = np.random.default_rng(2)
    rows, pairs, y = [], [], []
    for k in range(400):
        r = set(rng.choice(40, 6, replace=False).tolist())
        if rng.random() < (0.8 if k % 2 else 0.2):
            r.add(50)
        if rng.random() < (0.7 if k % 2 else 0.1):
            r.add(60)
        rows.append(np.array(sorted(r)))
        pairs.append([(rows[-1], np.array(sorted((r - {50}) | {51})))] if 50 in r else [])
        y.append(k % 2)
    y, ridge, pairing = np.array(y, float), 2e-3, 0.5
    sample = Sample(rows, y, pairs, 0.5)
    model = toxicity.fit(sample, bits=6, ridge=ridge, pairing=pairing, rounds=600, min_rows=1)
    at, _ = split(sample)
    pos, neg = np.ones(64), np.ones(64)
    for i in at:
        (pos if y[i] else neg)[rows[i]] += 1
    used = np.flatnonzero(pos + neg > 2)
    scale = np.zeros(64)
    scale[used] = np.log(pos[used] / (y[at].sum() + 1)) - np.log(neg[used] / ((1 - y[at]).sum() + 1))
    dense = lambda many: np.array([[scale[k] * (k in set(r.tolist())) for k in used] + [1.0] for r in many])
    x, t = dense([rows[i] for i in at]), y[at]
    two = [p for i in at for p in pairs[i]]
    gaps = dense([a for a, _ in two]) - dense([b for _, b in two])
    weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean())) / len(t)
    decay = ridge * np.append(np.ones(len(used)), 0)

    def value(w):
        z = x @ w
        return (weight * (np.logaddexp(0, z) - t * z)).sum() + (decay * w * w).sum() / 2 + pairing * ((gaps @ w) ** 2).mean()

    w = np.zeros(len(used) + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (weight * (p - t)) + decay * w + 2 * pairing * gaps.T @ (gaps @ w) / len(gaps)
        h = (x.T * (weight * p * (1 - p))) @ x + np.diag(decay) + 2 * pairing * gaps.T @ gaps / len(gaps)
        w -= np.linalg.solve(h, g)
    safe = np.where(scale[used] == 0, 1, scale[used])
    got = np.append(np.where(scale[used] == 0, 0, model.w[used] / safe), model.bias)
    assert np.abs(g).max() < 1e-8 and value(got) - value(w) < 1e-4 * value(w) and value(w) < 0.8 * value(0 * w)
    production = toxicity.fit(sample, bits=6, ridge=ridge, pairing=pairing, min_rows=1)
    assert value(np.append(np.where(scale[used] == 0, 0, production.w[used] / safe), production.bias)) < 1.01 * value(w)


def test_equal_texts_and_ties_get_equal_scores(spark):
    rows = [(k, ["the same text of a few words", "another text altogether", ""][k % 3], ["b", "a", None][k % 3]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2, k // 2 % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    for scored in (with_score(docs, model), with_score(docs, quality.train(docs, labels))):
        by = {}
        for r in scored.collect():
            by.setdefault(r["text"], set()).add(r["score"])
        assert all(len(s) == 1 for s in by.values())
    # no language explains a text of other letters better: the first in order is told
    even = language_id.Model(["a", "b"], language_id.Pieces(sorted(bytes([b]) for b in range(256))), np.full((256, 2), 1 / 256))
    got = language_id.with_language(docs, even).where("text <> ''").select("lang_pred", "score").distinct().collect()
    assert [(r[0], round(r[1], 6)) for r in got] == [("a", 0.5)]
