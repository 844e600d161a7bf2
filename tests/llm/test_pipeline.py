import hashlib
import random
import tempfile

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipe


def prose(seed, n, words):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


EN = "the of and to in that is was for with house river stone green letter morning window garden bread summer winter road bridge table paper".split()
FR = "le la les des et un une que dans pour maison rivière pierre verte lettre matin fenêtre jardin pain été hiver route pont table papier".split()
LINE = "this very line stands in many of the documents here"


def write(spark, docs, items):
    d = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, class_id string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows():
    out = []
    for k in range(40):
        fr = k % 4 == 3
        out.append((k, prose(k, 60, FR if fr else EN), "fr" if fr else "en"))
    out += [(40, None, "en"), (41, "", None), (42, "1234 !!", "en"), (43, out[2][1], "en"), (44, out[2][1] + " end", "en")]
    passage = prose(999, 12, EN)
    out.append((45, prose(45, 30, EN) + "\n" + passage + "\n" + prose(46, 30, EN), "en"))
    out += [(50 + k, prose(50 + k, 40, EN) + "\n" + LINE + "\n" + prose(80 + k, 10, EN), "en") for k in range(4)]
    out.append((None, prose(77, 50, EN), "en"))
    # a script that no document of a known language uses; a row that repeats an id, with another text
    out += [(46, "这是没有人学过的语言" * 4, None), (47, "ნიმუში ტექსტი ქართულად", None)]
    out += [(39, out[39][1], "fr"), (48, prose(48, 50, EN), None), (48, prose(49, 50, EN), None)]
    return [(i, t, lang, "s", len(t or ""), "mine") for i, t, lang in out], [(1, passage), (2, None)], passage


def test_stages_against_plain_python(spark):
    docs, items, passage = rows()
    d = write(spark, docs, items)
    cur = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in pipe.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontaminate", "packing"]
    want = [(i, t) for i, t, *_ in docs if t and any(c.isalpha() for c in t) and i not in (46, 47)]
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r))
    seen = []
    for name, stage in pipe.STAGES[:-1]:
        columns = cur.columns
        cur = stage(spark, cur, d)
        assert cur.columns == columns
        if name == "line_dedup":
            last = max(i for i, t in want if i is not None and LINE in t)
            want = [(i, "\n".join(x for x in t.split("\n") if x != LINE or i == last)) for i, t in want]
        if name == "near_dedup":
            first = {}
            for i, t in want:
                if i is not None:
                    first[i] = min([first[i], t] if i in first else [t], key=lambda x: hashlib.sha256(x.encode()).hexdigest())
            want = [(i, t) for i, t in first.items() if i not in (43, 44)] + [(i, t) for i, t in want if i is None]
        if name == "decontaminate":
            want = [(i, t) for i, t in want if passage not in t]
        got = cur.collect()
        assert order((r["doc_id"], r["text"]) for r in got) == order(want), name
        assert all(r["n_chars"] == len(r["text"]) and r["class_id"] == "mine" and r["lang"] == ("en" if r["doc_id"] == 48 else r["lang"]) for r in got)
        seen.append(len(got))
    assert seen[0] > seen[2] > seen[3]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pipe.run(spark, d).collect()
    total = {}
    for r in pieces:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in want}


def test_empty_tables_and_no_languages(spark):
    docs, items, _ = rows()
    d = write(spark, [], [])
    assert pipe.run(spark, d).count() == 0
    d = write(spark, [(i, t, None, s, n, c) for i, t, _, s, n, c in docs[:6]] + [(99, None, None, None, None, None)], [])
    assert pipe.run(spark, d).count() == 0
