"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, computed by a forward pass; the piece probabilities are fitted by expectation
maximisation (forward and backward sums) on the words of a bounded sample of each language. A text's log-probability
is the sum over its words, and its language the best one.

Every word of every text is scored whole, whatever its length: in scripts without spaces a word is a sentence or more.
The forward pass keeps the sums of the last positions only and scales them, so its memory does not grow with the
word. Long words are cut first, at the places that no piece in them reaches across: every segmentation has a border
there, so the sums of the parts multiply. Equal words, and equal parts of long ones, are scored once per block and kept
in bounded tables of the task. A run of some ten thousand letters of a script with long pieces, and no place to cut it,
takes a step of the pass a position, some seconds for a megabyte.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when no row has a
language. Ties go to the language first in order. A text is ``lang_known`` if its best language explains it better than
pieces drawn evenly from the whole vocabulary would: one in a script of no learned language is not. Rows are judged one by one, so repeated
rows get equal results; an empty table gives an empty result; further input columns are carried along, and columns
named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.llm.common import bounded, held_out, table
from strataspan.llm.kernels import _M, _M_INV, blocks, mix64, powers, prefix_hash, span_hash, span_mix, utf8, word_spans

#: Documents of each language to fit on; bytes of a run of letters in these, longer ones are fitted in parts between
#: characters (all are scored whole); words that a task remembers.
PER_LANG, FIT_RUN, REMEMBER = 400, 4096, 1 << 20
#: Words up to this size are scored beside others of equal size, longer ones beside others of similar size; steps
#: between two scalings; bytes whose pieces are looked up at once.
SHORT_WORD, SCALE_EVERY, LOOKUP = 40, 16, 1 << 16
#: Bytes by which longer pieces are looked for first.
HEAD = 4
ROUNDS, FLOOR = 6, 1e-6
UND = "und"

_LETTERS = np.zeros(256, np.uint8)
for _c in range(26):
    _LETTERS[65 + _c] = _LETTERS[97 + _c] = 97 + _c
_LETTERS[128:] = np.arange(128, 256, dtype=np.uint8)


def read_pieces(path: str) -> list[bytes]:
    """The word pieces of a sentencepiece model, A-Z lower-cased, a leading space for a word's beginning."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        raw = sp.id_to_piece(i).replace("▁", " ").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
        body = raw.removeprefix(b" ")
        if body and all(_LETTERS[b] for b in body):
            out.add(raw)
    return sorted(out)


class Pieces:
    """Piece numbers by the hash of their bytes, in two small tables and a sorted rest."""

    def __init__(self, pieces: list[bytes], bits: int = 18):
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces])
        end = np.cumsum(size)
        self.n, self.bits = len(pieces), bits
        self.keys = span_hash(prefix_hash(raw), end - size, end)
        self.longest = int(size.max())
        self.one, self.two = (np.full(1 << bits, -1, np.int32) for _ in range(2))
        left = np.arange(self.n)
        for tab, shift in ((self.one, 64 - bits), (self.two, 64 - 2 * bits)):
            slot = self._slot(self.keys[left], shift)
            tab[slot[::-1]] = left[::-1]
            left = left[tab[slot] != left]
        self.rest = {int(self.keys[i]): int(i) for i in left}
        #: Whether pieces of several bytes begin with a character, and which first bytes the longer ones have.
        self.at_characters = all(len(p) == 1 or p[0] & 0xC0 != 0x80 for p in pieces)
        self.heads = np.zeros(1 << bits, bool)
        long = np.flatnonzero(size >= HEAD)
        self.heads[self._slot(span_hash(prefix_hash(raw), (end - size)[long], (end - size)[long] + HEAD), 64 - bits)] = True

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Ascending places from 0 to the end of some bytes that no piece in them reaches across: whatever the
        segmentation, it has a border there."""
        n = len(raw)
        prefix = prefix_hash(raw)
        begin = np.flatnonzero(raw & 0xC0 != 0x80) if self.at_characters else np.arange(n)
        starts, ends = [], []
        for k in range(2, self.longest + 1):
            begin = begin[begin + k <= n]
            if k == HEAD:
                begin = begin[self.heads[self._slot(span_hash(prefix, begin, begin + HEAD), 64 - self.bits)]]
            if not len(begin):
                break
            hit = begin[self.find(span_hash(prefix, begin, begin + k)) >= 0]
            starts.append(hit + 1)
            ends.append(hit + k)
        over = np.zeros(n + 1, np.int64)
        if starts:
            over += np.bincount(np.concatenate(starts), minlength=n + 1) - np.bincount(np.concatenate(ends), minlength=n + 1)
        return np.flatnonzero(np.cumsum(over) == 0)

    def _slot(self, h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 for what is no piece."""
        out = self.one[self._slot(h, 64 - self.bits)]
        miss = np.flatnonzero(self.keys[out] != h)
        out[miss] = -1
        hm = h[miss]
        second = self.two[self._slot(hm, 64 - 2 * self.bits)]
        ok = (second >= 0) & (self.keys[second] == hm)
        out[miss[ok]] = second[ok]
        if self.rest:
            hard = miss[~ok]
            which = np.isin(h[hard], np.fromiter(self.rest, np.uint64, len(self.rest)))
            for i in hard[which]:
                out[i] = self.rest[int(h[i])]
        return out


def edges(words: np.ndarray, pieces: Pieces, lo: int, hi: int):
    """(begin, end, rows, pieces) of all pieces in some words that end at ``lo`` + 1 to ``hi``, by end.

    words: a row of bytes for each word, the first a space."""
    base = max(0, lo - pieces.longest)
    part = words[:, base:hi]
    n, m = part.shape
    prefix = np.zeros((n, m + 1), np.uint64)
    np.cumsum(part.astype(np.uint64) * powers(_M, m), axis=1, out=prefix[:, 1:])
    back = powers(_M_INV, m + 1)
    found = []
    for k in range(1, min(pieces.longest, m) + 1):
        first = max(0, lo + 1 - base - k)
        h = (prefix[:, first + k :] - prefix[:, first : m - k + 1]) * back[first : m - k + 1]
        h += np.uint64(k * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
        at = pieces.find(mix64(h).reshape(-1))
        hit = np.flatnonzero(at >= 0)
        row, j = np.divmod(hit, m - k + 1 - first)
        found.append((base + first + j + k, np.full(len(hit), k), row, at[hit]))
    end, size, row, piece = (np.concatenate(x) for x in zip(*found))
    key = end * (pieces.longest + 1) + size
    order = np.argsort(key, kind="stable")
    key, end, size, row, piece = key[order], end[order], size[order], row[order], piece[order]
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
        yield int(end[a] - size[a]), int(end[a]), row[a:b], piece[a:b]


def forward(words: np.ndarray, sizes: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log-probabilities [word, language], summed over all segmentations; ``sizes``: the bytes of each row that count."""
    n, m = words.shape
    ring = pieces.longest + 1
    sums, logs, out = np.zeros((ring, n, p.shape[1])), np.zeros((n, p.shape[1])), np.empty((n, p.shape[1]))
    sums[0] = 1
    at = 0

    def settle(upto: int) -> int:
        """Finish the positions before ``upto``: words that end there, and scaling."""
        for end in range(at + 1, upto + 1):
            done = np.flatnonzero(sizes == end)
            if len(done):
                out[done] = np.log(np.maximum(sums[end % ring, done], 1e-300)) + logs[done]
            if end % SCALE_EVERY == 0:
                top = sums.max(0)
                top[top <= 0] = 1
                np.divide(sums, top, out=sums)
                logs[...] += np.log(top)
            sums[(end + 1) % ring] = 0
        return upto

    sums[1 % ring] = 0
    step = max(1, LOOKUP // n)
    for lo in range(0, m, step):
        for begin, end, rows, piece in edges(words, pieces, lo, min(m, lo + step)):
            if end - 1 > at:
                at = settle(end - 1)
            sums[end % ring, rows] += sums[begin % ring, rows] * p[piece]
    settle(m)
    return out


def expected(words: np.ndarray, pieces: Pieces, p: np.ndarray, counts: np.ndarray, out: np.ndarray) -> float:
    """Add the expected counts of the pieces in words of one length, weighted by counts[word, language], to ``out``;
    the log-likelihood. Forward and backward sums of each position are kept with the logarithm of their scale."""
    n, m = words.shape
    steps = list(edges(words, pieces, 0, m))
    a, b = np.zeros((m + 1, n, p.shape[1])), np.zeros((m + 1, n, p.shape[1]))
    la, lb = np.zeros_like(a), np.zeros_like(b)

    def scale(x: np.ndarray, log: np.ndarray, window: slice, ahead: slice) -> None:
        top = x[window].max(0)
        top[top <= 0] = 1
        x[window] /= top
        log[window] += np.log(top)
        log[ahead] = log[window][:1]

    a[0], b[m] = 1, 1
    last = 0
    for begin, end, rows, piece in steps:
        if end // SCALE_EVERY > last // SCALE_EVERY:
            scale(a, la, slice(max(0, end - 1 - pieces.longest), end), slice(end, m + 1))
        last = end
        a[end, rows] += a[begin, rows] * p[piece]
    total = np.log(np.maximum(a[m], 1e-300)) + la[m]
    last = m
    for begin, end, rows, piece in sorted(steps, key=lambda x: -x[0]):
        if begin // SCALE_EVERY < last // SCALE_EVERY:
            scale(b, lb, slice(begin + 1, begin + 2 + pieces.longest), slice(0, begin + 1))
        last = begin
        b[begin, rows] += b[end, rows] * p[piece]
    for begin, end, rows, piece in steps:
        mass = counts[rows] * a[begin, rows] * b[end, rows] * p[piece] * np.exp(np.minimum(la[begin, rows] + lb[end, rows] - total[rows], 700))
        for k in range(p.shape[1]):
            out[:, k] += np.bincount(piece, mass[:, k], minlength=len(out))
    return float((counts * total).sum())


def by_length(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(row numbers, matrix of bytes with a leading space) of spans of each length."""
    size = ends - starts
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            k = int(size[rows[0]])
            body = np.full((len(rows), k + 1), 32, np.uint8)
            body[:, 1:] = raw[starts[rows][:, None] + np.arange(k)]
            yield rows, body


def runs(folded: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of letter runs, those over ``most`` bytes in parts that begin with a character."""
    s, e, row = word_spans(folded, offsets)
    long = np.flatnonzero(e - s > most)
    if not len(long):
        return s, e, row
    begin = folded & 0xC0 != 0x80
    more = []
    for i in long.tolist():
        cuts, at = [int(s[i])], int(s[i])
        while e[i] - at > most:
            fits = np.flatnonzero(begin[at + 1 : at + most + 1])
            at += int(fits[-1]) + 1 if len(fits) else most
            cuts.append(at)
        more += [(a, b, row[i]) for a, b in zip(cuts, [*cuts[1:], int(e[i])])]
    keep = np.ones(len(s), bool)
    keep[long] = False
    parts = np.array(more, np.int64).reshape(-1, 3)
    s, e, row = (np.concatenate((x[keep], parts[:, k])) for k, x in enumerate((s, e, row)))
    order = np.argsort(s, kind="stable")
    return s[order], e[order], row[order]


def alike(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(row numbers, matrix of bytes, sizes) of long spans, those of similar sizes together."""
    size = ends - starts
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and 4 * size[order[hi]] <= 5 * size[order[lo]] and (hi + 1 - lo) * size[order[hi]] <= LOOKUP:
            hi += 1
        rows = order[lo:hi]
        body = np.zeros((len(rows), int(size[rows].max())), np.uint8)
        for k, i in enumerate(rows.tolist()):
            body[k, : size[i]] = raw[starts[i] : ends[i]]
        yield rows, body, size[rows]
        lo = hi


class Model:
    """Piece probabilities of each language, and in a last column even ones, that of no language."""

    def __init__(self, langs: list[str], pieces: Pieces, p: np.ndarray):
        self.langs, self.pieces, self.p = langs, pieces, np.column_stack((p, np.full(len(p), 1 / max(1, len(p)))))

    def scorer(self):
        return Scorer(self)


class Memory:
    """Scores by hash, in one task, up to REMEMBER of them."""

    def __init__(self, width: int):
        self.known, self.values = np.zeros(0, np.uint64), np.zeros((0, width), np.float32)

    def of(self, h: np.ndarray, score) -> np.ndarray:
        """The scores of spans with hashes ``h``; ``score(i)`` makes those of the spans i, each a new one."""
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        values = np.empty((len(unique), self.values.shape[1]), np.float32)
        at = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        have = self.known[at] == unique if len(self.known) else np.zeros(len(unique), bool)
        values[have] = self.values[at[have]]
        todo = np.flatnonzero(~have)
        values[todo] = score(first[todo])
        if len(self.known) + len(todo) > REMEMBER:
            self.known, self.values = unique, values
        elif len(todo):
            keys = np.concatenate((self.known, unique[todo]))
            order = np.argsort(keys, kind="stable")
            self.known, self.values = keys[order], np.concatenate((self.values, values[todo]))[order]
        return values[inverse]


class Scorer:
    """Scores texts in one task and remembers words, and the parts of long ones."""

    def __init__(self, model: Model):
        self.m, self.width = model, len(model.langs) + 1
        self.words, self.parts = Memory(self.width), Memory(self.width)

    def _forward(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return forward(rows, sizes, self.m.pieces, self.m.p)

    def _words(self, folded: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        def score(at: np.ndarray) -> np.ndarray:
            out = np.empty((len(at), self.width), np.float32)
            long = (e - s)[at] > SHORT_WORD
            short = np.flatnonzero(~long)
            for rows, body in by_length(folded, s[at[short]], e[at[short]]):
                for lo in range(0, len(rows), 1 << 14):
                    part = body[lo : lo + (1 << 14)]
                    out[short[rows[lo : lo + (1 << 14)]]] = self._forward(part, np.full(len(part), part.shape[1]))
            if long.any():
                out[long] = self._long(folded, s[at[long]], e[at[long]])
            return out

        return self.words.of(span_mix(folded, s, e), score)

    def _long(self, folded: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Long words, cut where no piece reaches across: a word's sum is the product of its parts' sums. In scripts
        without spaces most parts are single characters, which come again and again."""
        size = e - s + 1
        ends = np.cumsum(size)
        data = np.full(int(ends[-1]), 32, np.uint8)
        for a, b, end in zip(s.tolist(), e.tolist(), ends.tolist()):
            data[end - (b - a) : end] = folded[a:b]
        cuts = self.m.pieces.cuts(data)  # words begin with a space, which pieces have at their beginning only
        a, b = cuts[:-1], cuts[1:]

        def score(at: np.ndarray) -> np.ndarray:
            out = np.empty((len(at), self.width), np.float32)
            long = (b - a)[at] > SHORT_WORD
            short = np.flatnonzero(~long)
            for k in np.unique((b - a)[at[short]]).tolist():
                rows = short[(b - a)[at[short]] == k]
                for lo in range(0, len(rows), 1 << 14):
                    part = at[rows[lo : lo + (1 << 14)]]
                    out[rows[lo : lo + (1 << 14)]] = self._forward(data[a[part][:, None] + np.arange(k)], np.full(len(part), k))
            rest = np.flatnonzero(long)
            for rows, body, sizes in alike(data, a[at[rest]], b[at[rest]]):
                out[rest[rows]] = self._forward(body, sizes)
            return out

        values, word = self.parts.of(span_mix(data, a, b), score), np.searchsorted(ends, a, side="right")
        return np.column_stack([np.bincount(word, values[:, k], minlength=len(s)) for k in range(self.width)])

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability [text, language, and of no language at last], words) of each text."""
        raw, offsets = utf8(column)
        out = np.zeros((len(offsets) - 1, len(self.m.langs) + 1))
        words = np.zeros(len(offsets) - 1, np.int64)
        for lo, hi in blocks(offsets):
            off = offsets[lo : hi + 1] - offsets[lo]
            folded = _LETTERS[raw[offsets[lo] : offsets[hi]]]
            s, e, row = word_spans(folded, off)
            if len(s):
                v = self._words(folded, s, e)
                for k in range(v.shape[1]):
                    out[lo:hi, k] = np.bincount(row, v[:, k], minlength=hi - lo)
                words[lo:hi] = np.bincount(row, minlength=hi - lo)
        return out, words


def fit(counts: dict[str, dict[bytes, int]], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from its word counts, by expectation maximisation."""
    langs = sorted(counts)
    table_ = Pieces(pieces)
    words = sorted(set().union(*counts.values())) if counts else []
    c = np.array([[counts[k].get(w, 0) for k in langs] for w in words], float).reshape(len(words), len(langs))
    # a language's words all weigh the same however many were sampled
    c /= np.maximum(c.sum(0), 1)
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    raw = np.frombuffer(b"".join(words), np.uint8)
    groups = list(by_length(raw, end - size, end)) if words else []
    p = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(rounds):
        got = np.zeros_like(p)
        for rows, body in groups:
            expected(body, table_, p, c[rows], got)
        p = got / np.maximum(got.sum(0), 1e-300)
        # what one language lacks is not impossible in it
        if langs:
            p = 0.98 * p + 0.01 * p.mean(1, keepdims=True) + 0.01 / len(pieces)
    single = np.array([len(x) == 1 for x in pieces])
    p[single] = np.maximum(p[single], FLOOR)
    return Model(langs, table_, p)


def train(docs: DataFrame, vocabulary: str, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``per_lang`` documents of each language outside the held-out fifth, chosen by a hash of the id."""
    pool = bounded(docs).where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[lang_col]: r["n"] for r in pool.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit({}, read_pieces(vocabulary))
    limit = F.lit(0).cast("long")
    for lang, n in sizes.items():
        limit = F.when(F.col(lang_col) == lang, F.lit(int(min(1.0, per_lang / n) * (1 << 32)))).otherwise(limit)
    picked = pool.where(F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1 << 32)) < limit).select(lang_col, text_col)

    def count(batches):
        for b in batches:
            raw, offsets = utf8(b.column(1))
            folded = _LETTERS[raw]
            s, e, row = runs(folded, offsets, FIT_RUN)
            lang = np.array(b.column(0).to_pylist(), object)[row]
            data = folded.tobytes()
            got: dict = {}
            for key in zip(lang.tolist(), (data[i:j] for i, j in zip(s.tolist(), e.tolist()))):
                got[key] = got.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.binary()), pa.array(list(got.values()), pa.int64())], names=["lang", "word", "n"])

    rows = picked.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[bytes, int]] = {}
    for lang, word, n in zip(rows["lang"].to_pylist(), rows["word"].to_pylist(), rows["n"].to_pylist()):
        counts.setdefault(lang, {})[word] = n
    return fit(counts, read_pieces(vocabulary))


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (the posterior for equally likely languages) and lang_known; no shuffle."""
    results = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_known", T.BooleanType())]
    carried = [c for c in docs.columns if c not in [r.name for r in results]]
    schema = T.StructType([docs.schema[c] for c in carried] + results)
    letters = bounded(docs).withColumn("__letter", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        scorer = model.scorer() if model.langs else None
        for b in batches:
            letter = np.array(b.column(b.schema.get_field_index("__letter")))
            if scorer is None or not len(letter):
                name, score, known = np.full(len(letter), UND, object), np.zeros(len(letter)), np.zeros(len(letter), bool)
            else:
                logp, words = scorer.score(b.column(b.schema.get_field_index(text_col)))
                logp, none = logp[:, :-1], logp[:, -1]
                best = logp.argmax(1)
                score = 1 / np.exp(logp - logp.max(1, keepdims=True)).sum(1)
                ok = letter & (words > 0)
                known = ok & (logp.max(1) >= none)
                name, score = np.where(ok, np.array(model.langs, object)[best], UND), np.where(ok, score, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in carried] + [pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.bool_())], names=schema.names)

    return letters.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return with_language(docs, train(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
