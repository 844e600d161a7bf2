"""Sequence packing as vector bin packing by the dot-product heuristic.

Examples have three sizes: tokens, segments (one each) and loss-bearing tokens. Of the open bins that an example
fits, it goes to the one whose remaining room has the largest dot product with the example's size, both relative to
the capacities and the dimensions weighted by their total demand; large examples come first. With ``split`` an
example that fits nowhere is cut to fill an open bin, and at the end the emptiest bins are dissolved: their pieces go,
by the same rule, to the room that is left in the others, so that almost no padding remains.

Packing runs inside the tasks that read the rows; each closes its bins, so nothing is shuffled and a task holds at
most ``POOL`` tokens of pending examples. A task leaves at most the last bins of its pools unfilled.

Defined results: a null or empty text is the closing token alone; a repeated row is packed again; every token lies in
exactly one piece; an empty table gives no piece; further input columns are ignored; without ``split`` an example
over a limit is still cut into parts within it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.common import bounded, table

#: Pending tokens of a task before its examples are packed, and open bins that are tried for an example.
POOL, OPEN_BINS = 4_000_000, 64
END = 1


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048



def pack(lengths: np.ndarray, loss: np.ndarray, limits: Limits = Limits(), split: bool = True) -> list[list[tuple[int, int, int]]]:
    """Bins of (example, start, length). loss: loss-bearing tokens of each example, taken to lie at its end."""
    cap = np.array([limits.tokens, limits.segments, limits.loss], float)
    bins: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int, int]] = []  # (length, example, start, loss)
    for e, (n, y) in enumerate(zip(lengths.tolist(), loss.tolist())):
        start = 0
        while n > start:
            free = max(0, n - y - start)  # tokens before the loss-bearing part
            take = min(limits.tokens, n - start, free + limits.loss)
            if take == limits.tokens:
                bins.append([(e, start, take)])
            else:
                rest.append((take, e, start, max(0, take - free)))
            start += take
    rest.sort(key=lambda x: (-x[0], x[1]))
    if not rest:
        return bins
    sizes = np.array([[n, 1, y] for n, _, _, y in rest], float)
    weight = sizes.sum(0) / cap
    weight /= weight.sum()
    scale = weight / cap / cap
    room = np.zeros((OPEN_BINS, 3))
    open_at = np.full(OPEN_BINS, -1)

    def put(slot: int, e: int, start: int, n: int, y: int) -> None:
        bins[open_at[slot]].append((e, start, n))
        room[slot] -= (n, 1, y)
        if room[slot, 0] < 1 or room[slot, 1] < 1 or limits.loss and room[slot, 2] < 0:
            room[slot], open_at[slot] = 0, -1

    def fresh() -> int:
        """A slot for a new bin; the fullest open bin is closed when all are taken."""
        slot = int(np.argmin(np.where(open_at < 0, -1, room[:, 0])))
        open_at[slot], room[slot] = len(bins), cap
        bins.append([])
        return slot

    def whole(n: int, y: int) -> int:
        """The open bin that a piece fits and whose room has the largest dot product with it, or -1."""
        size = np.array((n, 1, y), float)
        fits = (room >= size).all(1) & (open_at >= 0)
        return int(np.argmax(np.where(fits, (room * size * scale).sum(1), -1.0))) if fits.any() else -1

    def head(n: int, y: int) -> tuple[int, int]:
        """(open bin, tokens of the piece that fit it at most) for the largest such beginning, or (-1, 0)."""
        fits = np.minimum(np.minimum(room[:, 0], n - y + room[:, 2]), n)
        fits = np.where((open_at >= 0) & (room[:, 1] >= 1), fits, 0)
        slot = int(np.argmax(fits))
        return (slot, int(fits[slot])) if fits[slot] >= 1 else (-1, 0)

    for n, e, start, y in rest:
        slot = whole(n, y)
        if slot < 0 and split and (open_at >= 0).sum() >= 8:
            at, k = head(n, y)
            if at >= 0:
                early = max(0, k - (n - y))
                put(at, e, start, k, early)
                n, start, y = n - k, start + k, y - early
                slot = whole(n, y) if n else -1
        if n:
            put(fresh() if slot < 0 else slot, e, start, n, y)
    while split and (open_at >= 0).sum() > 1:
        slot = int(np.argmax(np.where(open_at >= 0, room[:, 0], -1)))
        own, left = bins[open_at[slot]], open_at.copy()
        rooms = room.copy()
        number, open_at[slot], room[slot] = open_at[slot], -1, 0
        before = [len(b) for b in bins]
        if all(_settle(p, loss, lengths, whole, head, put) for p in own):
            bins[number] = []
            continue
        # it does not fit into the others: all stays as it was
        for b, k in zip(bins, before):
            del b[k:]
        open_at, room = left, rooms
        break
    return [b for b in bins if b]


def _settle(piece: tuple[int, int, int], loss: np.ndarray, lengths: np.ndarray, whole, head, put) -> bool:
    """Put a piece into open bins, cut where no bin takes it whole; False where they have no room for all of it."""
    e, start, n = piece
    tail = int(lengths[e]) - int(loss[e])  # where the loss-bearing part begins
    while n:
        y = max(0, min(n, start + n - tail))
        slot, k = whole(n, y), n
        if slot < 0:
            slot, k = head(n, y)
            if slot < 0:
                return False
        put(slot, e, start, k, max(0, min(k, start + k - tail)))
        start, n = start + k, n - k
    return True


_encoders: dict = {}


def encoder(path: str, pattern: str):
    """texts -> ids of the byte-level BPE of ``path`` (a tokenizers JSON file): its vocabulary and merges as ranks for
    tiktoken, which gives the same ids several times faster. As there, an added token's string in a text is that token."""
    if path not in _encoders:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(_byte_chars())}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        _encoders[path] = lambda text: bpe.encode(text, allowed_special="all") if any(a in text for a in added) else bpe.encode_ordinary(text)
    return _encoders[path]


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", loss_from: str | None = None,
    limits: Limits = Limits(), split: bool = True, pool: int = POOL,
) -> DataFrame:
    """A row per piece. ``loss_from``: a column with the characters of each text before its loss-bearing part
    (prompt); without it all tokens bear loss. sequence_id joins the task's number and a count."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    cols = [F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")]
    cols.append(F.coalesce(F.col(loss_from), F.lit(0)).cast("int").alias("p") if loss_from else F.lit(0).alias("p"))

    def run(batches):
        encode = encoder(vocabulary, pattern)
        base, count = TaskContext.get().partitionId() << 33, 0
        pend: list[tuple] = []
        pending = 0

        def flush():
            nonlocal count, pend, pending
            lengths = np.array([len(x[1]) for x in pend])
            bins = pack(lengths, np.array([x[2] for x in pend]), limits, split)
            rows = {n: [] for n in names}
            for b in bins:
                offset = 0
                for e, start, n in b:
                    doc, ids, y = pend[e]
                    loss = max(0, min(n, start + n - (len(ids) - y)))
                    for k, v in zip(names, (doc, start, n, zlib.crc32(ids[start : start + n]), len(ids), base + count, offset, loss)):
                        rows[k].append(v)
                    offset += n
                count += 1
            pend, pending = [], 0
            return pa.RecordBatch.from_pydict(rows, pa.schema([(n, pa.int64()) for n in names]))

        for batch in batches:
            for doc, text, prompt in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = np.array([*encode(text), END], "<u4")
                y = len(ids)
                if prompt > 0:
                    y -= min(len(encode(text[:prompt])), y)
                pend.append((doc, ids, y))
                pending += len(ids)
                if pending >= pool:
                    yield flush()
        if pend:
            yield flush()

    return bounded(docs).select(*cols).mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_corpus(table(spark, sf_dir, "documents")).drop("loss_tokens")


def pack_corpus(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
