import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strataspan.llm import suffixes
from strataspan.llm.fm_index import FMIndex
from strataspan.llm.kernels import WORD_LUT, gram_hashes, utf8, word_hashes
from strataspan.llm.suffix_dedup import cut_pieces, pack_bytes, unpack_bytes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=70), st.integers(1, 3))
def test_suffix_array_and_common_prefixes(values, times):
    t = np.array(values * times + [0])
    old, suffixes.RESIDUE, suffixes.DENSE_SYMBOLS = (suffixes.RESIDUE, suffixes.DENSE_SYMBOLS), 4, 2
    try:
        sa = suffixes.suffix_array(t)
    finally:
        suffixes.RESIDUE, suffixes.DENSE_SYMBOLS = old
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert sa.tolist() == want
    shared = suffixes.common_prefixes(t, sa)
    for a, b in zip(want, want[1:]):
        n = 0
        while n < min(len(t) - a, len(t) - b) and t[a + n] == t[b + n]:
            n += 1
        assert shared[b] == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=80), st.lists(st.integers(1, 6), min_size=1, max_size=4))
def test_fm_index_finds_all(values, pattern):
    index = FMIndex(np.array(values), 8, sample=3)
    lo, hi = index.search(np.array([pattern]))
    got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    k = len(pattern)
    assert got == [i for i in range(len(values) - k + 1) if values[i : i + k] == pattern]


def test_words_stop_at_rows_and_hash_by_content():
    raw, off = utf8(pa.array(["Ab c", None, "", "ab-C", "é9"]))
    h, row, s, e = word_hashes(raw, off)
    assert row.tolist() == [0, 0, 3, 3, 4]
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert WORD_LUT[ord("Z")] == ord("z")
    g, r = gram_hashes(h, row, 2)
    assert r.tolist() == [0, 3] and g[0] == g[1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6))
def test_equal_windows_have_equal_keys(texts):
    raw, off = utf8(pa.array(texts))
    row, start, count, key = cut_pieces(raw, off, 20, 5)
    by = {}
    seen = set()
    for r, s, c, k in zip(row.tolist(), start.tolist(), count.tolist(), key.tolist()):
        for p in range(s, s + c):
            assert (r, p) not in seen
            seen.add((r, p))
            assert by.setdefault(texts[r][p : p + 20], k) == k
    assert seen == {(r, p) for r, t in enumerate(texts) for p in range(len(t) - 19)}


def test_arrays_survive_packing():
    a, b = np.arange(5, dtype=np.uint64), np.zeros(0, np.uint8)
    c, d = unpack_bytes(pack_bytes(a, b))
    assert c.tolist() == a.tolist() and len(d) == 0


def test_suffix_arrays_recurse_whatever_the_alphabet(sf, monkeypatch):
    """Two megabytes of text: names of substrings are many, and yet sorted by the same steps down to a residue."""
    import pyarrow.parquet as pq

    from strataspan.llm.kernels import utf8

    raw, _ = utf8(pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"])
    t = np.concatenate((raw[: 2 << 20].astype(np.int16) + 1, [0])).astype(np.int16)
    sizes, sort = [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda x: (sizes.append(len(x)), sort(x))[1])
    doubled, doubling = [], suffixes._doubling
    monkeypatch.setattr(suffixes, "_doubling", lambda x: (doubled.append(len(x)), doubling(x))[1])
    got = suffixes.suffix_array(t)
    assert len(sizes) > 3 and max(doubled, default=0) <= suffixes.RESIDUE
    assert (got == doubling(t)).all()
