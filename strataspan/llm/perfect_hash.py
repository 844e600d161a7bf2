"""A minimal perfect hash of fixed-size digests: n distinct keys to the slots 0 .. n - 1, in a few bits a key.

Level by level, every key that is still without a place hashes to one of about two bits a key; a bit that just one key
hits is set and places it, the others go on to the next level. A key's slot is the number of set bits before its own.
A key that was not there at the making may be given any slot, or none, so what a slot holds has to be compared.
"""

from __future__ import annotations

import numpy as np

DIGEST = 32
#: Bits of a level for each key that comes to it.
ROOM = 2
#: Distinct keys are all placed in a dozen levels or so; equal ones never are.
LEVELS = 64


def as_words(digests: list[bytes] | bytes) -> np.ndarray:
    """Digests of 32 bytes as rows of four 64-bit numbers."""
    return np.frombuffer(digests if isinstance(digests, bytes) else b"".join(digests), "<u8").reshape(-1, DIGEST // 8)


def _hash(words: np.ndarray, level: int) -> np.ndarray:
    h = np.full(len(words), 0x9E3779B97F4A7C15 * (level + 1) % 2**64, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


class PerfectHash:
    def __init__(self, sizes: list[int], bits: bytes):
        """``sizes``: the bits of each level, multiples of eight; ``bits``: all levels' bits, packed."""
        self.sizes, self.packed = sizes, bits
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8)) if bits else np.zeros(0, np.uint8)
        self.before = np.cumsum(self.bits, dtype=np.int64) - self.bits

    @classmethod
    def of(cls, words: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], words
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys of a perfect hash are distinct")
            size = -(-ROOM * len(left) // 8) * 8
            at = (_hash(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone).tobytes())
            left = left[~alone[at]]
        return cls(sizes, b"".join(levels))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        out, left, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = start + (_hash(words[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at] == 1
            out[left[hit]] = self.before[at[hit]]
            left, start = left[~hit], start + size
        return out
