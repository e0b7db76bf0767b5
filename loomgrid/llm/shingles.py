"""Word shingles of texts as 64-bit hashes, for similarity on words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .common import mixed, text_bytes, word_hashes

_WORD = np.ones(256, bool)
_WORD[9:14] = _WORD[32] = False


def shingle_hashes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's shingles in order, repeats included; a row of fewer words, but not none, has its whole sequence."""
    raw, offs = text_bytes(column)
    n = len(offs) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    w, rows = word_hashes(raw, offs, _WORD)
    count = np.diff(rows)
    h = np.zeros(len(w), np.uint64)
    seed = np.full(len(w), 0x51_7C_C1_B7_27_22_0A_95, np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for j in range(size):  # short rows stop at their end, so length is part of the hash
        at = np.arange(len(w)) + j
        ok = at < np.repeat(rows[1:], count)
        seed = np.where(ok, mixed(seed * odd + w[np.minimum(at, len(w) - 1)]), seed)
        h = seed
    keep = np.arange(len(w)) <= np.repeat(np.maximum(rows[1:] - size, rows[:-1]), count)
    made = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    return h[keep], np.concatenate([[0], np.cumsum(made)])


def sets(column: pa.Array, size: int) -> list[np.ndarray]:
    h, offs = shingle_hashes(column, size)
    return [np.unique(h[a:b]) for a, b in zip(offs[:-1], offs[1:])]


def digest(own: np.ndarray) -> bytes:
    """Of a set of shingles; equal sets have equal digests."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()
