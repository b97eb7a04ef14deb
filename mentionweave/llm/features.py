"""Vectorised hashed features of raw UTF-8 bytes: words with their prefixes, and byte n-grams."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
#: One odd random multiplier a byte value, and powers for the position in a word.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_BYTE_W = np.where(_WORD, _BYTE[_LOWER], np.uint64(0))

#: Lengths in bytes of the word prefixes that count as features beside the whole word.
PREFIXES = (4, 5, 6)


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 64-bit feature) of each word and of its prefixes; lower-cased in A-Z.

    Words are runs of letters, digits and non-ASCII bytes and never cross documents.
    """
    base, end = off[0], off[-1]
    b = data[base:end]
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = _WORD[b]
    first = w.copy()
    first[1:] &= ~w[:-1]
    cuts = off[1:-1] - base
    cuts = cuts[cuts < len(b)]
    first[cuts] = w[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    number = np.cumsum(first, dtype=np.int32) - 1
    pos = np.arange(len(b), dtype=np.int64) - starts[np.maximum(number, 0)]
    v = _BYTE_W[b] * _POS[pos & 63]
    if starts[0]:
        v[: starts[0]] = 0
    out = [np.add.reduceat(v, starts)]
    length = np.add.reduceat(w.astype(np.int32), starts)
    acc = np.zeros(len(starts), np.uint64)
    for k in range(max(PREFIXES)):
        at = np.minimum(starts + k, len(b) - 1)
        acc = acc + np.where(length > k, _BYTE_W[b[at]] * _POS[k], np.uint64(0))
        if k + 1 in PREFIXES:
            out.append(np.where(length > k + 1, (acc ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15), out[0]))
    doc = np.searchsorted(off - base, starts, "right") - 1
    return np.tile(doc, len(out)), np.concatenate(out)


def gram_ids(data: np.ndarray, off: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the byte n-gram that starts at each position; 2**bits where it would leave its document."""
    base = off[0]
    b = _LOWER[data[base : off[-1]]].astype(np.uint32)
    h = b.copy()
    for k in range(1, min(n, len(b))):  # up to four bytes fill the 32 bits
        h[: len(b) - k] |= b[k:] << np.uint32(8 * k)
    h += np.uint32(n)
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    out = (h >> np.uint32(32 - bits)).view(np.int32)
    for k in range(1, n):
        ends = off[1:] - base - k
        ends = ends[ends >= 0]
        out[ends[ends < len(out)]] = 1 << bits
    return out
