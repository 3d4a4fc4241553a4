"""Word-shingle sets as sorted arrays of 64-bit hashes, made with whole-array arithmetic on the bytes of a text."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Texts are hashed in blocks of about this many bytes, cut at white space.
BLOCK = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_ROOT = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for k, r in enumerate((_ROOT, pow(_ROOT, -1, 1 << 64))):
                _POWERS[k] = np.r_[np.uint64(1), np.cumprod(np.full(size, r, np.uint64))]
    return _POWERS


def _block_hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    edge = np.diff(np.r_[True, _SPACE[b], True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        up, down = _powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[b] * up[: len(b)], out=sums[1:])
        h = (sums[end] - sums[start]) * down[start]  # a polynomial in the word's bytes, wherever the word stands
        h = (h ^ (h >> np.uint64(32))) * _MIX[1] + (end - start).astype(np.uint64)
        return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words (runs without ASCII white space, A-Z lower-cased) of a UTF-8 text, in order."""
    text = text.lower()
    if len(text) <= BLOCK:
        return _block_hashes(text)
    parts, at = [], 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        parts.append(_block_hashes(text[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of the whole sequence if there are fewer words; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(WORDS, len(w))
    with np.errstate(over="ignore"):
        s = w[: len(w) - k + 1] * _MIX[0] + np.uint64(k)
        for j in range(1, k):
            s = (s ^ (s >> np.uint64(31))) * _MIX[4] + w[j : len(w) - k + 1 + j] * _MIX[j]
        s ^= s >> np.uint64(29)
        s *= _MIX[1]
        s ^= s >> np.uint64(32)
    return np.unique(s)
