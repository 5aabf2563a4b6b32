"""Sets of word shingles as sorted arrays of 64-bit hashes, many documents at once."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
BYTES = 1 << 21  # of text hashed at once
LONG_WORD = 4096  # bytes of a word that is hashed apart

_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32
_blank = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_first = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight
_step = np.uint64(0x9E3779B97F4A7C15)


def finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], k: int = WORDS, family: int = 0) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; of a text with fewer than ``k`` words the whole sequence's.

    Words are split at ASCII white space after A-Z are lower-cased.  Each ``family`` is a hash function of its own.
    """
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BYTES:
            out += _hashed(held, k, family)
            held, size = [], 0
    return out + _hashed(held, k, family)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, first and last places of words, number of words before each text and in all)."""
    raw = _lower[np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), np.uint8)]
    blank = _blank[raw]
    blank[-8:] = True
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.r_[0, edge]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return raw, edge[0::2], edge[1::2], np.searchsorted(edge[0::2], begins)


def _word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, family: int) -> np.ndarray:
    """Eight bytes at a time, mixed before the next eight come in."""
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    size = stop - start
    value = finish(size.astype(np.uint64) * _step + np.uint64(2 * family + 1))
    value = finish(value * _step + (eight[start] & _first[np.minimum(size, 8)]))
    at, more = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
    while len(more):
        part = eight[start[more] + at] & _first[np.minimum(size[more] - at, 8)]
        value[more] = finish(value[more] * _step + part)
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        value[i] = xxhash.xxh3_64_intdigest(raw[start[i] : stop[i]].tobytes(), seed=family)
    return value


def _hashed(texts: list[bytes], k: int, family: int) -> list[np.ndarray]:
    if not texts:
        return []
    raw, start, stop, before = _words(texts)
    word = _word_hashes(raw, start, stop, family)
    rolled = finish(word + np.uint64(k))
    for step in range(1, k):  # mixed before the next word comes in: no sum of words, whose order would not count
        rolled = finish(rolled[:-1] * _step + word[step:]) if len(rolled) else rolled
    out = []
    for text, a, b in zip(texts, before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()), seed=family + 1)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
