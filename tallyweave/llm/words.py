"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased; UTF-8
continuation bytes never look like white space, so bytes and characters agree.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

#: White space, and white space with ASCII punctuation, as tables over bytes.
WHITE = _SPACE
NO_PUNCTUATION = _SPACE.copy()
NO_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

_powers: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2^64, at least ``n`` of them."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, at: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the first word of each row (one more entry than rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word; equal words (A-Z lower-cased) have equal hashes."""
    up, down = _table(len(data) + 1)
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of the ``width`` words from each position on (fewer positions than words)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, width):
        total *= _STEP
        total += words[k : k + n]
    return mix(total)


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """The hash that stands for a whole sequence shorter than a shingle, as an array of one."""
    total = np.array([len(words)], np.uint64)
    for word in words:
        total = mix(total * _STEP + word)
    return total


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each row its distinct shingles, sorted; with fewer words than ``width`` the sequence as one; empty without words."""
    starts, ends, first = spans(data, at)
    words = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    every = shingle_hashes(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            one = np.sort(every[a : b - width + 1])
            keep = np.empty(len(one), bool)
            keep[0] = True
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            out.append(one[keep])
        else:
            out.append(sequence_hash(words[a:b]) if b > a else np.zeros(0, np.uint64))
    return out
