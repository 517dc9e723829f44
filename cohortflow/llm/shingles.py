"""Word shingles of whole texts as sorted sets of 64-bit numbers.

Words are runs of bytes outside space and 0x09 to 0x0D, with A-Z in lower case.
All work is on arrays over a batch of texts; nothing depends on the process, so
every task and every rerun gives a text the same set.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Bytes of text that are hashed together; bounds the arrays, which take some 40 bytes for each.
HASHED_AT_ONCE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = np.uint64(0xD1342543DE82EF95)
_FACTORS = mix(np.arange(1000, 1064, dtype=np.uint64) * _STEP) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(raws: Sequence[bytes], lower: bool = True) -> list[np.ndarray]:
    """The 64-bit numbers of the words of each text, in order."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(raws):
        to, held = at, 0
        while to < len(raws) and (to == at or held + len(raws[to]) <= HASHED_AT_ONCE):
            held += len(raws[to])
            to += 1
        out += _hash_some(raws[at:to], lower)
        at = to
    return out


def _hash_some(raws: Sequence[bytes], lower: bool) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    space = _SPACE[data]
    full = ~space
    starts = np.flatnonzero(full & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(raws)
    ends = np.flatnonzero(space & np.concatenate([[False], full[:-1]]))
    sizes = ends - starts
    word = np.cumsum(np.bincount(starts, minlength=len(data))) - 1  # the last word begun
    place = np.arange(len(data)) - starts[np.maximum(word, 0)]
    place[space] = 0
    powers = np.cumprod(np.full(int(sizes.max()) + 1, _BASE, np.uint64))
    value = _BYTE[_LOWER[data] if lower else data] * powers[place]
    value[space] = 0
    hashes = mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64) * _STEP)
    bounds = np.cumsum([0, *[len(r) + 1 for r in raws]])
    cuts = np.searchsorted(starts, bounds)
    return [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def shingle(words: np.ndarray, k: int) -> np.ndarray:
    """The numbers of every run of k words, in order; fewer words give one run of them all."""
    k = min(k, len(words))
    if k == 0:
        return words
    n = len(words) - k + 1
    total = np.full(n, k, np.uint64) * _STEP
    for i in range(k):
        total += words[i : i + n] * _FACTORS[i]
    return mix(total)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingle(words, k))


def set_name(tokens: np.ndarray) -> bytes:
    """16 bytes that name a set: equal for equal sets, and for others by chance only."""
    return np.array([mix(tokens).sum(), mix(tokens ^ _STEP).sum()], np.uint64).tobytes()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
