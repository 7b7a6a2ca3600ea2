"""Word shingles of many texts at once, as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _BACK)):
            of = np.full(size, base, np.uint64)
            of[0] = 1
            _powers[k] = np.multiply.accumulate(of)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads each bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of the texts, in order. With `lower`, words are lower-cased in A-Z only."""
    joined = b"\n".join(texts) + b"\n"
    joined = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    forth, back = powers(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * forth[: len(joined)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, across texts too."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        total += hashes[k : k + len(total)] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    return mix(total)


def repeated_words(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them stand in runs of n words that the text has twice or more."""
    hashes, of = word_hashes(texts, lower=False)
    count = np.bincount(of, minlength=len(texts))
    again = np.zeros(len(texts), np.int64)
    if len(hashes) >= n:
        whole = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
        window, text = window_hashes(hashes, n)[whole], of[whole]
        order = np.lexsort((window, text))
        same = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
        twice = whole[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(whole) else whole
        edge = np.zeros(len(hashes) + n + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + n, -1)
        again += np.bincount(of[np.cumsum(edge)[: len(hashes)] > 0], minlength=len(texts))
    return count, again


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text: runs of n words, or all words where there are fewer."""
    hashes, of = word_hashes(texts)
    total = window_hashes(hashes, n)
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for t in range(len(texts)):
        a, b = int(first[t]), int(first[t + 1])
        if b - a >= n:
            out.append(np.unique(total[a : b - n + 1]))
        elif b > a:
            few = np.array([b - a], np.uint64)
            for k in range(a, b):
                few = mix(few * np.uint64(_BASE) + hashes[k : k + 1])
            out.append(few)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(of: np.ndarray) -> int:
    """A 64-bit number that equal sets share, as a signed integer."""
    return int((mix(of ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) ^ np.uint64(len(of))).astype(np.int64))
