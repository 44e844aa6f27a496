"""Vectorised hashes of words and word n-grams; texts of a batch go end to end through numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: A fixed odd multiplier for places in a word, and one for words in an n-gram.
PLACE, WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def byte_values(seed: int = 3) -> np.ndarray:
    """256 fixed random odd 64-bit values."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=np.uint64) | U(1)


VALUES = byte_values()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xCA5A826395121157)
    return x ^ (x >> U(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all white-space separated words, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    start = np.flatnonzero(begins)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, np.concatenate(([0], ends))))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    place = np.arange(len(data)) - start[np.maximum(np.cumsum(begins) - 1, 0)]
    place[: start[0]] = 0
    value = VALUES[data] * powers(PLACE, int(place.max()) + 1)[place]
    value[~inside] = 0
    size = np.add.reduceat(inside.astype(np.uint64), start)
    return mix(np.add.reduceat(value, start) + size), counts


def shingle_sets(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word n-grams of each text as sorted hashes end to end, and how many each text has.

    A text of fewer words, but not none, has one n-gram: all its words.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    total = len(words)
    out, sizes = [], np.zeros(len(texts), np.int64)
    if total >= n:
        gram = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            gram = gram * U(WORD) + words[k : total - n + 1 + k]
        gram = mix(gram)
    for k, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        if not count:
            continue
        if count < n:
            h = U(count)
            with np.errstate(over="ignore"):
                for w in words[end - count : end]:
                    h = h * U(WORD) + w
            own = mix(np.array([h], np.uint64))
        else:
            own = np.sort(gram[end - count : end - n + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        out.append(own)
        sizes[k] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes
