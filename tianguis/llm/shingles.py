"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import re

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
WIDTH = 5
PIECE = 1 << 21
_WHITE = re.compile(rb"[\x09-\x0d\x20]")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1), modulo 2 ** 64; kept for the next call."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash a word of a UTF-8 text; A-Z count as a-z, words end at ASCII white space.

    A very long text is hashed in pieces that end at white space, which bounds the memory
    and gives the same hashes.
    """
    out, begin = [], 0
    while len(data) - begin > PIECE:
        cut = _WHITE.search(data, begin + PIECE)
        if cut is None:
            break
        out.append(_piece(data[begin : cut.start()]))
        begin = cut.end()
    out.append(_piece(data[begin:]))
    return np.concatenate(out)


def _piece(data: bytes) -> np.ndarray:
    raw = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    # sums of byte * BASE ** position give each word's polynomial times BASE ** start; all
    # are lifted to the power of the text's length, which is then taken away
    power = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])])
    spread = (total[end] - total[start]) * power[len(raw) - start]
    return mix(spread * inverse_power(len(raw)) + (end - start).astype(np.uint64))


def inverse_power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), -n, 1 << 64))


def shingle_set(data: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes; of fewer than ``width`` words, one for the sequence."""
    words = word_hashes(data or b"")
    n = len(words)
    if not n:
        return words
    span = min(width, n)
    out = np.full(n - span + 1, np.uint64(span))
    for k in range(span):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k : n - span + 1 + k])
    return np.unique(out)
