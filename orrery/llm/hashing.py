"""Vectorised 64-bit hashes of stretches of symbols, and words as symbols."""

from __future__ import annotations

import re

import numpy as np

U = np.uint64
#: Odd multipliers of independent polynomial hashes modulo 2 ** 64.
BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
BASE = BASES[0]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BLANK = re.compile(rb"[\x09-\x0d ]")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


TABLE = mix(np.arange(1, 257, dtype=U) * BASE)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """BASES[which] ** i and its inverse, modulo 2 ** 64, for i up to ``n``."""
    if which not in _POWERS or len(_POWERS[which][0]) <= n:
        size = max(n + 1, 1 << 16)
        base = BASES[which]
        out = []
        for b in (base, U(pow(int(base), -1, 1 << 64))):
            f = np.full(size, b, U)
            f[0] = 1
            out.append(np.cumprod(f, dtype=U))
        _POWERS[which] = out[0], out[1]
    return _POWERS[which]


class Hashes:
    """Hashes of any stretch of a symbol line in constant time."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        up, self.down = powers(len(symbols), which)
        self.upto = np.concatenate([np.zeros(1, U), np.cumsum(symbols * up[: len(symbols)], dtype=U)])

    def of(self, start, stop) -> np.ndarray:
        return mix((self.upto[stop] - self.upto[start]) * self.down[start])


def word_line(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, words per text, and each word's byte range in b" ".join(texts)."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = Hashes(TABLE[data]).of(start, stop) + (stop - start).astype(U) * BASE
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    return mix(h), np.diff(np.concatenate([[0], np.searchsorted(start, ends)])), start, stop


def long_word_line(text: bytes, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and byte ranges of one text, piece by piece, so that no array but theirs follows its length."""
    symbols, start, stop, at = [np.empty(0, U)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while at < len(text):
        m = BLANK.search(text, at + most)
        end = m.start() if m else len(text)
        h, _, a, z = word_line([text[at:end]])
        symbols.append(h)
        start.append(a + at)
        stop.append(z + at)
        at = end
    return np.concatenate(symbols), np.concatenate(start), np.concatenate(stop)
