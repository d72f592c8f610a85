"""Words and word hashes of whole batches of texts, in numpy.

A word is a maximal run of bytes outside space and 9 to 13. Words are hashed by a polynomial over
random 64-bit byte values modulo 2**64, so that one running sum over the batch gives all words.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        n = max(n, 1 << 21)
        _powers["up"] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, _BASE))])
        _powers["down"] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, _INVERSE))])
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Batch:
    """Words of some texts: ``buf`` is all bytes, word k is buf[start[k]:end[k]] of text doc[k]. With ``letters``, words are runs of ASCII letters, digits and bytes over 127."""

    def __init__(self, texts: list[bytes], lower: bool = True, letters: bool = False) -> None:
        joined = b" ".join(texts) + b" "
        self.raw = joined.lower() if lower else joined  # bytes.lower changes A-Z only
        self.buf = np.frombuffer(self.raw, np.uint8)
        blank = (_MARK if letters else _SPACE)[self.buf]
        edge = np.diff(blank.view(np.int8), prepend=np.int8(1))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(self.end) > len(self.start):
            self.end = self.end[1:]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        self.doc = np.searchsorted(self.offset, self.start, "right") - 1
        self.n_docs = len(texts)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def bounds(self) -> np.ndarray:
        """First word of each text, and the number of words."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def hashes(self, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Of each word, or of the byte ranges given."""
        s, e = (self.start, self.end) if first is None else (first, last)
        up, down = _power_table(len(self.buf) + 1)
        run = np.empty(len(self.buf) + 1, np.uint64)
        run[0] = 0
        np.cumsum(_BYTE[self.buf] * up[: len(self.buf)], out=run[1:])
        return mix((run[e] - run[s]) * down[s])


def shingles(batch: Batch, width: int) -> list[np.ndarray]:
    """The distinct hashed shingles of each text, unordered between equal hashes, ascending by hash.

    Texts of fewer than ``width`` words have their whole sequence as the one shingle; without words: none.
    """
    h, bounds = batch.hashes(), batch.bounds()
    k = len(h) - width + 1
    rolled = np.zeros(max(k, 0), np.uint64)
    for j in range(width if k > 0 else 0):
        rolled = rolled * _BASE + h[j : j + k]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            x = np.array([hi - lo], np.uint64)
            for w in h[lo:hi]:
                x = x * _BASE + w
            out.append(mix(x ^ _BYTE[0]))
        else:
            out.append(np.empty(0, np.uint64))
    return out
