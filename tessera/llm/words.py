"""Words and word windows of UTF-8 text as NumPy arrays, without a Python object for each word.

All separators of the word rules here are ASCII, so they are found byte by byte. Hashes are 64 bits:
a polynomial over bytes, taken from prefix sums, then mixed. Such polynomials modulo 2**64 have constructed collisions for
words of 1,024 bytes and more whatever their tables are, so words of more than LONG bytes get a cryptographic digest instead.
A sequence of words is hashed by a polynomial over its words' hashes; the second, independent hash of a sequence folds
its upper bits down between steps, which is no polynomial.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from .chunks import drop_all

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
_BYTE2 = _rng.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = U64(0xD1342543DE82EF95)
_STEP2 = U64(0xAF251AF3B0F025B5)
#: Bytes of a word up to which its hash is a polynomial.
LONG = 32


def _class(rule: str) -> np.ndarray:
    is_word = np.ones(256, bool)
    if rule == "space":  # words are [^\x20\x09-\x0D]+
        is_word[[0x20, *range(0x09, 0x0E)]] = False
    elif rule == "alnum":  # words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased
        is_word[:0x80] = False
        is_word[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    else:
        raise ValueError(rule)
    return is_word


IS_WORD = {r: _class(r) for r in ("space", "alnum")}


def _folded(table: np.ndarray) -> np.ndarray:
    out = table.copy()
    out[0x41:0x5B] = out[0x61:0x7B]
    return out


_TABLES = {(False, 0): _BYTE, (True, 0): _folded(_BYTE), (False, 1): _BYTE2, (True, 1): _folded(_BYTE2)}
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        grown = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, 1 << 20), base, U64)
            p[0] = 1
            grown.append(np.multiply.accumulate(p))
        if n > 1 << 23:  # a single huge text; not kept
            return grown[0], grown[1]
        _powers = (grown[0], grown[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


@dataclass
class Words:
    """starts, ends: byte positions; doc: row of each word, from 0; bounds: first word of each row, and the count."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray
    fold: bool

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; which: 0 or 1, two independent ones."""
        p, inv = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_TABLES[self.fold, which][self.data] * p[: len(self.data)], out=sums[1:])
        length = self.ends - self.starts
        h = mix((sums[self.ends] - sums[self.starts]) * inv[self.starts] + length.astype(U64))
        for i in np.flatnonzero(length > LONG):
            word = self.data[self.starts[i] : self.ends[i]].tobytes()
            digest = hashlib.blake2b(word.lower() if self.fold else word, digest_size=16).digest()
            h[i] = int.from_bytes(digest[8 * which : 8 * which + 8], "little")
        return h

    def windows(self, k: int) -> np.ndarray:
        """Index of the first word of each run of k words within one row."""
        if len(self.starts) < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[k - 1 :] == self.doc[: len(self.doc) - k + 1])


def split(data: np.ndarray, offsets: np.ndarray, rule: str, fold: bool = False) -> Words:
    """The words of rows data[offsets[i]:offsets[i+1]]."""
    drop_all()
    offsets = offsets - offsets[0] + 0
    n = int(offsets[-1])
    w = IS_WORD[rule][data[:n]]
    s, e = w.copy(), w.copy()
    if n:
        s[1:] &= ~w[:-1]
        e[:-1] &= ~w[1:]
        filled = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][filled], offsets[1:][filled] - 1
        s[first] = w[first]
        e[last] = w[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    bounds = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(data[:n], starts, ends, doc, bounds, fold)


def rolled(word_hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of each k consecutive words (also across rows: select with Words.windows)."""
    m = len(word_hashes) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    g = word_hashes[:m].copy()
    for j in range(1, k):
        if which:
            g ^= g >> U64(31)
            g *= _STEP2
        else:
            g *= _STEP
        g += word_hashes[j : m + j]
    return mix(g)


def covered(starts: np.ndarray, k: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run that begins at one of starts and has k words."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return np.cumsum(edge[:n]) > 0
