"""Polynomial hashes over bytes and words, for many texts at a time."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: What stands for each byte: fixed random numbers.
BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
WORDS = 5
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class PrefixHash:
    """Hashes of any stretch of a byte string from sums over its prefixes."""

    def __init__(self, flat: np.ndarray):
        self.up, down = powers(len(flat) + 1)
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(BYTE[flat] * self.up[: len(flat)], out=self.sums[1:])
        self.down = down

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of ``flat[start:stop]``: the same for equal bytes wherever they stand."""
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def word_shingles(texts: list[str], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of ``k`` words; a text of fewer words has one run, all of it.

    Words are what ASCII white space separates. Texts without words have no run.
    """
    raw = [t.encode() for t in texts]
    size = np.array([len(r) + 1 for r in raw], np.int64)
    flat = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    white = WHITE[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white])))  # words begin and end in turn: the last byte is white
    start, stop = edge[0::2], edge[1::2]
    doc = np.searchsorted(np.cumsum(size), start, side="right")
    word = mix(PrefixHash(flat).of(start, stop) + (stop - start).astype(np.uint64))
    n = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(n) - n
    weights = [mix(np.uint64(j + 1) * BASE + np.zeros(1, np.uint64))[0] | np.uint64(1) for j in range(k)]
    runs, owner = [], []
    if len(word) >= k:
        total = sum(word[j : len(word) - k + 1 + j] * weights[j] for j in range(k))
        same = doc[: len(doc) - k + 1] == doc[k - 1 :]
        runs.append(mix(total[same]))
        owner.append(doc[: len(doc) - k + 1][same])
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        total = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            has = n[few] > j
            total[has] += word[begin[few[has]] + j] * weights[j]
        runs.append(mix(total + n[few].astype(np.uint64)))
        owner.append(few)
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owner), np.concatenate(runs)


def weighted(texts: list[str], k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of runs: text number, hash and count, sorted by text and hash."""
    doc, run = word_shingles(texts, k)
    order = np.lexsort((run, doc))
    doc, run = doc[order], run[order]
    if not len(doc):
        return doc, run, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])]))
    return doc[first], run[first], np.diff(np.append(first, len(doc)))
