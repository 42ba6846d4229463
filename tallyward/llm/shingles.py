"""Hashes of words and word shingles of whole texts, vectorised."""

from __future__ import annotations

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2**64, grown on demand up to a limit."""

    def __init__(self, base: int) -> None:
        self.base, self.values = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            more = np.full(max(n, 2 * len(self.values)), self.base)
            more[0] = 1
            self.values = np.multiply.accumulate(more)
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)
#: Bytes that are hashed at a time; a longer text is cut at white space where there is any.
PART = 1 << 20


def word_hashes(text: bytes, separators: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of ``text``; ``separators`` says for each byte value whether it stands between words.

    A polynomial hash by prefix sums: equal words give equal hashes wherever they stand.
    """
    return words_at(text, separators)[0]


def words_at(text: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words, and the bytes where they begin."""
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(text):
        end = min(len(text), at + PART)
        part = np.frombuffer(text, np.uint8, end - at, at)
        if end < len(text):
            gaps = np.flatnonzero(separators[part])
            if len(gaps):
                part = part[:gaps[-1] + 1]
            else:  # one word of more than a part: take it up to its end
                rest = np.frombuffer(text, np.uint8, len(text) - at, at)
                found = np.flatnonzero(separators[rest])
                part = rest[:found[0] + 1] if len(found) else rest
        own, first = _part_hashes(part, separators)
        hashes.append(own)
        starts.append(first + at)
        at += len(part)
    return np.concatenate(hashes), np.concatenate(starts)


def _part_hashes(part: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(part) + 2, np.int8)
    inside[1:-1] = ~separators[part]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP.upto(len(part)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _DOWN.upto(len(part))[starts] + (ends - starts).astype(np.uint64)), starts


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits, for texts whose A-Z are lowered.
MARKS = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; A-Z are lowered, words lie between ASCII white space.

    A text with fewer words has its whole sequence as one shingle, a text without words none.
    """
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER), WHITE)
    if not len(words):
        return words
    n = min(size, len(words))
    total = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        total = mix(total * np.uint64(_BASE) + words[i:len(words) - n + 1 + i])
    return np.unique(total)
