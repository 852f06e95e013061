"""Words, hashed shingles and sets of them for batches of texts."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile("[a-z0-9]+")
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    z = z ^ (z >> np.uint64(30))
    z *= _K1
    z ^= z >> np.uint64(27)
    z *= _K2
    z ^= z >> np.uint64(31)
    return z


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123)]] = True
_CHUNK = 1 << 17  # bytes at a time, which the processor's cache holds


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(text: str | None) -> list[str]:
    """The longest runs of a-z and 0-9 in the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, hashes of all their words in order), words as ``words_of`` finds them.

    A word's hash is the difference of two running sums of bytes times powers, divided by the power of its place, so that words are
    hashed all at once; equal words have equal hashes wherever they stand.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    counts, hashes, first = [], [np.empty(0, np.uint64)], 0
    powers = _powers(_BASE, min(_CHUNK + 1, sum(map(len, raw)) + len(raw))), _powers(_BACK, min(_CHUNK + 1, sum(map(len, raw)) + len(raw)))
    while first < len(raw):
        last, size = first, 0
        while last < len(raw) and (last == first or size + len(raw[last]) < _CHUNK):
            size += len(raw[last]) + 1
            last += 1
        text = np.frombuffer(b" ".join(raw[first:last]) + b" ", np.uint8)
        inside = np.empty(len(text) + 1, bool)
        inside[0], inside[1:] = False, _IN_WORD[text]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        if len(powers[0]) < len(text):
            powers = _powers(_BASE, len(text)), _powers(_BACK, len(text))
        forth, back = powers[0][: len(text)], powers[1]
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(text * forth, out=total[1:])
        hashes.append(mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)))
        cut = np.cumsum([0, *(len(t) + 1 for t in raw[first:last])])
        counts.append(np.diff(np.searchsorted(start, cut)))
        first = last
    return np.concatenate(counts or [np.empty(0, np.int64)]), np.concatenate(hashes)


def windows(lengths: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place of the first word in the text, hash) of every run of ``width`` words."""
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mix(hashes[j : j + len(h)] + np.uint64(j))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    start = np.concatenate([[0], lengths.cumsum()[:-1]])
    place = np.arange(len(doc)) - start[doc]
    whole = place[: len(h)] + width <= lengths[doc[: len(h)]]
    return doc[: len(h)][whole], place[: len(h)][whole], mix(h[whole])


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, ordered by text and hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def once(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, texts in the order given (``doc`` ascends), hashes of a text in any order."""
    both = mix(h + doc.astype(np.uint64) * _K2)
    order = np.argsort(both)
    near = order[:-1], order[1:]
    again = (both[near[0]] == both[near[1]]) & (doc[near[0]] == doc[near[1]]) & (h[near[0]] == h[near[1]])
    if not again.any():
        return doc, h
    new = np.ones(len(h), bool)
    new[near[1][again]] = False
    return doc[new], h[new]
