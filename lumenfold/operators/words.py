"""Hashes of words and of word sequences, many at a time."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

#: Words that are remembered.
_CACHED = 200_000


class WordHashes:
    """64-bit hashes of words (strings or bytes), remembered up to a bound."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.values = np.zeros(1 << 12, np.uint64)

    def __call__(self, words: list) -> np.ndarray:
        if len(self.index) > _CACHED:
            self.clear()
        missing = set(words).difference(self.index)
        if missing:
            at, digest = len(self.index), xxhash.xxh64_digest
            new = np.frombuffer(b"".join([digest(w) for w in missing]), ">u8").astype(np.uint64)
            while at + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[at : at + len(new)] = new
            self.index.update(zip(missing, range(at, at + len(new))))
        return self.values[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]


def sequence_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` consecutive words."""
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for j in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + len(out)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


@cache
def _letters() -> np.ndarray:
    """Of each code point whether it is a letter or digit, as ``[^\\W_]`` is."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers as 64-bit hashes."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Hashes of code points and places below this are looked up.
_TABLE = 1 << 13
_CODES, _PLACES = mixed(np.arange(_TABLE, dtype=np.uint64)), mixed(np.arange(1 << 40, (1 << 40) + _TABLE, dtype=np.uint64)) | np.uint64(1)


#: Letters that are hashed at a time.
_LETTERS = 1 << 20


def text_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of letters and digits) of all texts, one text after the other, and how many each text has.

    A word's hash is the sum of its letters' hashes, each times a number of its place; no word becomes a Python string."""
    found, counts, held, size = [], np.zeros(len(texts), np.int64), [], 0

    def done() -> None:
        hashes, n = _hashed([x for _, x in held])
        found.append(hashes)
        np.add.at(counts, [i for i, _ in held], n)
        held.clear()

    for i, text in enumerate(texts):
        low = 0
        while low < len(text):
            high = min(len(text), low + _LETTERS)
            while high < len(text) and text[high].isalnum():  # long texts are cut between words
                high += 1
            held.append((i, text[low:high]))
            size += high - low
            low = high
            if size >= _LETTERS:
                done()
                size = 0
    done()
    return np.concatenate(found), counts


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = _letters()[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(first, ends), prepend=0)
    if not len(first):
        return np.zeros(0, np.uint64), counts
    sizes = end - first
    codes = codes[inside[1:-1]]
    starts = np.cumsum(sizes) - sizes
    places = np.arange(len(codes)) - np.repeat(starts, sizes)
    letters = _CODES[np.minimum(codes, _TABLE - 1)]
    if len(rare := np.flatnonzero(codes >= _TABLE)):
        letters[rare] = mixed(codes[rare].astype(np.uint64))
    weights = _PLACES[np.minimum(places, _TABLE - 1)]
    if len(far := np.flatnonzero(places >= _TABLE)):
        weights[far] = mixed(places[far].astype(np.uint64) + np.uint64(1 << 40)) | np.uint64(1)
    return mixed(np.add.reduceat(letters * weights, starts)), counts
