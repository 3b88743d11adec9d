"""Keys of normalised texts for inverted indexes, in numpy: word n-grams, and character n-grams that every long enough piece of a text shares with it."""

from __future__ import annotations

import numpy as np

#: A piece of WIDTH characters holds the minimal one of its GRAM-character n-grams, wherever it was cut.
WIDTH, GRAM = 25, 13
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _joined(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n hashes, from those of half the length."""
    size, own = 1, x
    while size * 2 <= n:
        own = _mixed(own[:-size] * _ODD + own[size:])
        size *= 2
    return _mixed(own[: len(own) - (n - size)] * _ODD + own[n - size :]) if size < n else own


def piece_keys(text: str, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """Distinct minimal n-grams of all windows of width characters; none if the text is shorter. A text that
    holds another of at least width characters has all of that one's."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < width:
        return np.zeros(0, np.int64)
    hashes, size = _joined(_mixed(codes + np.uint64(1)), gram), 1
    wide = width - gram + 1
    while size * 2 <= wide:
        hashes = np.minimum(hashes[:-size], hashes[size:])
        size *= 2
    if size < wide:
        hashes = np.minimum(hashes[: len(hashes) - (wide - size)], hashes[wide - size :])
    return np.unique(hashes).view(np.int64)


def word_keys(text: str, n: int = 4) -> np.ndarray:
    """Distinct n-grams of a text's words; the text's own if it has fewer."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    space = data == 32
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data))) if starts[0] == 0 else None
    if place is None:
        raise ValueError("normalised texts don't begin with a blank")
    with np.errstate(over="ignore"):
        letters = np.where(space, 0, _mixed((data.astype(np.uint64) + np.uint64(1)) * _ODD + place.astype(np.uint64)))
        words = _mixed(np.add.reduceat(letters, starts))
    return np.unique(_joined(words, min(n, len(words))) ^ _MIX).view(np.int64)


class KeySet:
    """A set of keys as bits of a bounded table: says yes for all its keys, and for few others while it isn't full."""

    def __init__(self, words: int):
        self.bits = np.zeros(words, np.uint64)

    def add_words(self, word: list[int], bits: list[int]) -> None:
        self.bits[np.array(word, np.int64)] = np.array(bits, np.int64).view(np.uint64)

    def __contains__(self, key: int) -> bool:
        return bool(self.hits(np.array([key]))[0])

    def hits(self, keys: np.ndarray) -> np.ndarray:
        bit = (keys.view(np.uint64) >> np.uint64(40)) & np.uint64(63)
        return (self.bits[keys & (len(self.bits) - 1)] >> bit & np.uint64(1)).astype(bool)
