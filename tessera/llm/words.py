"""Words as 64-bit hashes, vectorised over many texts.

A word is a run of bytes other than ASCII white space and punctuation in the
lower-cased UTF-8 text.  Hashes are differences of one prefix sum over the
bytes, so no Python object is made per word.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np

_IN_WORD = np.ones(256, bool)
_IN_WORD[list(b" \t\n\r\x0b\x0c" + string.punctuation.encode())] = False
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SLICE = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def _hash_slice(raw: bytes, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word: differences of a prefix sum over the bytes."""
    b = np.frombuffer(raw, np.uint8)
    power, inverse = _powers(max(len(b) + 1, _SLICE))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=sums[1:])
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = in_word[b]
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    h = (sums[end] - sums[begin]) * inverse[begin]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29)), begin


def words_of_all(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, one after the other, and how many each text has."""
    return hashes_of([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])


def hashes_of(raw: list[bytes], in_word: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """The same for UTF-8 texts and any set of bytes that words are made of; a space is none of them."""
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    whole = b" ".join(raw)
    hashes, places, at = [], [], 0
    while at < len(whole):
        end = at + _SLICE
        while end < len(whole) and in_word[whole[end]]:  # slices end between words
            end += 1
        h, begin = _hash_slice(whole[at:end], in_word)
        hashes.append(h)
        places.append(begin + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(raw), np.int64)
    counts = np.diff(np.searchsorted(np.concatenate(places), bounds))
    return np.concatenate(hashes), counts


def words_of(text: str | None) -> np.ndarray:
    return words_of_all([text])[0]


def chunks(texts: Iterable[str | None], size: int = 1 << 20) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``size`` characters together."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "") + 1
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held
