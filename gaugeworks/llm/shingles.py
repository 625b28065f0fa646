"""Hashes of all word shingles of a batch of texts, without a Python step for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_A = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xC2B2AE3D27D4EB4F
_SLICE_CHARS = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over the whole range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _A)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every word, A-Z lowered; words are parted by ASCII white space."""
    hashes, of, *_ = word_spans([t.encode() for t in texts])
    return hashes, of


def word_spans(content: list[bytes]) -> tuple[np.ndarray, ...]:
    """(hash, number of its text, first byte, byte after the last) of every word, and all bytes.

    A word's hash is a polynomial in its bytes, spread over 64 bits together with its length.
    """
    data = np.frombuffer(b"\n".join(content).lower(), np.uint8)
    inside = ~_SPACE[data]
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64), first, last, data
    size = last - first
    place = np.arange(first[0], len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    power = powers(int(size.max()) + 1)
    terms = _BYTE[data[first[0] :]] * power[np.minimum(place, len(power) - 1)]
    terms[~inside[first[0] :]] = 0
    sums = np.add.reduceat(terms, first - first[0])
    ends = np.cumsum([len(c) + 1 for c in content]) - 1
    hashes = mixed(sums ^ (size.astype(np.uint64) * _A))
    return hashes, np.searchsorted(ends, first, side="right"), first, last, data


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct shingles of each text, ascending, one text after the other.

    A text of fewer words than ``width`` has one shingle, all its words; one without words none.
    """
    hashes, of = word_hashes(texts)
    n = len(texts)
    words = np.bincount(of, minlength=n)
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64) * _A) | np.uint64(1)
    total = np.zeros(len(hashes), np.uint64)
    for i in range(min(width, len(hashes))):
        same = of[i:] == of[: len(of) - i]
        total[: len(of) - i] += np.where(same, hashes[i:] * factors[i], np.uint64(0))
    nth = np.arange(len(of)) - (np.cumsum(words) - words)[of]
    starts = nth < np.maximum(words - width + 1, np.minimum(words, 1))[of]
    found = mixed(total[starts] + np.minimum(words, width)[of[starts]].astype(np.uint64))
    texts_of = of[starts].astype(np.uint16 if n <= 1 << 16 else np.int64)
    order = np.argsort(found)
    order = order[np.argsort(texts_of[order], kind="stable")]
    found, texts_of = found[order], texts_of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (texts_of[1:] != texts_of[:-1])
    return found[new], np.bincount(texts_of[new], minlength=n)


def sliced(texts: list[str]) -> Iterator[list[str]]:
    """Lists of texts of bounded size, and of at most 2^16 texts."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 16
        if size >= _SLICE_CHARS or len(held) == 1 << 16:
            yield held
            held, size = [], 0
    if held:
        yield held
