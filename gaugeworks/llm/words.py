"""Token ids of whole texts, with one library call per distinct word.

A word-wise tokenizer never merges across the cuts made here, so a text's ids are its words'
ids in order. Each Python worker keeps the ids of words it has met, up to a bound, and looks
all other words of a batch up at once; the library encodes only new words.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np

# a text with other white space than single blanks and line feeds takes the general way
_ODD_SPACE = re.compile(
    "[\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]"
)
CACHED_WORDS = 600_000  # words whose ids a worker remembers, about 250 bytes each
_SLICE_CHARS = 2_000_000


def is_plain(text: str) -> bool:
    """Whether all white space of ``text`` is single blanks and line feeds between words."""
    return not (
        "  " in text
        or "\n\n" in text
        or " \n" in text
        or "\n " in text
        or text[:1] in (" ", "\n")
        or text[-1:] in (" ", "\n")
        or _ODD_SPACE.search(text)
    )


def spaced_chunks(text: str) -> list[str]:
    """A plain text in pieces that a byte-level pattern never joins; together they are the text."""
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")


def slices(texts: Iterable[str], chars: int = _SLICE_CHARS) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``chars`` characters, so that arrays stay small."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Index(dict):
    """Numbers new keys in the order they come and remembers them for encoding."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordIds:
    """Ids of texts through ``encode``, which maps words to (ids, char starts, char ends).

    ``cut`` gives the words of a plain text, ``cut_any`` those of any text; both must cut only
    where the tokenizer does. Only with ``offsets`` are the character places kept.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], Iterable[tuple[list[int], list[int], list[int]]]],
        cut: Callable[[str], list[str]],
        cut_any: Callable[[str], list[str]],
        offsets: bool = False,
        remember: int | None = None,
    ) -> None:
        self._encode, self._cut, self._cut_any, self._offsets = encode, cut, cut_any, offsets
        self._remember = remember
        self._index = _Index()
        self._seen = np.empty(0, np.int64)
        self._ends = np.zeros(1, np.int64)
        self._ids = self._first = self._last = np.empty(0, np.uint32)

    def _learn(self) -> None:
        new, self._index.new = self._index.new, []
        ids, first, last, sizes = array("I"), array("I"), array("I"), array("q")
        for own, begins, ends in self._encode(new):
            ids.extend(own)
            sizes.append(len(own))
            if self._offsets:
                first.extend(begins)
                last.extend(ends)
        self._ids = np.concatenate((self._ids, np.array(ids, np.uint32)))
        self._first = np.concatenate((self._first, np.array(first, np.uint32)))
        self._last = np.concatenate((self._last, np.array(last, np.uint32)))
        self._ends = np.concatenate((self._ends, self._ends[-1] + np.cumsum(sizes, dtype=np.int64)))
        self._seen = np.concatenate((self._seen, np.zeros(len(sizes), np.int64)))

    def _forget(self) -> None:
        """Drop the words met once; if half the room is still taken, drop all."""
        keep = np.flatnonzero(self._seen > 1)
        if len(keep) > (self._remember or CACHED_WORDS) // 2:
            keep = keep[:0]
        words = np.array([*self._index, ""], object)[keep].tolist()
        take, size = self._places(keep)
        self._index = _Index()
        self._index.update(zip(words, range(len(words))))
        self._ids = self._ids[take]
        if self._offsets:
            self._first, self._last = self._first[take], self._last[take]
        self._ends = np.concatenate(([0], np.cumsum(size)))
        self._seen = np.zeros(len(keep), np.int64) + 1

    def _places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the given words are, one after the other, and how many each has."""
        begin = self._ends[words]
        size = self._ends[words + 1] - begin
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        return np.arange(total) + np.repeat(begin - after + size, size), size

    def encode(self, texts: list[str]):
        """(ids, ends) of a list of texts: the ids of all of them, and where each text's ids end.

        With ``offsets`` also each id's first character in its text and the one after its last.
        """
        if len(self._index) > (self._remember or CACHED_WORDS):
            self._forget()
        found, sizes, shifts = [], [], []
        look = self._index.__getitem__
        for text in texts:
            words = (self._cut if is_plain(text) else self._cut_any)(text)
            found.append(np.fromiter(map(look, words), np.int64, len(words)))
            sizes.append(len(words))
            if self._offsets:
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                shifts.append(np.cumsum(lengths) - lengths)
        self._learn()
        words = np.concatenate(found) if found else np.empty(0, np.int64)
        self._seen += np.bincount(words, minlength=len(self._seen))
        take, size = self._places(words)
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(sizes, dtype=np.int64)]
        if not self._offsets:
            return self._ids[take], ends
        shift = np.repeat(np.concatenate(shifts) if shifts else words, size)
        return self._ids[take], ends, self._first[take] + shift, self._last[take] + shift


def byte_characters() -> list[str]:
    """The character for each byte: itself if printable, else one from U+0100 on, in byte order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(byte if byte in shown else next(others)) for byte in range(256)]


SHOWN = dict(enumerate(byte_characters()))


def spelt(content: bytes) -> str:
    """Bytes as the characters that byte-level vocabularies are written in."""
    return content.decode("latin-1").translate(SHOWN)


class Pieces:
    """Ids of words by a model of the tokenizers library, which sees one piece at a time.

    ``split`` cuts a word into pieces. Calling the model itself spares the library's own cutting
    and its result objects, most of the time for new words. Ids of short pieces are kept.
    """

    def __init__(self, model, split: Callable[[str], list[str]]) -> None:
        self._model, self._split = model, split
        self._short: dict[str, list[int]] = {}

    def ids(self, piece: str) -> list[int]:
        return [t.id for t in self._model.tokenize(spelt(piece.encode()))]

    def __call__(self, words: list[str]) -> Iterator[tuple[list[int], tuple, tuple]]:
        short = self._short
        for word in words:
            ids: list[int] = []
            for piece in self._split(word):
                if len(piece) > 3:
                    ids += self.ids(piece)
                else:
                    if piece not in short:
                        if len(short) > 1 << 16:
                            short.clear()
                        short[piece] = self.ids(piece)
                    ids += short[piece]
            yield ids, (), ()
