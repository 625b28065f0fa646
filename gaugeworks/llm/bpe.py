"""Byte-level BPE: whole texts to ids with character offsets, and back.

The tokenizers library merges characters, so each byte is first mapped to a printable character;
decoding goes back through the table of token bytes, where one character may take several tokens. The ids are
those that a rank table defines: of all neighbours whose joined bytes have a rank, the pair of
lowest rank is joined first, the leftmost of equals.

NULL texts count as empty and give no ids. Rows are independent of each other: repeated rows give
repeated results, an empty table an empty one, and columns other than those named are not read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.batches import bounded
from gaugeworks.llm.words import Pieces, WordIds, slices, spaced_chunks, spelt


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by the definition: join the leftmost pair of lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        best = min((r for r in found if r is not None), default=None)
        if best is None:
            break
        at = found.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def split_pattern(pattern: str):
    """Matches of a tokenizer's splitting pattern, whose white space is that of Unicode."""
    spaces = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return regex.compile(spaces).findall


class RankPieces(Pieces):
    """Ids of words by a rank table.

    The library joins pairs in a fixed order, so it is given every split of a token into two
    tokens, by rank. Where one token overlaps itself in three neighbours ("----"), its splits
    would compete by place, which such an order cannot say: pieces with such a run are merged by
    the definition instead.
    """

    def __init__(self, ranks: dict[bytes, int], split, offsets: bool) -> None:
        import ahocorasick
        from tokenizers import models

        names = {token: spelt(token) for token in ranks}
        merges, overlapping = [], set()
        for token in sorted(ranks, key=ranks.__getitem__):
            cuts = [c for c in range(1, len(token)) if token[:c] in ranks and token[c:] in ranks]
            merges += [(names[token[:c]], names[token[c:]]) for c in cuts]
            if len(cuts) > 1:
                overlapping |= {
                    token[:c] + token
                    for c in cuts
                    if token[c:] == token[:-c] and token[-c:] in ranks
                }
        super().__init__(models.BPE({names[t]: r for t, r in ranks.items()}, merges), split)
        self._ranks, self._offsets = ranks, offsets
        self._length = {rank: len(token) for token, rank in ranks.items()}
        self._overlaps = ahocorasick.Automaton()
        for run in overlapping or {bytes(1 << 16)}:
            self._overlaps.add_word(run.decode("latin-1"), True)
        self._overlaps.make_automaton()

    def ids(self, piece: str) -> list[int]:
        content = piece.encode()
        if next(self._overlaps.iter(content.decode("latin-1")), None):
            return merge_by_rank(content, self._ranks)
        return super().ids(piece)

    def __call__(self, words: list[str]):
        if not self._offsets:
            yield from super().__call__(words)
            return
        for word in words:
            ids = [i for piece in self._split(word) for i in self.ids(piece)]
            character = [n for n, c in enumerate(word) for _ in c.encode()]
            stops = list(accumulate(map(self._length.__getitem__, ids)))
            first = [character[x] for x in [0, *stops[:-1]]] if ids else []
            yield ids, first, [character[x - 1] + 1 for x in stops]


class RankCodec:
    """Texts to ids by a rank table and a splitting pattern, and back."""

    def __init__(self, path: str, pattern: str, offsets: bool = False) -> None:
        self.ranks = read_ranks(path)
        self.bytes_of = np.full(max(self.ranks.values()) + 1, b"", object)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        split = split_pattern(pattern)
        self._words = WordIds(RankPieces(self.ranks, split, offsets), spaced_chunks, split, offsets)

    def encode(self, texts: list[str]):
        """See ``WordIds.encode``."""
        return self._words.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[ids].tolist())

    def decode_pieces(self, ids: Iterable[int]) -> list[str]:
        """Text of each id; a character split over ids belongs to the id that completes it.

        Bytes that never become a character are U+FFFD, at the id where that is certain.
        """
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        tokens = [self.bytes_of[i] for i in ids]
        return [reader.decode(t, final=n == len(tokens)) for n, t in enumerate(tokens, 1)]


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str, offsets: bool = False) -> RankCodec:
    return RankCodec(path, pattern, offsets)


def _texts(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    return [text or "" for text in batch.column(column).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ids, and each id's first character and the one after its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern, True)
        for batch in batches:
            done = 0
            for texts in slices(_texts(batch)):
                ids, ends, first, last = codec.encode(texts)
                bounds = pa.array(np.concatenate(([0], ends)), pa.int32())
                lists = [
                    pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32)))
                    for x in (ids, first, last)
                ]
                keys = batch.column(0).slice(done, len(texts))
                yield pa.RecordBatch.from_arrays([keys, *lists], ["key", "ids", "first", "last"])
                done += len(texts)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, ids array<int>, first array<int>, last array<int>"
    return bounded(docs).select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: the key, the bytes that its ids stand for, and the text piece of each id.

    NULL ids count as none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            content = pa.array([codec.decode(np.array(x, np.int64)) for x in lists], pa.binary())
            pieces = pa.array([codec.decode_pieces(x) for x in lists], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), content, pieces], ["key", "content", "pieces"]
            )

    kind = encoded.schema[key].dataType.simpleString()
    schema = f"key {kind}, content binary, pieces array<string>"
    return encoded.select(key, ids).mapInArrow(run, schema).withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode whole texts, decode the ids, and return digests of both.

    n_tokens, the SHA-256 of the decimal ids joined by blanks, and that of the decoded bytes. The
    ids stay inside the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        decimal = np.array([str(i) for i in range(len(codec.bytes_of))], object)
        for batch in batches:
            sizes, of_ids, of_bytes = [], [], []
            for texts in slices(_texts(batch)):
                ids, ends = codec.encode(texts)
                begin = 0
                for end in ends.tolist():
                    own = ids[begin:end]
                    sizes.append(end - begin)
                    joined = " ".join(decimal[own].tolist())
                    of_ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(codec.decode(own)).hexdigest())
                    begin = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
