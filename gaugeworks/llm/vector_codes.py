"""Short codes of vectors: each part's nearest codebook entry, found through memoised grid cells.

A vector of integers floor(256 x) is cut into parts. The coarse cell of a part is a box of the
grid; an entry whose least distance to the box is above another entry's greatest one is nearest
to no point in it. The entries left are remembered for each cell, and only these are evaluated
exactly, so the memory changes the time and never the code.

Codebooks start as parts of the vectors with the lowest ids and move to the floor of the mean of
their parts in each round; rounds add up whole numbers over all tasks. The codebooks (parts x
entries x width of a part) are the only thing that the driver and all tasks hold.

Rows whose vector is NULL or holds NULL or non-finite entries are left out, as are vectors of
another length than most; if that length is no multiple of the parts, the first parts are one
longer. Integers stop at 2^26 either way. Rows without vec_id are coded too and open no
codebook unless too few have one; of equal ids the lower vector comes first. Repeated rows count
as often as they occur. With fewer vectors than entries, codebooks are as small. Ties go to the lower
entry. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.batches import bounded
from gaugeworks.llm.vector_batches import array_sum, clean_vectors, floored, matrix

FACTOR = 256
MOST = 1 << 26
PARTS = 16
ENTRIES = 64
ROUNDS = 2
REMEMBERED = 1 << 16  # cells of a part that a worker keeps; beyond it starts anew
SALTS = 16


def part_bounds(length: int, parts: int) -> np.ndarray:
    """First places of equal consecutive parts, and the end."""
    sizes = np.full(parts, length // parts)
    sizes[: length % parts] += 1
    return np.concatenate(([0], np.cumsum(sizes)))


def cell_width(entries: np.ndarray) -> int:
    """Side of the grid's boxes: about the usual distance from an entry to the next one, by dimension."""
    if len(entries) < 2 or not entries.shape[1]:
        return 1
    apart = ((entries[:, None, :] - entries[None, :, :]).astype(float) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    return max(1, int(np.sqrt(np.median(apart.min(axis=1)) / entries.shape[1])))


class Cells:
    """Nearest entries of one part's codebook, with the entries that matter remembered by cell."""

    def __init__(self, entries: np.ndarray, width: int | None = None, remembered: int = REMEMBERED):
        self.entries, self.remembered = entries, remembered
        self.width = width or cell_width(entries)
        self.place: dict[bytes, int] = {}
        self.matter = np.zeros((0, len(entries)), bool)
        self.evaluated = 0

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """For each box, the entries that no other entry dominates all over it."""
        low = (cells * self.width)[:, None, :]
        high = low + self.width - 1
        below, above = low - self.entries, self.entries - high
        nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
        farthest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
        return nearest <= farthest.min(axis=1, keepdims=True)

    def _known(self, cells: np.ndarray) -> np.ndarray:
        """Rows of ``matter`` of the distinct cells, which are added where they are new."""
        if len(self.place) + len(cells) > self.remembered:
            self.place, self.matter = {}, self.matter[:0]
        names = [c.tobytes() for c in cells]
        new = [i for i, name in enumerate(names) if name not in self.place]
        if new:
            self.place.update(zip((names[i] for i in new), range(len(self.matter), len(self.matter) + len(new))))
            self.matter = np.concatenate([self.matter, self.candidates(cells[new])])
        return np.array([self.place[name] for name in names], np.int64)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part, of equally near entries the lowest."""
        if not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        cells = np.ascontiguousarray(parts // self.width)
        packed = cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel()
        _, first, of = np.unique(packed, return_index=True, return_inverse=True)
        matter = self.matter_of(cells[first])[of.ravel()]
        row, entry = np.nonzero(matter)
        self.evaluated += len(row)
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        begin = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(distance, begin)
        lowest = np.where(distance == least[row], entry, len(self.entries))
        return np.minimum.reduceat(lowest, begin), least

    def matter_of(self, cells: np.ndarray) -> np.ndarray:
        """``candidates`` of distinct cells through the memory, in slices that it can hold."""
        step = max(1, min(self.remembered, 4096))
        found = []
        for at in range(0, len(cells), step):
            known = self._known(cells[at : at + step])
            found.append(self.matter[known])
        return np.concatenate(found)


def assign(vectors: np.ndarray, bounds: np.ndarray, books: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances) of all parts, a column for each."""
    whole = floored(vectors, FACTOR, MOST)
    both = [book.nearest(whole[:, a:b]) for book, a, b in zip(books, bounds, bounds[1:])]
    return np.stack([x for x, _ in both], axis=1), np.stack([x for _, x in both], axis=1)


def first_codebooks(rows: DataFrame, key: str, length: int, parts: int, entries: int) -> list[np.ndarray]:
    first = rows.orderBy(F.col(key).asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    whole = floored(np.array([r.vector for r in first]).reshape(len(first), length), FACTOR, MOST)
    bounds = part_bounds(length, parts)
    return [whole[:, a:b] for a, b in zip(bounds, bounds[1:])]


def moved(rows: DataFrame, length: int, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: floors of the means of the parts that each entry is nearest to."""
    bounds = part_bounds(length, len(codebooks))
    size = len(codebooks[0])
    widest = int(np.diff(bounds).max())
    books: list[Cells] = []

    def sums(v: np.ndarray) -> np.ndarray:
        if not books:
            books.extend(Cells(c) for c in codebooks)
        entry, _ = assign(v, bounds, books)
        whole = floored(v, FACTOR, MOST)
        total = np.zeros((len(codebooks) * size, widest + 1), np.int64)
        for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
            at = entry[:, p] + p * size
            np.add.at(total[:, 0], at, 1)
            for i in range(b - a):
                np.add.at(total[:, i + 1], at, whole[:, a + i])
        return total

    found = array_sum(rows, length, sums, "i8")
    out = []
    for p, old in enumerate(codebooks):
        own = found[p * size : (p + 1) * size]
        used = own[:, :1] > 0
        out.append(np.where(used, own[:, 1 : old.shape[1] + 1] // np.maximum(own[:, :1], 1), old))
    return out


def fit(
    rows: DataFrame, key: str, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> list[np.ndarray]:
    """Codebooks, one a part, learned from all ``rows`` (key, vector)."""
    codebooks = first_codebooks(rows, key, length, parts, entries)
    for _ in range(rounds if len(codebooks[0]) else 0):
        codebooks = moved(rows, length, codebooks)
    return codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    numbers = ",".join(str(x) for book in codebooks for x in book.ravel().tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def encode(rows: DataFrame, length: int, codebooks: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part; four above 256 entries) and error of every row (vec_id, label, vector)."""
    bounds = part_bounds(length, len(codebooks))
    digits = 2 if len(codebooks[0]) <= 256 else 4
    names = np.array([f"{i:0{digits}x}" for i in range(len(codebooks[0]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Cells(c) for c in codebooks]
        for batch in batches:
            if not batch.num_rows:
                continue
            entry, distance = assign(matrix(batch.column(2), length), bounds, books)
            codes = ["".join(row) for row in names[entry].tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes), pa.array(distance.sum(axis=1))],
                ["vec_id", "label", "code", "error"],
            )

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "vector").mapInArrow(
        run, f"vec_id long, label {label}, code string, error long"
    )


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the sum of the error over all rows of an equal label, NULLs together.

    The sums are copied to every salt, so rows of a frequent label are dealt to several tasks.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    copies = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    same = F.col("label").eqNullSafe(F.col("_label")) & (salted["_salt"] == copies["_salt"])
    return salted.join(copies, same).select(*coded.columns, "label_error")


def compress(
    table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row (vec_id, embedding, label)."""
    source = bounded(table).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    rows, length = clean_vectors(source, "embedding", "vec_id", "label")
    codebooks = fit(rows, "vec_id", length, parts, entries, rounds)
    coded = with_label_error(encode(rows, length, codebooks))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
