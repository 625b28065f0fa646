"""CSV records of files of any size: blocks are read side by side and no file is held whole.

A line break belongs to a cell if the number of quotes before it in the file is odd (a doubled
quote counts twice). So one pass counts quotes and record starts in each block of lines, for both
cases of what stands before the block, and cuts first blocks into numbered records; running sums
over the few blocks of a file tell which case holds for the others and how many records came
before; and a second pass, where there are others, cuts these. Only records that lie across the border of two blocks are put together by a grouping.

Quotes stand around whole cells, or doubled inside these; lines end with LF or CRLF.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.session import checkpointed


def _lines(spark: SparkSession, path: str | Sequence[str], glob: str) -> DataFrame:
    """All lines, in order within a block: file, block (its first byte) and text."""
    text = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("lineSep", "\n")
        .text(path)
    )
    return text.select(
        F.col("_metadata.file_path").alias("task_file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, block, lines) of the stretches of a batch that come from one block."""
    if not batch.num_rows:
        return
    file = batch.column(0).dictionary_encode().indices.to_numpy()
    block = batch.column(1).to_numpy()
    change = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    edges = [0, *change.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.column(0)[a].as_py(), int(block[a]), batch.column(2).slice(a, b - a)


def _marks(lines: pa.Array, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line begins inside a quoted cell (and, last, the line after), and whether it is not blank."""
    quotes = pc.count_substring(lines, '"').to_numpy()
    before = (inside + np.concatenate(([0], np.cumsum(quotes)))) & 1
    blank = pc.is_in(lines, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
    return before, ~blank


class _Counts:
    """Quotes and record starts of the blocks of a task, in either case of what stands before a block."""

    def __init__(self):
        self.now, self.odd, self.starts = None, 0, [0, 0]

    def row(self) -> Iterator[pa.RecordBatch]:
        if self.now is not None:
            yield _rows(*self.now, counts=[self.odd, *self.starts])

    def add(self, file: str, block: int, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        if (file, block) != self.now:
            yield from self.row()
            self.now, self.odd, self.starts = (file, block), 0, [0, 0]
        before, filled = _marks(lines, self.odd)
        self.starts = [s + int((filled & (before[:-1] == case)).sum()) for case, s in enumerate(self.starts)]
        self.odd = int(before[-1])


_SCHEMA = "task_file string, block long, row_idx long, piece boolean, record string, odd long, starts_out long, starts_in long"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def _rows(file: str, block: int, numbers=(None,), texts=(None,), piece: bool = False, counts=(None,) * 3) -> pa.RecordBatch:
    """Records of a block, or the one row of its counts."""
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([file] * n, pa.string()),
            pa.array([block] * n, pa.int64()),
            pa.array(numbers, pa.int64()),
            pa.array([piece] * n, pa.bool_()),
            texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()),
            *(pa.array([c] * n, pa.int64()) for c in counts),
        ],
        _NAMES,
    )


def _block_key(file: str, block: int) -> int:
    return int(hashlib.md5(f"{file}\n{block}".encode()).hexdigest()[:15], 16)


class _Before:
    """What stands before each block but the first of its file: 16 bytes a block."""

    def __init__(self, counted: DataFrame):
        file = Window.partitionBy("task_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum("odd").over(file), F.lit(0)) % 2
        known = counted.withColumn("inside", inside)
        known = known.withColumn("starts", F.when(F.col("inside") == 0, F.col("starts_out")).otherwise(F.col("starts_in")))
        known = known.withColumn("records", F.coalesce(F.sum("starts").over(file), F.lit(0))).where("block > 0")
        key = F.conv(F.substring(F.md5(F.concat("task_file", F.lit("\n"), F.col("block").cast("string"))), 1, 15), 16, 10)
        rows = known.select(key.cast("bigint"), (F.col("records") * 2 + F.col("inside")).cast("bigint")).collect()
        table = np.array(sorted(map(tuple, rows)), np.int64).reshape(-1, 2)
        self.keys, self.values = table[:, 0], table[:, 1]

    def of(self, file: str, block: int) -> tuple[int, int]:
        """(records before, whether inside a quoted cell)"""
        if block == 0:
            return 0, 0
        key = _block_key(file, block)
        at = int(np.searchsorted(self.keys, key))
        if at == len(self.keys) or self.keys[at] != key:
            raise RuntimeError(f"{file} was cut into other blocks than before; read it again")
        return int(self.values[at]) >> 1, int(self.values[at]) & 1


class _Cutter:
    """Cuts the blocks of a task into records, given what stands before each block."""

    def __init__(self, of):
        self.of = of  # (file, block) -> records before, whether inside a quoted cell
        self.now, self.number, self.inside = None, 0, 0
        self.open: list[str] | None = None  # lines of a record that goes on
        self.piece = False  # whether that record began before this block

    def left_open(self) -> Iterator[pa.RecordBatch]:
        if self.open is not None:
            yield _rows(*self.now, [self.number - 2], ["\n".join(self.open)], True)

    def add(self, file: str, block: int, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        if (file, block) != self.now:
            yield from self.left_open()
            self.now = (file, block)
            self.number, self.inside = self.of(file, block)
            self.open, self.piece = ([], True) if self.inside else (None, False)
        before, filled = _marks(lines, self.inside)
        self.inside = int(before[-1])
        starts = filled & (before[:-1] == 0)
        # the header is record -1
        numbers = self.number + np.cumsum(starts) - 2
        single = np.flatnonzero(starts & (before[1:] == 0))
        if len(single):
            yield _rows(file, block, numbers[single], lines.take(pa.array(single)))
        ends = np.flatnonzero((before[:-1] == 1) & (before[1:] == 0))
        begins = np.flatnonzero(starts & (before[1:] == 1))
        if self.open is not None:
            stop = int(ends[0]) + 1 if len(ends) else len(lines)
            self.open += lines.slice(0, stop).to_pylist()
            if len(ends):
                yield _rows(file, block, [self.number - 2], ["\n".join(self.open)], self.piece)
                self.open, self.piece, ends = None, False, ends[1:]
        spans = list(zip(begins.tolist(), ends.tolist()))
        if spans:
            texts = ["\n".join(lines.slice(a, b - a + 1).to_pylist()) for a, b in spans]
            yield _rows(file, block, numbers[begins[: len(spans)]], texts)
        if len(begins) > len(ends):
            self.open = lines.slice(int(begins[-1])).to_pylist()
        self.number += int(starts.sum())


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of first blocks, before which nothing stands, and the counts of all blocks."""
    counts, cutter = _Counts(), _Cutter(lambda file, block: (0, 0))
    for batch in batches:
        for file, block, lines in _runs(batch):
            yield from counts.add(file, block, lines)
            if block == 0:
                yield from cutter.add(file, block, lines)
    yield from counts.row()
    yield from cutter.left_open()


def _second_pass(known: _Before):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(known.of)
        for batch in batches:
            for run_ in _runs(batch):
                yield from cutter.add(*run_)
        yield from cutter.left_open()

    return run


def read_records(spark: SparkSession, path: str | Sequence[str], glob: str = "*.csv") -> DataFrame:
    """Stored ``task_file, row_idx, record``: the text of every record, the first of a file at -1.

    Blank lines between records are no records. A file may be cut anywhere; its records and their
    numbers are the same.
    """
    lines = _lines(spark, path, glob)
    stored = checkpointed(lines.mapInArrow(_first_pass, _SCHEMA), "records")
    known = _Before(stored.where("odd IS NOT NULL"))
    stored = stored.where("record IS NOT NULL")
    whole = stored
    if len(known.keys):
        rest = lines.where("block > 0").mapInArrow(_second_pass(known), _SCHEMA)
        stored = stored.unionByName(checkpointed(rest, "records"))
        # at most two pieces a block
        pieces = F.array_sort(F.collect_list(F.struct("block", "record")))["record"]
        across = stored.where("piece").groupBy("task_file", "row_idx").agg(F.array_join(pieces, "\n").alias("record"))
        whole = stored.where("NOT piece").select("task_file", "row_idx", "record").unionByName(across)
    return whole.select("task_file", "row_idx", F.regexp_replace("record", "\r$", "").alias("record"))
