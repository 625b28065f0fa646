"""Numeric vectors of a table as numpy batches, and sums over all tasks of arrays that tasks make."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = 64


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    entry = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, entry)


def usual_length(vectors: DataFrame, name: str) -> int:
    """The length that most vectors have, of equally frequent ones the longest; 0 without vectors."""
    sizes = vectors.groupBy(F.size(name).alias("length")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("length")).first()
    return first.length if first else 0


def clean_vectors(table: DataFrame, name: str, *others: str) -> tuple[DataFrame, int]:
    """(``others`` and ``vector`` as doubles of the rows with a vector of finite entries, its length).

    Vectors of another length than most are left out, as they cannot be compared with the rest.
    """
    rows = table.where(is_finite(F.col(name))).select(*others, F.col(name).cast("array<double>").alias("vector"))
    length = usual_length(rows, "vector")
    return rows.where(F.size("vector") == length), length


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The vectors of an Arrow column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def floored(values: np.ndarray, factor: int, most: int) -> np.ndarray:
    """floor(factor * value) as integers; beyond ``most`` they stay there, so that no sum runs over."""
    return np.clip(np.floor(factor * values), -most, most).astype(np.int64)


def array_sum(rows: DataFrame, length: int, make: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray | None:
    """The sum over all batches of ``rows`` (vector) of the arrays that ``make`` gives; None without rows.

    Each task adds up its own batches and emits the array's rows; they meet in two steps, so a
    task adds at most one row from each of a 64th of the tasks.
    """
    number = np.dtype(kind)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                own = np.atleast_2d(make(matrix(batch.column(0), length))).astype(number)
                total = own if total is None else total + own
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(n), pa.int32()),
                    pa.array([TaskContext.get().partitionId() % _PARTS] * n, pa.int32()),
                    pa.array([np.ascontiguousarray(row).tobytes() for row in total], pa.binary()),
                ],
                ["line", "part", "numbers"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), number) for x in table["numbers"])
        return pa.table({"line": pa.array([table["line"][0].as_py()], pa.int32()), "numbers": [total.tobytes()]})

    schema = "line int, numbers binary"
    parts = rows.select("vector").mapInArrow(per_task, "line int, part int, numbers binary")
    some = parts.groupBy("line", "part").applyInArrow(add, schema)
    found = some.groupBy("line").applyInArrow(add, schema).orderBy("line").collect()
    return np.stack([np.frombuffer(r.numbers, number) for r in found]) if found else None
