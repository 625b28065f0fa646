"""Bounded Arrow batches for rows with whole texts, and memory given back after a task."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, after lowering the session's batch bounds to these where they are higher.

    The defaults of 10,000 rows would hand a Python worker hundreds of megabytes of long texts at once.
    """
    conf = docs.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        try:
            now = int(conf.get(key))
        except ValueError:  # a size with a unit
            now = 0
        if not 0 < now <= most:
            conf.set(key, most)
    return docs


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker returns the memory it no longer uses to the system.

    Workers stay for further tasks; what the C library keeps for them is lost to the executor.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped
