"""Four-gram BLEU of text pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import text
from gaugeworks.session import shuffle_partitions

ORDER = 4


def bleu(
    pairs: DataFrame,
    key: Sequence[str],
    reference: str = "reference",
    candidate: str = "candidate",
    partitions: int | None = None,
) -> DataFrame:
    """``key`` and ``bleu`` for every pair.

    ``key`` identifies a pair; the n-grams of pairs with equal keys are counted together. The words
    are shuffled once, by key, and sorted by it, and a task counts the n-grams of one pair at a time,
    so no n-gram is ever a row. Pairs of equal words score 1 and, like pairs of too few words, carry
    no words along.
    """
    key = list(key)
    count = partitions or shuffle_partitions(pairs.sparkSession)
    words = pairs.select(
        *key, text.tokens(F.col(reference)).alias("_r"), text.tokens(F.col(candidate)).alias("_c")
    )
    long_enough = (F.size("_r") >= ORDER) & (F.size("_c") >= ORDER)
    same = F.coalesce(long_enough & (F.col("_r") == F.col("_c")), F.lit(False))
    # words hold no blanks
    sides = [F.when(long_enough & ~same, F.array_join(c, " ")).alias(c) for c in ("_r", "_c")]
    placed = words.select(*key, same.alias("_same"), *sides).repartition(count, *key).sortWithinPartitions(*key)
    schema = T.StructType([placed.schema[k] for k in key])
    schema.add("_same", T.BooleanType())
    for name in _COUNTS:
        schema.add(name, T.LongType())
    return placed.mapInArrow(_count(len(key)), schema).select(*key, _score().alias("bleu"))


_COUNTS = ("_c_len", "_r_len", *[f"_m{n}" for n in range(1, ORDER + 1)])


class _Grams:
    """n-gram counts of the pairs of one key."""

    def __init__(self):
        self.same = False
        self.sides = [[Counter() for _ in range(ORDER)] for _ in range(2)]

    def add(self, same: bool, *texts: str | None) -> None:
        self.same |= same
        for line, counts in zip(texts, self.sides):
            if line is not None:
                shifted = [line.split(" ")]
                for counter in counts:
                    counter.update(zip(*shifted))
                    shifted.append(shifted[-1][1:])

    def row(self) -> tuple:
        (r, *_), (c, *_) = self.sides
        matches = (sum(min(a[g], b[g]) for g in a.keys() & b.keys()) for a, b in zip(*self.sides))
        return self.same, c.total(), r.total(), *matches


def _count(n_key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None  # rows of a key follow each other, across batches too
        kinds = None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kinds = [*batch.schema.types[: n_key], pa.bool_(), *[pa.int64()] * len(_COUNTS)]
            names = [*batch.schema.names[: n_key], "_same", *_COUNTS]
            done = []
            keys = zip(*[c.to_pylist() for c in batch.columns[:n_key]])
            for key, *pair in zip(keys, *[c.to_pylist() for c in batch.columns[n_key:]]):
                if held is None or key != now:
                    if held is not None:
                        done.append((*now, *held.row()))
                    now, held = key, _Grams()
                held.add(*pair)
            if done:
                yield rows(done)
        if held is not None:
            yield rows([(*now, *held.row())])

    return run


def _score() -> Column:
    """Geometric mean of the precisions times the brevity penalty.

    A precision without matches becomes 1 / (2^j * n-grams), j counting such precisions from 1.
    """
    c_len, r_len = F.col("_c_len"), F.col("_r_len")
    logs, misses = F.lit(0.0), F.lit(0)
    for n in range(1, ORDER + 1):
        total = (c_len - (n - 1)).cast("double")
        none = F.col(f"_m{n}") == 0
        misses = misses + none.cast("int")
        logs = logs + F.log(F.when(none, 1 / (F.pow(F.lit(2.0), misses) * total)).otherwise(F.col(f"_m{n}") / total))
    penalty = F.when(c_len > r_len, F.lit(1.0)).otherwise(F.exp(1 - r_len / c_len))
    return (
        F.when(F.col("_same"), F.lit(1.0))
        .when(F.coalesce(F.col("_m1"), F.lit(0)) == 0, F.lit(0.0))
        .otherwise(penalty * F.exp(logs / ORDER))
    )
