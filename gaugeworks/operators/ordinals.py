"""Numbering rows within a group without gathering the group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column, name: str = "row_idx"
) -> DataFrame:
    """Position from 0 of each row within its group, by ``order``; NULLs form a group and come first.

    ``bucket`` must not decrease along the order and should cut a group into pieces one task can
    sort (a day of a timestamp, a range of an id). Rows are sorted within (group, bucket) only;
    the running total over buckets is taken on counts, one row per bucket.
    """
    cut = rows.withColumn("_bucket", bucket)
    sizes = cut.groupBy(*group, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = cut.withColumn("_position", F.row_number().over(within) - 1).alias("_row")
    same = reduce(and_, [F.col(f"_row.`{c}`").eqNullSafe(F.col(f"_at.`{c}`")) for c in [*group, "_bucket"]])
    return numbered.join(offsets.alias("_at"), same).select(
        *[F.col(f"_row.`{c}`") for c in rows.columns],
        (F.col("_at._offset") + F.col("_row._position")).alias(name),
    )


def first_rows(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], n: int, name: str = "sample_idx"
) -> DataFrame:
    """The first n rows of each group with their position from 0.

    Spark turns the bound on the row number into a group limit before the shuffle, so each map
    task sends at most n rows per group.
    """
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (
        rows.withColumn(name, position)
        .filter(F.col(name) <= n)
        .withColumn(name, F.col(name) - 1)
    )
