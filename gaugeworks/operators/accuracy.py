"""Accuracy and mean scores per group, as rows (group, metric, key, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.operators.samples import with_prompt
from gaugeworks.schemas import GROUP, LEVELS, TASK_KEY


def metric_rows(
    wide: DataFrame, group: Sequence[str], metrics: Sequence[tuple[str, str, Column]]
) -> DataFrame:
    """One row per metric from one row per group; a metric is (name, key, value)."""
    rows = [
        F.struct(
            F.lit(metric).alias("metric"), F.lit(key).alias("key"), value.cast("double").alias("value")
        )
        for metric, key, value in metrics
    ]
    return wide.select(*group, F.inline(F.array(*rows)))


def scored_rows(samples: DataFrame, sample_idx: int = 0) -> DataFrame:
    """The rows a report counts: one sample per task, prompt present, flags never NULL."""
    rows = with_prompt(samples).filter(F.col("sample_idx") == sample_idx)
    plannable = F.coalesce(F.col("plannable"), F.lit(False))
    success = F.coalesce(F.col("verdict") == "Success", F.lit(False))
    return rows.withColumns({"plannable": plannable, "correct": plannable & success})


def counters(samples: DataFrame, group: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """Rows, plannable rows and correct rows per group; a group without rows has no entry."""
    return (
        scored_rows(samples)
        .groupBy(*group)
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if("plannable").alias("n_plannable"),
            F.count_if("correct").alias("n_correct"),
        )
    )


def accuracy(samples: DataFrame, group: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """Overall and plan-only accuracy."""
    n = F.col("n_rows")
    return metric_rows(
        counters(samples, group),
        group,
        [
            ("accuracy", "", F.col("n_correct") / n),
            ("plan_accuracy", "", F.col("n_plannable") / n),
        ],
    )


def accuracy_by_level(
    samples: DataFrame,
    tasks: DataFrame,
    group: Sequence[str] = tuple(GROUP),
    levels: Sequence[int] = tuple(LEVELS),
) -> DataFrame:
    """Accuracy per difficulty level, 0 where a group has no task of the level.

    Samples are counted per task first, so the join moves one row per task and group even when a
    single task holds a large share of all samples. All levels come from one aggregation.
    """
    per_task = (
        scored_rows(samples)
        .groupBy(*group, *TASK_KEY)
        .agg(F.count("*").alias("n_rows"), F.count_if("correct").alias("n_correct"))
    )
    joined = per_task.join(tasks.select(*TASK_KEY, "difficulty"), TASK_KEY)
    sums = []
    for level in levels:
        here = F.col("difficulty") == level
        sums.append(F.sum(F.when(here, F.col("n_rows"))).alias(f"rows_{level}"))
        sums.append(F.sum(F.when(here, F.col("n_correct"))).alias(f"correct_{level}"))
    return metric_rows(
        joined.groupBy(*group).agg(*sums),
        group,
        [
            (
                "accuracy_by_level",
                str(level),
                F.coalesce(F.try_divide(F.col(f"correct_{level}"), F.col(f"rows_{level}")), F.lit(0.0)),
            )
            for level in levels
        ],
    )


def mean_by_correctness(
    scored: DataFrame, metrics: Sequence[tuple[str, str]], group: Sequence[str] = tuple(GROUP)
) -> DataFrame:
    """Mean of each score over all, the correct and the incorrect rows.

    ``metrics`` are (metric name, score column); ``scored`` needs a boolean ``correct``. Without
    correct rows their mean is 0; without incorrect rows theirs is NULL.
    """
    aggregates, rows = [], []
    for metric, column in metrics:
        score = F.col(column)
        aggregates += [
            F.avg(score).alias(f"{metric}_all"),
            F.avg(F.when(F.col("correct"), score)).alias(f"{metric}_correct"),
            F.avg(F.when(~F.col("correct"), score)).alias(f"{metric}_incorrect"),
        ]
        rows += [
            (metric, "", F.col(f"{metric}_all")),
            (metric, "correct", F.coalesce(F.col(f"{metric}_correct"), F.lit(0.0))),
            (metric, "incorrect", F.col(f"{metric}_incorrect")),
        ]
    return metric_rows(scored.groupBy(*group).agg(*aggregates), group, rows)


def exact_match_rate(
    pairs: DataFrame,
    group: Sequence[str],
    reference: str = "reference",
    candidate: str = "candidate",
) -> DataFrame:
    same = text.exact_match(F.col(reference), F.col(candidate))
    wide = pairs.groupBy(*group).agg(F.avg(F.coalesce(same, F.lit(False)).cast("double")).alias("rate"))
    return metric_rows(wide, group, [("exact_match", "", F.col("rate"))])


def mean_scores(scored: DataFrame, columns: Sequence[str], group: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """Plain means of score columns."""
    wide = scored.groupBy(*group).agg(*[F.avg(c).alias(c) for c in columns])
    return metric_rows(wide, group, [(c, "", F.col(c)) for c in columns])
