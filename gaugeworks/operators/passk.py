"""Mean unbiased pass@k per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import scores
from gaugeworks.operators.samples import first_samples, with_prompt
from gaugeworks.schemas import GROUP


def mean_pass_at_k(
    counts: DataFrame, n: int, ks: Sequence[int], group: Sequence[str] = tuple(GROUP)
) -> DataFrame:
    """Rows (group, metric, k, value) from per-task counts.

    Tasks are first counted by their number of correct samples, which leaves at most n + 1 rows
    per group and metric; the estimator runs on those only.
    """
    kinds = F.array(
        F.struct(F.lit("pass@k").alias("metric"), F.col("n_correct").alias("c")),
        F.struct(F.lit("pass@k-plan").alias("metric"), F.col("n_plannable").alias("c")),
    )
    by_count = (
        counts.select(*group, F.inline(kinds))
        .groupBy(*group, "metric", "c")
        .agg(F.count("*").alias("n_tasks"))
    )
    return mean_of_counts(by_count, n, ks, group)


def mean_of_counts(
    by_count: DataFrame, n: int, ks: Sequence[int], group: Sequence[str] = tuple(GROUP)
) -> DataFrame:
    """Rows (group, metric, k, value) from the number of tasks (n_tasks) with c correct samples of n."""
    per_k = by_count.withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])))
    estimate = scores.pass_at_k(F.lit(n).cast("bigint"), F.col("c"), F.col("k"))
    return per_k.groupBy(*group, "metric", "k").agg(
        (F.sum(F.col("n_tasks") * estimate) / F.sum("n_tasks")).alias("value")
    )


def pass_at_k_report(
    samples: DataFrame,
    n: int,
    ks: Sequence[int] | None = None,
    group: Sequence[str] = tuple(GROUP),
    strict: bool = True,
) -> DataFrame:
    """Mean pass@k, by verdict and by plan only, over the first n samples of every task.

    A task with fewer than n samples is an error. Unless ``strict``, such tasks are left out;
    :func:`first_samples` names them.
    """
    enough, _ = first_samples(with_prompt(samples), n, strict=strict)
    return mean_pass_at_k(enough, n, ks or range(1, n + 1), group)


def as_report(rows: DataFrame) -> DataFrame:
    """pass@k rows as report rows: k is the key."""
    return rows.withColumn("key", F.col("k").cast("string")).drop("k")
