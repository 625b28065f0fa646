"""Reports and ingestion that keep up with arriving samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.operators.accuracy import metric_rows
from gaugeworks.operators.passk import as_report, mean_of_counts
from gaugeworks.schemas import GROUP, LEVELS, SAMPLE_KEY, TASK_KEY

_ARRIVED = "_arrived"
NO_LEVEL = -1  # of tasks that the task table does not hold
TASK_BUCKETS = 64  # of a group's tasks; each has one state. Part of the checkpoint: another number needs a new one


def live_counters(samples: DataFrame, group: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """Running rows, plannable and correct rows per group; the state is one row per group."""
    plannable = F.coalesce(F.col("plannable"), F.lit(False))
    correct = plannable & F.coalesce(F.col("verdict") == "Success", F.lit(False))
    return (
        samples.filter(F.col("prompt").isNotNull() & (F.col("sample_idx") == 0))
        .groupBy(*group)
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(plannable).alias("n_plannable"),
            F.count_if(correct).alias("n_correct"),
        )
    )


def start_report(
    samples: DataFrame, path: str, checkpoint: str, group: Sequence[str] = tuple(GROUP), **trigger
) -> StreamingQuery:
    """Keep the counters of every group up to date below ``path``.

    Two snapshots take turns, so the folder does not grow: a batch merges its changed groups into
    the snapshot of the batch before and overwrites the older one, as one file, which appears
    whole or not at all. A repeated batch overwrites itself. :func:`read_report` takes the latest
    row of each group.
    """

    def upsert(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        try:
            before = spark.read.parquet(f"{path}/slot={(batch_id + 1) % 2}")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            merged = changed
        else:
            new, old = changed.alias("new"), before.alias("old")
            same = reduce(and_, [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in group])
            merged = changed.unionByName(old.join(new, same, "left_anti").drop("batch"))
        merged.withColumn("batch", F.lit(batch_id)).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/slot={batch_id % 2}"
        )

    return (
        live_counters(samples, group)
        .writeStream.outputMode("update")
        .foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_report(spark: SparkSession, path: str, group: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """The report as of the last finished batch."""
    latest = F.max_by(F.struct("n_rows", "n_plannable", "n_correct"), "batch").alias("latest")
    counts = spark.read.parquet(path).groupBy(*group).agg(latest).select(*group, "latest.*")
    return metric_rows(
        counts,
        group,
        [
            ("accuracy", "", F.col("n_correct") / F.col("n_rows")),
            ("plan_accuracy", "", F.col("n_plannable") / F.col("n_rows")),
        ],
    )


def start_ingestion(
    samples: DataFrame,
    path: str,
    checkpoint: str,
    key: Sequence[str] = tuple(SAMPLE_KEY),
    done: DataFrame | None = None,
    remember: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Append every sample once, whatever its event time; a restarted query goes on where it stopped.

    Keys are remembered for ``remember`` (an interval) after they arrived, by the clock of the
    batches, so no sample is ever too late; without it the state holds every key. A sample that
    is sent again later than that is appended again, unless it is in ``done``, a static table of
    samples to leave out.
    """
    key = list(key)
    if remember:
        # the time of arrival never runs behind the watermark, as that is made of earlier arrivals
        arriving = samples.withColumn(_ARRIVED, F.current_timestamp()).withWatermark(_ARRIVED, remember)
        fresh = arriving.dropDuplicatesWithinWatermark(key).drop(_ARRIVED)
    else:
        fresh = samples.dropDuplicates(key)
    if done is not None:
        fresh = fresh.join(done.select(*key).distinct(), key, "left_anti")
    return (
        fresh.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _task_changes(n: int, group: Sequence[str]):
    """Function of a bucket's arriving samples and state: what leaves the report's counts and what enters.

    The state of a task is three bit sets over the first n samples: arrived, plannable, correct. A sample
    that arrives again replaces its bits; of several in one batch a correct one counts, then a plannable one.
    """

    def counted(seen: int, plannable: int, correct: int, level: int) -> Counter:
        found = Counter()
        if seen == (1 << n) - 1:
            found["pass@k", correct.bit_count()] += 1
            found["pass@k-plan", plannable.bit_count()] += 1
        if seen & 1:
            found["rows", level] += 1
            found["correct", level] += correct & 1
        return found

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tasks = {task: bits for task, *bits in zip(*state.get)} if state.exists else {}
        new: dict[str, dict[int, tuple[bool, bool]]] = {}
        levels: dict[str, int] = {}
        columns = ("_task", "sample_idx", "_plannable", "_correct", "_level")
        for part in parts:
            for task, i, p, c, level in zip(*(part[name].tolist() for name in columns)):
                found = new.setdefault(task, {})
                found[i] = max(found.get(i, (False, False)), (c, p))
                levels[task] = level
        change = Counter()
        for task, found in new.items():
            before = tasks.get(task, (0, 0, 0, NO_LEVEL))
            seen, plannable, correct, _ = before
            for i, (c, p) in found.items():
                bit = 1 << i
                seen |= bit
                plannable = plannable | bit if p else plannable & ~bit
                correct = correct | bit if c else correct & ~bit
            tasks[task] = (seen, plannable, correct, levels[task])
            change.subtract(counted(*before))
            change.update(counted(*tasks[task]))
        state.update(([*tasks], *map(list, zip(*tasks.values()))))
        rows = [(*key[: len(group)], kind, at, by) for (kind, at), by in change.items() if by]
        yield pd.DataFrame(rows, columns=[*group, "kind", "at", "n"])

    return run


def start_task_report(
    samples: DataFrame,
    tasks: DataFrame,
    path: str,
    checkpoint: str,
    n: int,
    group: Sequence[str] = tuple(GROUP),
    **trigger,
) -> StreamingQuery:
    """Keep pass@k over the first ``n`` samples and accuracy by level up to date below ``path``.

    The state is a few bits for each task and group; tasks share states by buckets, so a batch costs a
    call for each bucket and not for each task. When samples of a task arrive, its old
    contribution leaves the report's counts and its new one enters, so a verdict may be replaced.
    Only the changes, summed by group, reach the report: counts of tasks by number of correct
    samples, and of rows by level. Snapshots take turns as in :func:`start_report`.
    """
    if not 1 <= n <= 62:
        raise ValueError("n must be between 1 and 62")
    plannable = F.coalesce(F.col("plannable"), F.lit(False))
    scored = (
        samples.filter(F.col("prompt").isNotNull() & (F.col("sample_idx") >= 0) & (F.col("sample_idx") < n))
        .join(tasks.select(*TASK_KEY, "difficulty"), TASK_KEY, "left")
        .select(
            *group,
            # exact, with NULLs told apart, whatever the types of the key
            F.to_json(F.struct(*TASK_KEY)).alias("_task"),
            F.pmod(F.xxhash64(*TASK_KEY), F.lit(TASK_BUCKETS)).cast("int").alias("_bucket"),
            F.col("sample_idx").cast("int").alias("sample_idx"),
            plannable.alias("_plannable"),
            (plannable & F.coalesce(F.col("verdict") == "Success", F.lit(False))).alias("_correct"),
            F.coalesce("difficulty", F.lit(NO_LEVEL)).alias("_level"),
        )
    )
    names = [f"`{c}` {scored.schema[c].dataType.simpleString()}" for c in group]
    changes = scored.groupBy(*group, "_bucket").applyInPandasWithState(
        _task_changes(n, group),
        ", ".join([*names, "kind string", "at int", "n long"]),
        "tasks array<string>, seen array<long>, plannable array<long>, correct array<long>, level array<int>",
        "update",
        "NoTimeout",
    )

    def add(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        counts = changed
        try:
            counts = counts.unionByName(spark.read.parquet(f"{path}/slot={(batch_id + 1) % 2}").drop("batch"))
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        total = counts.groupBy(*group, "kind", "at").agg(F.sum("n").alias("n"))
        total.withColumn("batch", F.lit(batch_id)).coalesce(1).write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")

    return (
        changes.writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_task_report(
    spark: SparkSession,
    path: str,
    n: int,
    ks: Sequence[int] | None = None,
    group: Sequence[str] = tuple(GROUP),
    levels: Sequence[int] = tuple(LEVELS),
) -> DataFrame:
    """pass@k and accuracy by level as of the last finished batch, as report rows."""
    stored = spark.read.parquet(path)
    latest = stored.agg(F.max("batch").alias("batch"))
    counts = stored.join(latest, "batch").where("n > 0")
    by_count = counts.where("kind LIKE 'pass@k%'").select(
        *group, F.col("kind").alias("metric"), F.col("at").cast("bigint").alias("c"), F.col("n").alias("n_tasks")
    )
    rates = as_report(mean_of_counts(by_count, n, ks or range(1, n + 1), group))

    def total(kind: str, level: int):
        return F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("at") == level), F.col("n"))), F.lit(0))

    known = counts.where((F.col("kind").isin("rows", "correct")) & (F.col("at") != NO_LEVEL))
    wide = known.groupBy(*group).agg(
        *[total(kind, level).alias(f"{kind}_{level}") for level in levels for kind in ("rows", "correct")]
    )
    by_level = metric_rows(
        wide,
        group,
        [
            ("accuracy_by_level", str(v), F.coalesce(F.try_divide(F.col(f"correct_{v}"), F.col(f"rows_{v}")), F.lit(0.0)))
            for v in levels
        ],
    )
    return rates.unionByName(by_level)
