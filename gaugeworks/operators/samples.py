"""Selecting, joining and scheduling samples and tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import prompts
from gaugeworks.schemas import SAMPLE_KEY, TASK_KEY


def with_prompt(rows: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Rows whose prompt is missing count nowhere."""
    return rows.filter(F.col(prompt).isNotNull())


def with_question(rows: DataFrame, question: str = "question") -> DataFrame:
    return rows.filter(F.col(question).isNotNull() & (F.col(question) != ""))


def of_models(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    return rows.filter(F.col("model").isin(*models))


def of_strategy(rows: DataFrame, strategy: str = "Standard") -> DataFrame:
    return rows.filter(F.col("strategy") == strategy)


def first_samples(
    samples: DataFrame, n: int, key: Sequence[str] = tuple(SAMPLE_KEY[:-1]), strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The per-task counts over the first n samples, and the tasks that have fewer.

    Both come from one aggregation by task, combined map-side, so a task with very many samples
    reaches its reducer as one row per map task. ``strict`` makes short tasks an error.
    """
    plannable = F.coalesce(F.col("plannable"), F.lit(False))
    counts = (
        samples.filter(F.col("sample_idx") < n)
        .groupBy(*key)
        .agg(
            F.count("*").alias("n_samples"),
            F.count_if(plannable).alias("n_plannable"),
            F.count_if(plannable & (F.col("verdict") == "Success")).alias("n_correct"),
        )
    )
    short = F.col("n_samples") < n
    if strict:
        message = F.concat(F.lit("task with too few samples: "), F.to_json(F.struct(*key)))
        # in a filter, so that no later column pruning removes it
        return counts.filter(F.when(short, F.raise_error(message)).otherwise(True)), counts.limit(0)
    return counts.filter(~short), counts.filter(short)


def join_tasks(samples: DataFrame, tasks: DataFrame, key: Sequence[str] = tuple(TASK_KEY)) -> DataFrame:
    """Samples with the columns of their task.

    No hint: Spark broadcasts the tasks when their size allows and otherwise shuffles both sides,
    splitting a skewed task at run time.
    """
    return samples.join(tasks, list(key), "inner")


def work_list(tasks: DataFrame, models: Sequence[str], strategies: Sequence[str], n: int) -> DataFrame:
    """Every sample to produce: task x model x strategy x sample index, generated row by row."""

    def literals(values):
        return F.array(*[F.lit(v) for v in values])

    return (
        tasks.withColumn("model", F.explode(literals(models)))
        .withColumn("strategy", F.explode(literals(strategies)))
        .withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    )


def still_to_do(wanted: DataFrame, done: DataFrame, key: Sequence[str] = tuple(SAMPLE_KEY)) -> DataFrame:
    """The wanted samples that have not been evaluated yet."""
    return wanted.join(done.select(*key).distinct(), list(key), "left_anti")


def unjudged_files(
    files: DataFrame, judgements: DataFrame, file: Sequence[str] = ("task_file",)
) -> DataFrame:
    """Files still to be judged: those whose first row has no judge output yet."""
    begun = judgements.filter((F.col("row_idx") == 0) & F.col("judge_output").isNotNull())
    return files.join(begun.select(*file).distinct(), list(file), "left_anti")


def final_turns(turns: DataFrame, key: Sequence[str] = tuple(SAMPLE_KEY)) -> DataFrame:
    """The result of the last turn of every sample.

    The latest turn is found by a map-side combined aggregate that carries only the turn number
    and a hash of the row; the wide columns come from joining it back, so no group is ever
    gathered. Of different rows that share the last turn the one of the highest hash stays, so the
    result does not depend on the order of rows.
    """
    marked = turns.withColumn("_row", F.xxhash64(F.to_json(F.struct(*turns.columns))))
    last = marked.groupBy(*key).agg(F.max(F.struct("turn", "_row")).alias("_last"))
    last = last.select(*key, "_last.turn", "_last._row")
    found = marked.join(last, [*key, "turn", "_row"], "left_semi").dropDuplicates([*key, "turn"])
    return found.drop("_row")


def second_turns(
    turns: DataFrame, max_turns: int = 2, key: Sequence[str] = tuple(SAMPLE_KEY)
) -> DataFrame:
    """Samples that need another turn, with the prompt it sends.

    Needs columns ``prompt``, ``code`` and ``policy``. A sample stops at Success, at the turn
    limit, or goes on with its own prompt when it produced no code.
    """
    follow_up = prompts.follow_up_prompt(
        F.col("prompt"),
        F.col("code"),
        F.col("policy"),
        F.col("plannable"),
        F.col("verdict"),
        F.col("plan_error"),
        F.col("policy_error"),
    )
    open_ = (F.col("turn") < max_turns) & ~F.coalesce(F.col("verdict") == "Success", F.lit(False))
    next_prompt = F.when(F.col("code") == "", F.col("prompt")).otherwise(follow_up)
    return (
        final_turns(turns, key)
        .filter(open_)
        .select(*key, (F.col("turn") + 1).alias("turn"), next_prompt.alias("next_prompt"))
    )


def quick_subset(tasks: DataFrame, rows: int = 2, order: Sequence[str] = ("task_file", "row_idx")) -> DataFrame:
    """The smallest dataset that exercises a run: the first rows in task order."""
    return tasks.orderBy(*order).limit(rows)


def default_result() -> dict[str, Column]:
    """The result of a sample for which nothing has run; its texts are fixed values."""
    return {
        "plannable": F.lit(False),
        "plan_output": F.lit("No output"),
        "plan_error": F.lit("No error"),
        "verdict": F.lit("No opa_result"),
        "policy_error": F.lit("None"),
        "notes": F.lit(""),
    }


def empty_code_result() -> dict[str, Column]:
    return default_result() | {
        "plan_error": F.lit("Empty code"),
        "notes": F.lit("Terraform plan considered failed since answer contains no code output."),
    }


def with_result_defaults(samples: DataFrame, code: str = "code") -> DataFrame:
    """Fill missing result columns; samples without code get the empty-code result."""
    empty = F.coalesce(F.col(code), F.lit("")) == ""
    no_code = empty_code_result()
    filled = {}
    for name, default in default_result().items():
        given = F.col(name) if name in samples.columns else F.lit(None)
        filled[name] = F.when(empty, no_code[name]).otherwise(F.coalesce(given, default))
    return samples.withColumns(filled)
