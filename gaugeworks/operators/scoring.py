"""From raw sample outputs to scores: code out of the output, the task's reference, BLEU and exact match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.operators import bleu
from gaugeworks.operators.samples import join_tasks
from gaugeworks.schemas import SAMPLE_KEY, TASK_KEY


def score_samples(
    samples: DataFrame, tasks: DataFrame, key: Sequence[str] = tuple(SAMPLE_KEY), task: Sequence[str] = tuple(TASK_KEY)
) -> DataFrame:
    """``key``, ``exact`` and ``bleu`` of every sample's code against its task's ``reference``.

    ``samples`` holds the raw ``output``. A sample without code is scored with none; a task
    without a reference matches nothing exactly.
    """
    pairs = join_tasks(samples.select(*key, "output"), tasks.select(*task, "reference"), task).select(
        *key, F.coalesce("reference", F.lit("")).alias("reference"), text.extract_code(F.col("output"))["code"].alias("candidate")
    )
    exact = F.coalesce(text.exact_match(F.col("reference"), F.col("candidate")), F.lit(False))
    # exact is one more key: a bit that each n-gram carries, instead of the pairs made twice
    return bleu.bleu(pairs.withColumn("exact", exact), [*key, "exact"])
