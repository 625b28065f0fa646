"""Judge ratings against policy verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.operators.accuracy import metric_rows, scored_rows
from gaugeworks.schemas import GROUP, SAMPLE_KEY


def rated(judgements: DataFrame) -> DataFrame:
    """Judgements with their rating: correct, incorrect or unrated."""
    return judgements.withColumn(
        "rating", text.final_rating(F.col("judge_verdict"), F.col("judge_output"))
    )


def judged_samples(
    samples: DataFrame, judgements: DataFrame, judge_run: int = 0, judges: Sequence[str] | None = None
) -> DataFrame:
    """The scored rows once for each judge, with its rating in one run; rows it did not rate are unrated.

    ``judges`` are read from the judgements if they are not named.
    """
    run = judgements.filter(F.col("judge_run") == judge_run)
    if judges is None:
        judges = sorted(r["judge"] for r in run.select("judge").where("judge IS NOT NULL").distinct().collect())
    ratings = rated(run).select(*SAMPLE_KEY, "judge", "rating")
    return (
        scored_rows(samples)
        .withColumn("judge", F.explode(F.array(*[F.lit(j) for j in judges]).cast("array<string>")))
        .join(ratings, [*SAMPLE_KEY, "judge"], "left")
        .withColumn("rating", F.coalesce("rating", F.lit("unrated")))
    )


def judge_report(judged: DataFrame, group: Sequence[str] = (*GROUP, "judge")) -> DataFrame:
    """Per judge: accuracy (judged correct / all rows), and precision and recall against ``correct``."""
    yes, no = F.col("rating") == "correct", F.col("rating") == "incorrect"
    counts = judged.groupBy(*group).agg(
        F.count("*").alias("n_rows"),
        F.count_if(yes).alias("n_yes"),
        F.count_if(yes & F.col("correct")).alias("tp"),
        F.count_if(yes & ~F.col("correct")).alias("fp"),
        F.count_if(no & F.col("correct")).alias("fn"),
    )

    def ratio(part, whole):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return metric_rows(
        counts,
        group,
        [
            ("llm-judge", "accuracy", F.col("n_yes") / F.col("n_rows")),
            ("llm-judge", "precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))),
            ("llm-judge", "recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))),
        ],
    )
