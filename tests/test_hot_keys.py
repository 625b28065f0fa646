"""One task holds a third of all rows: results stay whole and no group goes to one place unreduced."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import accuracy, ordinals, passk, samples

N = 30_000
KEY = ["model", "strategy", "task_file", "row_idx"]


@pytest.fixture(scope="module")
def hot(spark):
    return spark.range(N).select(
        F.lit("m").alias("model"),
        F.lit("s").alias("strategy"),
        F.lit("f").alias("task_file"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).cast("long").alias("row_idx"),
        F.col("id").alias("at"),
        F.lit("p").alias("prompt"),
        (F.xxhash64("id") % 3 != 0).alias("plannable"),
        F.when(F.xxhash64("id") % 2 == 0, "Success").otherwise("Failure").alias("verdict"),
    )


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbering_is_whole(hot):
    numbered = ordinals.number_rows(hot, KEY, ["at"], F.floor(F.col("at") / 1000), "sample_idx")
    sizes = numbered.groupBy(*KEY).agg(F.count("*").alias("n"), F.countDistinct("sample_idx").alias("d"), F.max("sample_idx").alias("m"))
    assert sizes.filter("n <> d OR m <> n - 1").count() == 0
    assert sizes.agg(F.sum("n")).first()[0] == N


def test_samples_are_counted_before_they_meet_the_tasks(spark, hot):
    tasks = spark.range(500).select(F.lit("f").alias("task_file"), F.col("id").alias("row_idx"), (1 + F.col("id") % 6).cast("int").alias("difficulty"))
    report = accuracy.accuracy_by_level(hot.withColumn("sample_idx", F.lit(0)), tasks)
    lines = executed(report).splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert any("partial_count" in line for line in lines[join:])
    joined = hot.join(tasks, ["task_file", "row_idx"]).withColumn("ok", (F.col("plannable") & (F.col("verdict") == "Success")).cast("double"))
    want = {str(r["difficulty"]): r["v"] for r in joined.groupBy("difficulty").agg(F.avg("ok").alias("v")).collect()}
    assert {r["key"]: pytest.approx(r["value"]) for r in report.collect()} == want


def test_first_samples_of_a_hot_task(hot):
    firsts = ordinals.first_rows(hot, KEY, ["at"], 5)
    assert executed(firsts).count("WindowGroupLimit") >= 1
    enough, short = samples.first_samples(firsts, 5)
    assert short.count() == 0 and enough.filter("row_idx = 7").first()["n_samples"] == 5
    assert passk.pass_at_k_report(firsts, 5).count() == 10
