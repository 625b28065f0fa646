import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import scores
from gaugeworks.operators import accuracy, bleu, judge, measure, passk

ESTIMATES = [
    (5, 0, 1, 0.0),
    (5, 1, 1, 0.2),
    (5, 2, 2, 0.7),
    (5, 3, 3, 1.0),
    (20, 4, 5, 0.7182662538699691),
    (20, 20, 1, 1.0),
    (20, 1, 20, 1.0),
]


def test_estimator(spark):
    rows = spark.createDataFrame(ESTIMATES, "n long, c long, k long, want double")
    got = rows.select("want", scores.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("got")).collect()
    for row in got:
        assert row["got"] == pytest.approx(row["want"])


def test_difficulty(spark):
    cases = [
        (9, 1, 1, 1), (10, 1, 1, 2), (19, 3, 3, 2), (9, 1, 2, 2), (39, 5, 5, 3),
        (59, 7, 7, 4), (79, 9, 9, 5), (80, 1, 1, 6), (5, 10, 0, 6),
    ]
    rows = spark.createDataFrame(cases, "a int, b int, c int, want int")
    level = scores.difficulty_level(F.col("a"), F.col("b"), F.col("c"))
    assert rows.filter(level != F.col("want")).count() == 0


BLEU = [
    ("a b c d", "a b c d", 1.0),
    ("a b c d e", "a b c d", 0.7788007830714049),
    ("a b c d e f", "a b x d e f", 0.37991784282579627),
    ("a b c d", "d c b a", 0.2259005009024612),
    ("a b c", "a b c d", 0.0),
    ("a b c d", "w x y z", 0.0),
    ("a a b c d", "a a a a b", 0.3976353643835253),
    ("a b c", "a b c", 0.0),
    ("", "a b c d", 0.0),
    (None, "a b c d", 0.0),
]


def test_bleu(spark):
    rows = spark.createDataFrame([(i, r, c) for i, (r, c, _) in enumerate(BLEU)], "id int, reference string, candidate string")
    got = {r["id"]: r["bleu"] for r in bleu.bleu(rows, ["id"]).collect()}
    for i, (_, _, want) in enumerate(BLEU):
        assert got[i] == pytest.approx(want), BLEU[i]


def _plain_bleu(reference, candidate):
    r, c = reference.split(), candidate.split()
    if min(len(r), len(c)) < 4:
        return 0.0
    logs, zeros = 0.0, 0
    for n in range(1, 5):
        grams = [Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (c, r)]
        hits = sum((grams[0] & grams[1]).values())
        if n == 1 and hits == 0:
            return 0.0
        total = len(c) - n + 1
        if hits == 0:
            zeros += 1
        logs += math.log(hits / total if hits else 1 / (2**zeros * total)) / 4
    return (1 if len(c) > len(r) else math.exp(1 - len(r) / len(c))) * math.exp(logs)


def test_bleu_agrees_with_plain_python(spark):
    words = "a b c d e".split()
    text = lambda seed, n: " ".join(words[(seed * (i + 3) * (i + 1) // 2) % 5] for i in range(n))
    pairs = [(i, text(i, 3 + i % 9), text(i * 3 + 1, 3 + i % 7)) for i in range(200)]
    rows = spark.createDataFrame(pairs, "id int, reference string, candidate string")
    for row in bleu.bleu(rows, ["id"]).join(rows, "id").collect():
        assert row["bleu"] == pytest.approx(_plain_bleu(row["reference"], row["candidate"]))


def test_bleu_shuffles_the_texts_once(spark):
    rows = spark.createDataFrame([(1, "a b c d", "a b c e")], "id int, reference string, candidate string")
    plan = bleu.bleu(rows, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_bleu_makes_no_row_of_an_n_gram(spark):
    rows = spark.createDataFrame([(1, "a b c d", "a b c e")], "id int, reference string, candidate string")
    plan = bleu.bleu(rows, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_bleu_of_keys_that_repeat_or_are_null(spark):
    pairs = [(1, "a b c d e", "a b c d x"), (1, "a b x d", "x b c d e"), (1, "a b", "a b"), (None, "a b c d", "a b c d"), (None, "a b c d", "a b c e"), (2, "a", None)]
    rows = spark.createDataFrame(pairs, "id int, reference string, candidate string")
    got = {r["id"]: r["bleu"] for r in bleu.bleu(rows, ["id"], partitions=1).collect()}
    assert len(got) == 3 and (got[None], got[2]) == (1.0, 0.0)
    # the n-grams of both pairs together: 9 words against 10, of which 8, 4, 3 and 2 n-grams match
    assert got[1] == pytest.approx((8 / 10 * 4 / 9 * 3 / 8 * 2 / 7) ** 0.25)


def _samples(spark, n_tasks=30, n=8):
    rows = [
        ("m", "s", "f", t, i, "p", (t + i) % 3 != 0, "Success" if (t * i) % 4 == 1 else "Failure")
        for t in range(n_tasks)
        for i in range(n)
    ]
    schema = "model string, strategy string, task_file string, row_idx long, sample_idx int, prompt string, plannable boolean, verdict string"
    return spark.createDataFrame(rows, schema)


def test_pass_at_k_invariants(spark):
    rows = passk.pass_at_k_report(_samples(spark), 8).collect()
    by = {(r["metric"], r["k"]): r["value"] for r in rows}
    for k in range(1, 9):
        assert by["pass@k", k] <= by["pass@k-plan", k]
        if k > 1:
            assert by["pass@k", k] >= by["pass@k", k - 1]
    counts = _samples(spark).filter("plannable AND verdict = 'Success'").count()
    assert by["pass@k", 1] == pytest.approx(counts / 240)


def test_short_tasks_are_left_out_or_an_error(spark):
    samples = _samples(spark).filter("NOT (row_idx = 3 AND sample_idx = 5)")
    assert passk.pass_at_k_report(samples, 8, strict=False).count() == 16
    with pytest.raises(Exception, match="too few samples"):
        passk.pass_at_k_report(samples, 8).collect()


def test_accuracy_by_level_and_means(spark):
    samples = _samples(spark).filter("sample_idx = 0").unionByName(
        _samples(spark, 1).filter("sample_idx = 0").withColumn("prompt", F.lit(None).cast("string"))
    )
    tasks = spark.createDataFrame([("f", t, 1 + t % 3) for t in range(30)], "task_file string, row_idx long, difficulty int")
    levels = {r["key"]: r["value"] for r in accuracy.accuracy_by_level(samples, tasks).collect()}
    assert set(levels) == set("123456") and levels["4"] == levels["5"] == levels["6"] == 0
    assert accuracy.counters(samples).first()["n_rows"] == 30
    scored = spark.createDataFrame([("m", "s", True, 0.5), ("m", "s", True, 1.0), ("n", "s", False, 0.25)], "model string, strategy string, correct boolean, x double")
    means = {(r["model"], r["key"]): r["value"] for r in accuracy.mean_by_correctness(scored, [("x", "x")]).collect()}
    assert means["m", "correct"] == 0.75 and means["m", "incorrect"] is None
    assert means["n", "correct"] == 0 and means["n", "incorrect"] == 0.25


def test_judge_report(spark):
    rows = [(True, "correct"), (True, "incorrect"), (False, "correct"), (False, "unrated")]
    judged = spark.createDataFrame(
        [("m", "s", "j", *r) for r in rows], "model string, strategy string, judge string, correct boolean, rating string"
    )
    got = {r["key"]: r["value"] for r in judge.judge_report(judged).collect()}
    assert got == {"accuracy": 0.5, "precision": 0.5, "recall": 0.5}
    none = judged.filter("rating = 'unrated'")
    assert {r["value"] for r in judge.judge_report(none).collect()} == {0.0}


def test_distribution_and_families(spark):
    rows = spark.createDataFrame([(v,) for v in (1, 2, 4, 10)], "x long")
    got = measure.distribution(rows, ["x"]).first()
    assert tuple(got)[1:] == (1, 1.75, 3, 5.5, 10, 4.25)
    types = spark.createDataFrame(
        [("aws_lightsail_instance",), ("aws_glacier_vault",), ("aws_default_subnet",), ("aws_subnet",), ("aws_db_x",), ("aws_dax_c",), ("random_id",)],
        "type string",
    )
    families = [r[0] for r in types.select(measure.resource_family(F.col("type"))).collect()]
    assert families == ["aws_lightsail", "aws_s3", "aws_default_subnet", "aws_vpc", "aws_rds", "aws_dynamodb", "random_id"]


def test_judges_are_scored_apart(spark):
    samples = _samples(spark).filter("row_idx < 2 AND sample_idx < 2")
    ratings = [(0, 0, "A", "Correct"), (1, 0, "A", "Correct"), (0, 0, "B", "Incorrect")]
    keys = samples.select("model", "strategy", "task_file").first()
    judgements = spark.createDataFrame(
        [(*keys, t, i, name, 0, None, f"Rating: {word}") for t, i, name, word in ratings],
        "model string, strategy string, task_file string, row_idx long, sample_idx int, judge string, judge_run int, judge_output string, judge_verdict string",
    )
    judged = judge.judged_samples(samples, judgements)
    assert judged.count() == 4
    assert judged.filter("judge = 'B' AND rating = 'unrated'").count() == 1
    accuracies = {r["judge"]: r["value"] for r in judge.judge_report(judged).filter("key = 'accuracy'").collect()}
    assert accuracies == {"A": 1.0, "B": 0.0}


def test_missing_measures_have_no_level(spark):
    rows = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (1, None, 1), (1, 1, None)], "a int, b int, c int")
    level = scores.difficulty_level(F.col("a"), F.col("b"), F.col("c"))
    assert [r[0] for r in rows.select(level).collect()] == [1, None, None, None]


@pytest.mark.parametrize("held", [1, 5, 4096])
def test_values_at_ranks_by_counts_only(spark, held):
    rng = np.random.default_rng(held)
    columns = {
        "flat": rng.integers(0, 40, 700).astype(float),
        "steep": np.exp(rng.normal(0, 60, 700)),
        "one": np.full(700, 3.0),
        "ends": np.concatenate(([-np.inf, np.inf, 0.0, -0.5], rng.normal(size=696))),
    }
    rows = [(m, float(v)) for m, values in columns.items() for v in values]
    counted = spark.createDataFrame(rows, "measure string, value double").groupBy("measure", "value").agg(F.count("*").alias("weight"))
    ranks = [0, 1, 174, 175, 349, 350, 698, 699]
    got = measure.values_at_ranks(counted, {m: ranks for m in columns}, held)
    assert got == {(m, r): np.sort(v)[r] for m, v in columns.items() for r in ranks}


def test_distribution_skips_missing_values(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None), (4.0, None), (float("nan"), None)], "x double, y double")
    got = {r["measure"]: tuple(r)[1:] for r in measure.distribution(rows, ["x", "y"]).collect()}
    assert got == {"x": (1.0, 1.75, 2.5, 3.25, 4.0, 2.5), "y": (None,) * 6}
    close = {r["measure"]: tuple(r)[1:] for r in measure.distribution(rows, ["x"], approximate=True).collect()}
    assert close["x"][0] == 1.0 and close["x"][4:] == (4.0, 2.5)
    assert measure.distribution(rows.limit(0), ["x"]).collect() == []
