import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import prompts
from gaugeworks.operators import files, ordinals, reshape, samples
from gaugeworks.sources import tables


def test_numbering_splits_a_hot_group(spark):
    hot = spark.range(3000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 3001).alias("at"))
    cold = spark.range(30).select(F.concat(F.lit("g"), F.col("id") % 5).alias("g"), F.col("id").alias("at"))
    rows = hot.unionAll(cold)
    got = ordinals.number_rows(rows, ["g"], ["at"], F.floor(F.col("at") / 100)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["at"], r["row_idx"]))
    for members in groups.values():
        assert [i for _, i in sorted(members)] == list(range(len(members)))


def test_first_rows_limits_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    first = ordinals.first_rows(rows, ["g"], ["id"], 4)
    assert sorted((r["g"], r["id"], r["sample_idx"]) for r in first.collect()) == [
        (g, g + 3 * i, i) for g in range(3) for i in range(4)
    ]
    assert "WindowGroupLimit" in first._jdf.queryExecution().optimizedPlan().toString()


def _wide(spark):
    names = [f"{prefix}{i}" for i in range(2) for prefix in reshape.SAMPLE_COLUMNS.values()]
    row = ["o0", "TRUE", "Success", "", "e", None, "o1", "False", "Failure", "p", "", "n"]
    return spark.createDataFrame([("f", 0, *row), ("f", 1, *([""] * 12))], ["task_file", "row_idx", *names])


def test_wide_long_wide(spark):
    wide = _wide(spark)
    long = reshape.to_long(wide, ["task_file", "row_idx"])
    rows = {(r["row_idx"], r["sample_idx"]): r for r in long.collect()}
    assert rows[0, 0]["plannable"] is True and rows[0, 1]["plannable"] is False
    assert rows[0, 0]["plan_error"] is None and (1, 1) not in rows
    back = reshape.to_wide(long, ["task_file", "row_idx"], 2)
    assert sorted(back.columns) == sorted(wide.columns)
    assert reshape.complete_samples(long).count() == 2
    assert reshape.sample_counts(long).first()["n_samples"] == 2


def test_empty_sample_and_judge_columns(spark):
    more = reshape.add_empty_samples(_wide(spark), 2, 4)
    assert reshape.sample_numbers(more.columns) == ["0", "1", "2", "3"]
    judged = reshape.add_empty_judgements(more, "j", 2)
    long = reshape.judgements_to_long(judged, ["row_idx"], "j", 2)
    assert long.count() == 4 and long.filter("judge_verdict IS NOT NULL").count() == 0


def test_judges_are_read_off_the_header(spark):
    names = [
        "k",
        "a Judge Output #0 for LLM output #0",
        "a Judge verdict #0 for LLM output #0",
        "a.b ` Judge Output #1 for LLM output #2",
        "a Judge Output #x for LLM output #0",
    ]
    wide = spark.createDataFrame([("x", "yes", "correct", "no", "?"), (None, "", None, None, "?")], names)
    assert reshape.judge_runs(wide.columns) == [("a", 0, 0), ("a.b `", 1, 2)]
    rows = {tuple(r) for r in reshape.judgements_to_long(wide, ["k"]).collect()}
    assert rows == {
        ("x", 0, "a", 0, "yes", "correct"),
        ("x", 2, "a.b `", 1, "no", None),
        (None, 0, "a", 0, None, None),
        (None, 2, "a.b `", 1, None, None),
    }
    assert reshape.judgements_to_long(wide, ["k"], "a").count() == 2
    assert reshape.judgements_to_long(wide, ["k"], "nobody").count() == 0


def test_repeated_sample_columns_are_further_samples(spark):
    names = ["k", "LLM Output #0", "LLM Output #0", "LLM Correct? #0", "LLM Correct? #0"]
    renamed = tables.unique_names(names)
    wide = spark.createDataFrame([("x", "a", "b", "Success", "Failure")], renamed)
    rows = [(r["sample_idx"], r["output"], r["verdict"]) for r in reshape.to_long(wide, ["k"]).collect()]
    assert rows == [(0, "a", "Success"), (1, "b", "Failure")]


def test_incomplete_samples_are_dropped(spark):
    rows = [("f", 0, 0, "Success"), ("f", 1, 0, None), ("f", 0, 1, None), ("f", 1, 1, "Success")]
    long = spark.createDataFrame(rows, "task_file string, row_idx long, sample_idx int, verdict string")
    assert {(r["row_idx"], r["sample_idx"]) for r in reshape.complete_samples(long).collect()} == {(0, 0), (1, 0)}


def test_work_list_and_resume(spark):
    tasks = spark.createDataFrame([("f", 0), ("f", 1)], "task_file string, row_idx long")
    wanted = samples.work_list(tasks, ["a", "b"], ["Standard", "RAG"], 3)
    assert wanted.count() == 24
    assert "Join" not in wanted._jdf.queryExecution().optimizedPlan().toString()
    done = wanted.filter("model = 'a' AND sample_idx < 2")
    assert samples.still_to_do(wanted, done).count() == 16


def test_turns(spark):
    schema = "row_idx long, turn int, prompt string, code string, policy string, plannable boolean, verdict string, plan_error string, policy_error string"
    rows = [
        (1, 1, "p", "c", "r", False, "No opa_result", "pe", "x"),
        (2, 1, "p", "c", "r", True, "Failure", "pe", "oe"),
        (3, 1, "p", "c", "r", True, "Success", "pe", "x"),
        (4, 1, "p", "", "r", False, "No opa_result", "pe", "x"),
        (5, 1, "p", "c", "r", False, "No opa_result", "pe", "x"),
        (5, 2, "p", "c2", "r", True, "Success", "", ""),
        (6, 2, "p", "c2", "r", True, "Failure", "", "oe"),
    ]
    turns = spark.createDataFrame(rows, schema)
    last = {r["row_idx"]: r["turn"] for r in samples.final_turns(turns, ["row_idx"]).collect()}
    assert last == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2}
    todo = {r["row_idx"]: r for r in samples.second_turns(turns, 2, ["row_idx"]).collect()}
    assert set(todo) == {1, 2, 4} and todo[4]["next_prompt"] == "p"
    assert "plan error" in todo[1]["next_prompt"] and "policy error" in todo[2]["next_prompt"]


def test_defaults(spark):
    rows = spark.createDataFrame([(1, "", None), (2, "x", None), (3, "x", "Success")], "i int, code string, verdict string")
    got = {r["i"]: r for r in samples.with_result_defaults(rows).collect()}
    assert got[1]["plan_error"] == "Empty code" and got[2]["plan_error"] == "No error"
    assert got[2]["verdict"] == "No opa_result" and got[3]["verdict"] == "Success"


def test_file_names(spark):
    rules = [("alpha-7b", "COT", "complete"), ("alpha", "COT", "complete"), ("alpha", "Standard", "complete")]
    paths = ["r/alpha-7b/complete/x-COT.csv", "r/alpha/complete/x.csv", "r/beta/complete/x.csv", "r/alpha/complete/x-RAG.csv"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: (r["model"], r["strategy"], r["n_matches"]) for r in files.attribute(rows, rules).collect()}
    assert [got[p] for p in paths] == [("alpha-7b", "COT", 2), ("alpha", "Standard", 1), (None, None, 0), (None, None, 0)]
    path = F.lit("/r/RAG/m/george/evaluation-dataset-for-plain.v2-george-multi-turn.csv")
    row = spark.range(1).select(
        files.dataset_file(path, "/d", "completed-"), files.stem_of(path), files.parent_of(path), files.folder_of(path)
    ).first()
    assert tuple(row) == (
        "/d/george/completed-plain.v2-george.csv", "evaluation-dataset-for-plain.v2-george-multi-turn", "george", "/r/RAG/m/george",
    )


def test_numbering_keeps_rows_without_group_or_bucket(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 5), (None, 30), ("a", 20)], "g string, v long")
    numbered = ordinals.number_rows(rows, ["g"], ["v"], F.floor(F.col("v") / 10))
    assert {(r.g, r.v): r.row_idx for r in numbered.collect()} == {
        ("a", None): 0, ("a", 1): 1, ("a", 20): 2, (None, 5): 0, (None, 30): 1,
    }


_RESULTS = "f string, sample_idx int, output string, plannable string, verdict string, plan_error string, policy_error string, notes string"


def test_wide_tables_keep_empty_and_far_samples(spark):
    rows = [("x", 0, None, "false", "Failure", None, None, None), ("x", 9, "c", "true", "Success", None, None, "n"), ("y", 1, "d", "true", None, None, None, None)]
    samples_ = spark.createDataFrame(rows, _RESULTS)
    long = reshape.to_long(reshape.to_wide(samples_, ["f"]), ["f"]).collect()
    assert sorted((r.f, r.sample_idx, r.output) for r in long) == [("x", 0, None), ("x", 9, "c"), ("y", 1, "d")]
    with pytest.raises(Exception, match="not in 0..6"):
        reshape.to_wide(samples_, ["f"], 7).collect()
    with pytest.raises(Exception, match="repeated sample"):
        reshape.to_wide(samples_.unionByName(samples_), ["f"]).collect()


def test_last_of_equal_turns_is_one_row(spark):
    turns = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 1, "b"), (2, 0, "c")], "k int, turn int, verdict string")
    assert samples.final_turns(turns, ["k"]).count() == 2


def test_equal_last_turns_do_not_depend_on_the_order_of_rows(spark):
    rows = [(k, t, f"v{n}", None if n % 3 else n) for k in range(20) for t in (1, 2) for n in range(6)]
    results = set()
    for seed in range(3):
        mixed = random.Random(seed).sample(rows, len(rows))
        turns = spark.createDataFrame(mixed, "k int, turn int, verdict string, note int").repartition(seed + 1)
        found = samples.final_turns(turns, ["k"]).collect()
        assert len(found) == 20 and {r.turn for r in found} == {2}
        results.add(frozenset(map(tuple, found)))
    assert len(results) == 1


def test_follow_up_of_unknown_results(spark):
    row = spark.createDataFrame([("p", "c", None, None, None, None, None)], "prompt string, code string, policy string, plannable boolean, verdict string, plan_error string, policy_error string")
    made = row.select(prompts.follow_up_prompt(*[F.col(c) for c in row.columns])).first()[0]
    assert made is not None and made != "p"
