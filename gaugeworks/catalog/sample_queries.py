"""Selecting, reshaping and joining samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.catalog import views as V
from gaugeworks.catalog.registry import query
from gaugeworks.catalog.text_queries import FOLLOW_UP_SQL
from gaugeworks.functions import text
from gaugeworks.operators import ordinals, reshape, samples

N_SAMPLES = 20
_GROUP = "model, strategy, task_file, row_idx"


@query("f01_null_prompt", V.with_sql(V.LINE_SAMPLES_SQL) + f"SELECT {_GROUP}, prompt FROM line_samples WHERE prompt IS NOT NULL")
def f01(spark, sf):
    rows = V.line_samples(spark, sf).select("model", "strategy", "task_file", "row_idx", "prompt")
    return samples.with_prompt(rows)


@query(
    "f05_strategy_scope",
    V.with_sql(V.LINE_SAMPLES_SQL) + f"SELECT {_GROUP}, verdict FROM line_samples WHERE strategy = 'Standard'",
)
def f05(spark, sf):
    rows = V.line_samples(spark, sf).select("model", "strategy", "task_file", "row_idx", "verdict")
    return samples.of_strategy(rows, "Standard")


_COUNTS_SQL = f"""
counts AS (
  SELECT {_GROUP}, count(*) AS n_samples, count(*) FILTER (plannable) AS n_plannable,
         count(*) FILTER (plannable AND verdict = 'Success') AS n_correct
  FROM event_samples WHERE sample_idx < 70 GROUP BY {_GROUP})"""


@query(
    "f06_first_n_samples",
    V.with_sql(V.EVENT_SAMPLES_SQL, _COUNTS_SQL)
    + "SELECT *, n_samples = 70 AS complete FROM counts",
)
def f06(spark, sf):
    enough, short = samples.first_samples(V.event_samples(spark, sf), 70)
    return enough.withColumn("complete", F.lit(True)).unionByName(short.withColumn("complete", F.lit(False)))


@query(
    "f07_model_selection",
    V.with_sql(V.LINE_SAMPLES_SQL) + f"SELECT {_GROUP}, verdict FROM line_samples WHERE model IN ('m0', 'm2')",
)
def f07(spark, sf):
    rows = V.line_samples(spark, sf).select("model", "strategy", "task_file", "row_idx", "verdict")
    return samples.of_models(rows, ["m0", "m2"])


_WIDTH = 7  # of the SQL; the query takes it from the rows
_WIDE_COLUMNS_SQL = ",\n".join(
    f'max(CASE WHEN sample_idx = {i} THEN {name} END) AS "{prefix}{i}"'
    for i in range(_WIDTH)
    for name, prefix in reshape.SAMPLE_COLUMNS.items()
)


@query(
    "r02_long_to_wide",
    V.with_sql(V.LINE_RESULTS_SQL) + f"SELECT task_file, row_idx, {_WIDE_COLUMNS_SQL} FROM line_results GROUP BY ALL",
)
def r02(spark, sf):
    return reshape.to_wide(V.line_results(spark, sf), ["task_file", "row_idx"])


@query(
    "r01_wide_to_long",
    V.with_sql(V.LINE_RESULTS_SQL)
    + """SELECT task_file, row_idx, CAST(sample_idx AS INTEGER) AS sample_idx, output, plannable = 'true' AS plannable,
           verdict, plan_error, policy_error, notes FROM line_results""",
)
def r01(spark, sf):
    wide = reshape.to_wide(V.line_results(spark, sf), ["task_file", "row_idx"])
    return reshape.to_long(wide, ["task_file", "row_idx"])


@query(
    "r04_complete_samples",
    V.with_sql(V.LINE_RESULTS_SQL)
    + """SELECT task_file, row_idx, sample_idx, verdict FROM line_results r WHERE EXISTS (
           SELECT 1 FROM line_results f WHERE f.task_file = r.task_file AND f.sample_idx = r.sample_idx
             AND f.row_idx = 0 AND f.verdict IS NOT NULL)""",
)
def r04(spark, sf):
    rows = V.line_results(spark, sf).select("task_file", "row_idx", "sample_idx", "verdict")
    return reshape.complete_samples(rows)


@query(
    "r05_sample_count",
    V.with_sql(V.LINE_RESULTS_SQL)
    + "SELECT task_file, count(DISTINCT sample_idx) AS n_samples FROM line_results GROUP BY task_file",
)
def r05(spark, sf):
    rows = V.table(spark, sf, "lineitem").selectExpr(
        "concat('file-', l_orderkey div 100) AS task_file", "l_linenumber - 1 AS sample_idx"
    )
    return reshape.sample_counts(rows)


@query(
    "r06_result_defaults",
    V.with_sql(V.EXTRACTED_SQL)
    + """SELECT doc_id, code <> '' AND doc_id % 2 = 0 AS plannable, 'No output' AS plan_output,
           CASE WHEN code = '' THEN 'Empty code' ELSE 'No error' END AS plan_error,
           CASE WHEN code <> '' AND doc_id % 2 = 0 THEN 'Success' ELSE 'No opa_result' END AS verdict,
           'None' AS policy_error,
           CASE WHEN code = '' THEN 'Terraform plan considered failed since answer contains no code output.' ELSE '' END
             AS notes
         FROM extracted""",
)
def r06(spark, sf):
    given = V.raw_outputs(spark, sf).select(
        "doc_id",
        text.extract_code(F.col("output"))["code"].alias("code"),
        F.when(F.col("doc_id") % 2 == 0, F.lit(True)).alias("plannable"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("Success")).alias("verdict"),
    )
    return samples.with_result_defaults(given).drop("code")


@query(
    "j01_task_join",
    V.with_sql(V.LINE_SAMPLES_SQL, V.ORDER_TASKS_SQL)
    + f"""SELECT s.model, s.strategy, task_file, row_idx, s.verdict, t.difficulty
          FROM line_samples s JOIN order_tasks t USING (task_file, row_idx)""",
)
def j01(spark, sf):
    rows = V.line_samples(spark, sf).select("model", "strategy", "task_file", "row_idx", "verdict")
    return samples.join_tasks(rows, V.order_tasks(spark, sf))


_WANTED_SQL = f"""
wanted AS (
  SELECT task_file, row_idx, m.model, s.strategy, CAST(i AS INTEGER) AS sample_idx
  FROM (SELECT DISTINCT task_file, row_idx FROM event_samples),
       unnest(['m0', 'm1', 'm2', 'm3']) AS m(model), unnest({V._SQL_NAMES}) AS s(strategy),
       unnest(range(0, 5)) AS t(i))"""


@query(
    "j03_still_to_do",
    V.with_sql(V.EVENT_SAMPLES_SQL, _WANTED_SQL)
    + """SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM event_samples e
           WHERE e.model = w.model AND e.strategy = w.strategy AND e.task_file = w.task_file
             AND e.row_idx = w.row_idx AND e.sample_idx = w.sample_idx)""",
)
def j03(spark, sf):
    tasks = V.event_rows(spark, sf).select("task_file", "row_idx").distinct()
    wanted = samples.work_list(tasks, ["m0", "m1", "m2", "m3"], V.STRATEGY_NAMES, 5)
    key = ["model", "strategy", "task_file", "row_idx"]
    done = ordinals.first_rows(V.event_rows(spark, sf), key, ["ts", "event_id"], 5)
    return samples.still_to_do(wanted, done).select("task_file", "row_idx", "model", "strategy", "sample_idx")


@query(
    "j03_unjudged_files",
    V.with_sql(V.LINE_RESULTS_SQL)
    + """SELECT DISTINCT task_file FROM line_results WHERE task_file NOT IN (
           SELECT task_file FROM line_results WHERE row_idx = 0 AND sample_idx = 0 AND verdict IS NOT NULL)""",
)
def j03_unjudged(spark, sf):
    rows = V.line_results(spark, sf).select("task_file", "row_idx", "sample_idx", "verdict")
    judged = rows.filter("sample_idx = 0").withColumnRenamed("verdict", "judge_output")
    return samples.unjudged_files(rows.select("task_file").distinct(), judged)


@query(
    "j05_work_list",
    f"""SELECT model, strategy, CAST(i AS INTEGER) AS sample_idx, count(*) AS n_tasks,
          CAST(sum(c_custkey) AS BIGINT) AS key_sum
        FROM customer, unnest(['a', 'b', 'c']) AS m(model), unnest({V._SQL_NAMES}) AS s(strategy),
             unnest(range(0, 4)) AS t(i)
        GROUP BY ALL""",
)
def j05(spark, sf):
    tasks = V.table(spark, sf, "customer").select("c_custkey")
    wanted = samples.work_list(tasks, ["a", "b", "c"], V.STRATEGY_NAMES, 4)
    return wanted.groupBy("model", "strategy", "sample_idx").agg(
        F.count("*").alias("n_tasks"), F.sum("c_custkey").alias("key_sum")
    )


@query(
    "w01_row_position",
    """WITH rows AS (SELECT nullif(source, 'src1') AS task_file, doc_id, CASE WHEN doc_id % 7 > 0 THEN doc_id END AS place FROM documents)
       SELECT task_file, doc_id, row_number() OVER (PARTITION BY task_file ORDER BY place NULLS FIRST, doc_id) - 1 AS row_idx
       FROM rows""",
)
def w01(spark, sf):
    rows = V.table(spark, sf, "documents").selectExpr(
        "nullif(source, 'src1') AS task_file", "doc_id", "CASE WHEN doc_id % 7 > 0 THEN doc_id END AS place"
    )
    return ordinals.number_rows(rows, ["task_file"], ["place", "doc_id"], F.floor(F.col("place") / 10000)).drop("place")


@query(
    "w02_sample_ordinal",
    V.with_sql(V.EVENT_SAMPLES_SQL) + f"SELECT {_GROUP}, event_id, sample_idx FROM event_samples",
)
def w02(spark, sf):
    return V.event_samples(spark, sf).select("model", "strategy", "task_file", "row_idx", "event_id", "sample_idx")


@query(
    "w02_first_samples_of_task",
    V.with_sql(V.EVENT_SAMPLES_SQL)
    + f"SELECT {_GROUP}, event_id, CAST(sample_idx AS INTEGER) AS sample_idx FROM event_samples WHERE sample_idx < {N_SAMPLES}",
)
def w02_first(spark, sf):
    rows = V.event_rows(spark, sf).select("model", "strategy", "task_file", "row_idx", "event_id", "ts")
    key = ["model", "strategy", "task_file", "row_idx"]
    return ordinals.first_rows(rows, key, ["ts", "event_id"], N_SAMPLES).drop("ts")


_LAST_SQL = """
last_turns AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY turn DESC) = 1)"""


@query(
    "w03_final_turn",
    V.with_sql(V.TURNS_SQL, _LAST_SQL) + "SELECT row_idx, turn, md5(prompt) AS prompt, plannable, verdict FROM last_turns",
)
def w03(spark, sf):
    rows = V.turns(spark, sf).select("row_idx", "turn", F.md5("prompt").alias("prompt"), "plannable", "verdict")
    return samples.final_turns(rows, ["row_idx"])


@query(
    "w04_second_turn",
    V.with_sql(V.TURNS_SQL, _LAST_SQL)
    + """SELECT row_idx, turn + 1 AS turn, md5(CASE WHEN code = '' THEN prompt ELSE {follow_up} END) AS next_prompt
         FROM last_turns WHERE turn < 8 AND verdict <> 'Success'""".replace(
        "{follow_up}", FOLLOW_UP_SQL
    ),
)
def w04(spark, sf):
    todo = samples.second_turns(V.turns(spark, sf), 8, ["row_idx"])
    return todo.withColumn("next_prompt", F.md5("next_prompt"))


@query(
    "w07_quick_subset",
    V.with_sql(V.ORDER_TASKS_SQL) + "SELECT * FROM order_tasks ORDER BY task_file, row_idx LIMIT 2",
)
def w07(spark, sf):
    return samples.quick_subset(V.order_tasks(spark, sf))
