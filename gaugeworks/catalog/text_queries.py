"""Text, prompt and file-name operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.catalog import views as V
from gaugeworks.catalog.registry import literal, query
from gaugeworks.functions import prompts, scores, text
from gaugeworks.operators import files, report, samples

_SPACE = "chr(10) || ' '"


@query(
    "t01_extract_code",
    V.with_sql(V.EXTRACTED_SQL) + "SELECT doc_id, md5(answer) AS answer, md5(code) AS code FROM extracted",
)
def t01(spark, sf):
    rows = V.raw_outputs(spark, sf).select("doc_id", text.extract_code(F.col("output")).alias("x"))
    return rows.select("doc_id", F.md5("x.answer").alias("answer"), F.md5("x.code").alias("code"))


@query(
    "u03_custom_delimiters",
    f"""SELECT doc_id, CASE WHEN doc_id % 9 IN (1, 8) THEN md5(trim(text, {_SPACE})) ELSE md5('') END AS code
        FROM documents""",
)
def u03(spark, sf):
    code = text.extract_code(F.col("output"), ["```hcl"])["code"]
    return V.raw_outputs(spark, sf).select("doc_id", F.md5(code).alias("code"))


_ESCAPES = "chr(27) || '[31m' || text || chr(27) || '[0m' || chr(27) || 'M'"


@query(
    "t02_remove_unwanted",
    f"""SELECT doc_id, md5(regexp_replace(regexp_replace({_ESCAPES},
          '\\x1B[@-_][0-?]*[ -/]*[@-~]', '', 'g'), '[^\\x00-\\x7F]+', '', 'g')) AS cleaned
        FROM documents""",
)
def t02(spark, sf):
    raw = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m\x1bM"))
    cleaned = text.remove_unwanted_characters(raw)
    return V.documents(spark, sf, "doc_id", "text").select("doc_id", F.md5(cleaned).alias("cleaned"))


@query(
    "t03_nonblank_lines",
    """SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S'))) AS BIGINT)
         AS loc FROM documents""",
)
def t03(spark, sf):
    return V.documents(spark, sf, "doc_id", "text").select("doc_id", text.nonblank_lines(F.col("text")).alias("loc"))


@query(
    "t04_occurrences",
    "SELECT doc_id, CAST(len(string_split(text, 'the')) - 1 AS BIGINT) AS n FROM documents",
)
def t04(spark, sf):
    return V.documents(spark, sf, "doc_id", "text").select("doc_id", text.occurrences(F.col("text"), "the").alias("n"))


_ERROR_TEXTS_SQL = """
errors AS (
  SELECT event_id,
         CASE event_type WHEN 'error' THEN 'Inconsistent dependency lock file'
              WHEN 'view' THEN 'x' || chr(10) || 'archive missing file: "out/fn-' || user_id || '.zip"'
              WHEN 'click' THEN 'no file exists at "page-' || user_id || '.html" or "b.txt"'
              WHEN 'signup' THEN 'plan "main.tf" failed' END AS message
  FROM events)"""


def _error_texts(spark, sf):
    return V.table(spark, sf, "events").selectExpr(
        "event_id",
        r"""CASE event_type WHEN 'error' THEN 'Inconsistent dependency lock file'
              WHEN 'view' THEN concat('x\narchive missing file: "out/fn-', user_id, '.zip"')
              WHEN 'click' THEN concat('no file exists at "page-', user_id, '.html" or "b.txt"')
              WHEN 'signup' THEN 'plan "main.tf" failed' END AS message""",
    )


@query(
    "t05_quoted_filename",
    V.with_sql(_ERROR_TEXTS_SQL)
    + """SELECT event_id, nullif(regexp_extract(line, '"([^"]+\\.(html|js|txt|csv|zip|py|pub|yml|yaml))"', 1), '') AS name
         FROM (SELECT event_id, unnest(string_split(message, chr(10))) AS line FROM errors)
         WHERE regexp_matches(line, '"([^"]+\\.(html|js|txt|csv|zip|py|pub|yml|yaml))"')""",
)
def t05(spark, sf):
    return _error_texts(spark, sf).select(
        "event_id", F.explode(text.quoted_filenames(F.col("message"))).alias("name")
    )


@query(
    "t06_plan_error_class",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'lock_file' WHEN 'view' THEN 'missing_archive'
         WHEN 'click' THEN 'missing_file' WHEN 'signup' THEN 'other' END AS class FROM events""",
)
def t06(spark, sf):
    return _error_texts(spark, sf).select("event_id", text.classify_plan_error(F.col("message")).alias("class"))


@query(
    "t07_last_line",
    """SELECT d.doc_id, CASE d.n_chars % 10 WHEN 0 THEN 'As explained.' WHEN 1 THEN 'No opinion.'
         ELSE 'Rating: ' || CASE WHEN l.toxic = 0 THEN 'Correct' ELSE 'Incorrect' END END AS rating_line
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def t07(spark, sf):
    return V.judgements(spark, sf).filter("judge = 'a'").select(
        F.col("row_idx").alias("doc_id"), text.last_line(F.col("judge_output")).alias("rating_line")
    )


@query(
    "t08_verdict_class",
    """SELECT d.doc_id, CASE WHEN d.n_chars % 10 < 2 THEN 'edge'
         WHEN l.toxic = 0 THEN 'correct' ELSE 'incorrect' END AS class
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def t08(spark, sf):
    return V.judgements(spark, sf).filter("judge = 'a'").select(
        F.col("row_idx").alias("doc_id"), text.classify_verdict(F.col("judge_verdict")).alias("class")
    )


@query(
    "t09_rating_rescue",
    """SELECT d.doc_id, CASE WHEN d.n_chars % 10 = 1 THEN 'unrated'
         WHEN l.toxic = 0 THEN 'correct' ELSE 'incorrect' END AS rating
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def t09(spark, sf):
    return V.judgements(spark, sf).filter("judge = 'a'").select(
        F.col("row_idx").alias("doc_id"), text.rescue_rating(F.col("judge_output")).alias("rating")
    )


@query(
    "t10_exact_match",
    V.with_sql(V.DOC_PAIRS_SQL)
    + f"""SELECT row_idx, trim(reference, {_SPACE}) = trim(candidate, {_SPACE}) AS same FROM doc_pairs""",
)
def t10(spark, sf):
    pairs = V.doc_pairs(spark, sf)
    return pairs.select("row_idx", text.exact_match(F.col("reference"), F.col("candidate")).alias("same"))


@query(
    "t11_tokens",
    """SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, '|')) AS tokens FROM (
         SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM documents)""",
)
def t11(spark, sf):
    rows = V.documents(spark, sf, "doc_id", "text").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", "|")).alias("tokens"))


_FLAG = """CASE event_type WHEN 'view' THEN 'True' WHEN 'click' THEN 'TRUE' WHEN 'signup' THEN 'true'
           WHEN 'error' THEN 'FALSE' END"""


@query("t12_lenient_boolean", "SELECT event_id, event_type IN ('view', 'click', 'signup') AS flag FROM events")
def t12(spark, sf):
    return V.table(spark, sf, "events").select("event_id", text.lenient_true(F.expr(_FLAG)).alias("flag"))


def _filled_sql(template: str, *slots: str) -> str:
    parts = [literal(t) for t in template.split("{}")]
    return " || ".join(p for pair in zip(parts, [*slots, "''"]) for p in pair)


_SQL_STRATEGY = f"list_extract({V._SQL_NAMES}, CAST(1 + conv_id % 5 AS INTEGER))"
_SPARK_STRATEGY = f"element_at({V._SPARK_NAMES}, cast(1 + conv_id % 5 AS int))"


@query(
    "t13_prompt_enhancement",
    f"""SELECT conv_id, turn, strategy, md5(CASE strategy
          WHEN 'RAG' THEN {_filled_sql(prompts.CONTEXT_PROMPT, 'role', 'text')}
          WHEN 'COT' THEN 'steps: ' || text WHEN 'FSP' THEN 'shots: ' || text
          ELSE 'Here is the actual prompt: ' || text END) AS prompt
        FROM (SELECT *, {_SQL_STRATEGY} AS strategy FROM conversations)""",
)
def t13(spark, sf):
    rows = V.table(spark, sf, "conversations").withColumn("strategy", F.expr(_SPARK_STRATEGY))
    prompt = prompts.enhance_prompt(F.col("text"), F.col("strategy"), F.col("role"), "steps: ", "shots: ")
    return rows.select("conv_id", "turn", "strategy", F.md5(prompt).alias("prompt"))


FOLLOW_UP_SQL = f"""CASE WHEN NOT plannable
       THEN {_filled_sql(prompts.PLAN_ERROR_PROMPT, 'prompt', 'code', 'plan_error')}
     WHEN verdict = 'Failure'
       THEN {_filled_sql(prompts.POLICY_ERROR_PROMPT, 'prompt', 'code', 'policy', 'policy_error')}
     ELSE prompt END"""


@query(
    "t14_follow_up_prompt",
    V.with_sql(V.TURNS_SQL) + f"SELECT row_idx, turn, md5({FOLLOW_UP_SQL}) AS prompt FROM turns",
)
def t14(spark, sf):
    names = ["prompt", "code", "policy", "plannable", "verdict", "plan_error", "policy_error"]
    prompt = prompts.follow_up_prompt(*[F.col(c) for c in names])
    return V.turns(spark, sf).select("row_idx", "turn", F.md5(prompt).alias("prompt"))


@query(
    "t15_judge_prompt",
    V.with_sql(V.TURN_PAIRS_SQL)
    + f"""SELECT conv_id, turn,
            md5({_filled_sql(prompts.JUDGE_SINGLE_PROMPT, 'reference', 'candidate')}) AS single,
            md5({_filled_sql(prompts.JUDGE_REFERENCE_PROMPT, "'q' || turn", 'reference', 'candidate')}) AS with_reference
          FROM turn_pairs""",
)
def t15(spark, sf):
    reference, candidate = F.col("reference"), F.col("candidate")
    question = F.concat(F.lit("q"), F.col("turn"))
    return V.turn_pairs(spark, sf).select(
        "conv_id",
        "turn",
        F.md5(prompts.judge_prompt("llm-single", reference, candidate)).alias("single"),
        F.md5(prompts.judge_prompt("llm-reference", question, candidate, reference)).alias("with_reference"),
    )


@query(
    "t16_question_lines",
    """SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS q_pos, lines[i] AS question FROM (
         SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations),
         unnest(range(1, len(lines) + 1)) AS t(i)""",
)
def t16(spark, sf):
    lines = text.question_lines(F.col("text"))
    return V.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(lines).alias("q_pos", "question"))


@query(
    "t17_join_contexts",
    """SELECT conv_id, turn, md5(array_to_string(list_transform(lines[1:4],
         lambda x, i: 'Context ' || (i - 1) || ': ' || chr(10) || x), '')) AS context FROM (
         SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations)""",
)
def t17(spark, sf):
    context = prompts.join_contexts(F.split("text", "\n"))
    return V.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(context).alias("context"))


@query("f08_empty_question", "SELECT conv_id, turn, line AS question FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE line <> ''")
def f08(spark, sf):
    rows = V.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("question"))
    return samples.with_question(rows)


# -- file paths ------------------------------------------------------------------------------


@query(
    "f02_path_exclusion",
    V.with_sql(V.PATHS_SQL)
    + "SELECT path_id, path FROM paths WHERE NOT contains(path, 'llm-judge-evaluation-metric') AND NOT contains(path, 'pass')",
)
def f02(spark, sf):
    return files.without(V.paths(spark, sf), ["llm-judge-evaluation-metric", "pass"])


@query(
    "f03_folder_filter",
    V.with_sql(V.PATHS_SQL) + "SELECT path_id, path FROM paths WHERE contains(path, '/llm-judge-evaluation-metric/')",
)
def f03(spark, sf):
    return files.in_folder(V.paths(spark, sf), "llm-judge-evaluation-metric")


@query(
    "f04_file_name_filter",
    V.with_sql(V.PATHS_SQL)
    + "SELECT path_id, path FROM paths WHERE path LIKE '%.csv' AND path NOT LIKE '%test%' AND path NOT LIKE '%-RAG%'",
)
def f04(spark, sf):
    return files.without(files.csv_files(V.paths(spark, sf)), ["test", "-RAG"])


_RULES_SQL = "(VALUES " + ", ".join(
    f"({i}, {literal(m)}, {literal(s)}, {literal(f)})" for i, (m, s, f) in enumerate(V.PATH_RULES)
) + ") AS rules(ord, model, strategy, folder)"
_NAMED_SQL = " OR ".join(f"contains(path, '{s}')" for s in files.NAMED_STRATEGIES)


@query(
    "r07_attribution",
    V.with_sql(V.PATHS_SQL)
    + f"""SELECT path_id, path, min_by(model, ord) AS model, min_by(strategy, ord) AS strategy,
            min_by(folder, ord) AS folder, CAST(count(ord) AS INTEGER) AS n_matches,
            CASE WHEN count(ord) = 0 THEN 'excluded' WHEN count(ord) > 1 THEN 'ambiguous' ELSE 'assigned' END AS status
          FROM paths LEFT JOIN {_RULES_SQL}
            ON contains(path, model) AND contains(path, folder)
           AND CASE WHEN {_NAMED_SQL} THEN contains(path, strategy) ELSE strategy = 'Standard' END
          GROUP BY path_id, path""",
)
def r07(spark, sf):
    found = files.attribute(V.paths(spark, sf), V.PATH_RULES)
    return found.withColumn("status", files.attribution_status(F.col("n_matches")))


@query(
    "r08_dataset_file",
    V.with_sql(V.PATHS_SQL)
    + r"""SELECT path_id, 'data/' || regexp_extract(path, '/([^/]*)/[^/]*$', 1) || '/completed-'
            || regexp_extract(path, 'evaluation-dataset-for-(data-[0-9]+)', 1) || '.csv' AS dataset FROM paths""",
)
def r08(spark, sf):
    path = files.dataset_file(F.col("path"), "data", "completed-")
    return V.paths(spark, sf).select("path_id", path.alias("dataset"))


@query(
    "r09_destination_names",
    V.with_sql(V.PATHS_SQL)
    + r"""SELECT path_id,
            'out/m/' || folder || '/evaluation-dataset-for-' || stem || CASE WHEN path_id % 2 = 0 THEN '-RAG' ELSE '' END
              || '.csv' AS evaluated,
            regexp_extract(path, '^(.*)/', 1) || '/llm-judge-evaluation-metric/gpt4-single-' || stem || '.csv' AS judged,
            'measured/' || folder || '/completed-' || stem || '.csv' AS measured
          FROM (SELECT *, regexp_extract(path, '/([^/]*)/[^/]*$', 1) AS folder,
                       regexp_extract(path, '([^/]+)\.[a-z]+$', 1) AS stem FROM paths)""",
)
def r09(spark, sf):
    path = F.col("path")
    strategy = F.when(F.col("path_id") % 2 == 0, "RAG").otherwise("Standard")
    return V.paths(spark, sf).select(
        "path_id",
        files.evaluated_file(path, F.lit("m"), strategy, "out").alias("evaluated"),
        files.judged_file(path, "gpt4").alias("judged"),
        files.measured_file(path, "measured").alias("measured"),
    )


# -- difficulty and registry -----------------------------------------------------------------


@query(
    "a14_difficulty_level",
    """SELECT l_orderkey, l_linenumber, CAST(CASE
         WHEN l_quantity < 10 AND l_linenumber < 2 AND l_suppkey % 12 < 2 THEN 1
         WHEN l_quantity < 20 AND l_linenumber < 4 AND l_suppkey % 12 < 4 THEN 2
         WHEN l_quantity < 40 AND l_linenumber < 6 AND l_suppkey % 12 < 6 THEN 3
         WHEN l_quantity < 60 AND l_linenumber < 8 AND l_suppkey % 12 < 8 THEN 4
         WHEN l_quantity < 80 AND l_linenumber < 10 AND l_suppkey % 12 < 10 THEN 5
         ELSE 6 END AS INTEGER) AS level FROM lineitem""",
)
def a14(spark, sf):
    level = scores.difficulty_level(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_suppkey") % 12)
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", level.alias("level"))


@query(
    "u02_metric_by_name",
    V.with_sql(V.DOC_PAIRS_SQL)
    + f"""SELECT model, strategy, 'exact_match' AS metric, '' AS key,
            round(avg(CASE WHEN trim(reference, {_SPACE}) = trim(candidate, {_SPACE}) THEN 1.0 ELSE 0.0 END), 6) AS value
          FROM doc_pairs GROUP BY model, strategy""",
)
def u02(spark, sf):
    result = report.default_metrics().run("exact_match", V.doc_pairs(spark, sf).drop("correct"))
    return result.withColumn("value", F.round("value", 6))
