"""Operator inputs derived row by row from the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.text import CODE_DELIMITERS
from gaugeworks.operators.ordinals import number_rows
from gaugeworks.plans import documents as plan_documents
from gaugeworks.session import shuffle_partitions

STRATEGY_NAMES = ["Standard", "COT", "FSP", "multi-turn", "RAG"]
_SPARK_NAMES = "array(" + ", ".join(f"'{s}'" for s in STRATEGY_NAMES) + ")"
_SQL_NAMES = "[" + ", ".join(f"'{s}'" for s in STRATEGY_NAMES) + "]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of the documents, for work on their whole texts."""
    return table(spark, sf, "documents").select(*columns)


def dealt(orders: DataFrame) -> DataFrame:
    """Orders dealt by key, a few narrow columns, before each becomes a document many times its size."""
    return orders.repartition(shuffle_partitions(orders.sparkSession), "o_orderkey")


# -- samples: several per task, from events -------------------------------------------------

EVENT_SAMPLES_SQL = f"""
event_samples AS (
  SELECT 'm' || (user_id % 4) AS model,
         list_extract({_SQL_NAMES}, CAST(1 + (user_id // 4) % 5 AS INTEGER)) AS strategy,
         'tasks-' || (user_id % 3) || '.csv' AS task_file,
         user_id AS row_idx,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
         'prompt ' || user_id AS prompt,
         event_type <> 'error' AS plannable,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'Success' ELSE 'Failure' END AS verdict,
         event_id, ts
  FROM events)"""


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Event samples before they are numbered within their task."""
    return table(spark, sf, "events").selectExpr(
        "concat('m', user_id % 4) AS model",
        f"element_at({_SPARK_NAMES}, cast(1 + (user_id div 4) % 5 AS int)) AS strategy",
        "concat('tasks-', user_id % 3, '.csv') AS task_file",
        "user_id AS row_idx",
        "concat('prompt ', user_id) AS prompt",
        "event_type <> 'error' AS plannable",
        "CASE WHEN event_type IN ('purchase', 'signup') THEN 'Success' ELSE 'Failure' END AS verdict",
        "event_id",
        "ts",
    )


def event_samples(spark: SparkSession, sf: str) -> DataFrame:
    return number_rows(
        event_rows(spark, sf),
        ["model", "strategy", "task_file", "row_idx"],
        ["ts", "event_id"],
        F.date_trunc("hour", "ts"),
        "sample_idx",
    )


# -- samples: one per row, from lineitem, with tasks from orders ----------------------------

LINE_SAMPLES_SQL = f"""
line_samples AS (
  SELECT 'm' || (l_suppkey % 4) AS model,
         list_extract({_SQL_NAMES}, CAST(1 + l_linenumber % 5 AS INTEGER)) AS strategy,
         'tasks-' || (l_orderkey % 7) || '.csv' AS task_file,
         l_orderkey AS row_idx,
         0 AS sample_idx,
         CASE WHEN l_quantity >= 3 THEN 'prompt ' || l_orderkey END AS prompt,
         l_returnflag <> 'R' AS plannable,
         CASE WHEN l_linestatus = 'F' THEN 'Success' ELSE 'Failure' END AS verdict
  FROM lineitem)"""

ORDER_TASKS_SQL = """
order_tasks AS (
  SELECT 'tasks-' || (o_orderkey % 7) || '.csv' AS task_file,
         o_orderkey AS row_idx,
         CASE WHEN o_totalprice > 450000 THEN 6 ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END
           AS difficulty
  FROM orders)"""


def line_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "concat('m', l_suppkey % 4) AS model",
        f"element_at({_SPARK_NAMES}, cast(1 + l_linenumber % 5 AS int)) AS strategy",
        "concat('tasks-', l_orderkey % 7, '.csv') AS task_file",
        "l_orderkey AS row_idx",
        "0 AS sample_idx",
        "CASE WHEN l_quantity >= 3 THEN concat('prompt ', l_orderkey) END AS prompt",
        "l_returnflag <> 'R' AS plannable",
        "CASE WHEN l_linestatus = 'F' THEN 'Success' ELSE 'Failure' END AS verdict",
    )


def order_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "concat('tasks-', o_orderkey % 7, '.csv') AS task_file",
        "o_orderkey AS row_idx",
        "CASE WHEN o_totalprice > 450000 THEN 6 ELSE cast(substr(o_orderpriority, 1, 1) AS int) END"
        " AS difficulty",
    )


# -- samples: full result rows, one per order line -------------------------------------------

_RESULT_COLUMNS = {
    "output": "CASE WHEN max(l_partkey) % 9 = 0 THEN NULL ELSE concat('code ', max(l_partkey)) END",
    "plannable": "CASE WHEN bool_or(l_returnflag <> 'R') THEN 'true' ELSE 'false' END",
    "verdict": """CASE WHEN bool_or(l_returnflag = 'A') THEN NULL
                       WHEN bool_or(l_linestatus = 'F') THEN 'Success' ELSE 'Failure' END""",
    "plan_error": "CASE WHEN bool_or(l_returnflag = 'R') THEN 'no file exists at' ELSE 'No error' END",
    "policy_error": "CASE WHEN bool_or(l_linestatus = 'O') THEN 'Rule violation' ELSE 'No error' END",
    "notes": "concat('note ', max(l_suppkey))",
}
LINE_RESULTS_SQL = f"""
line_results AS (
  SELECT 'file-' || (l_orderkey // 100) AS task_file, l_orderkey % 100 AS row_idx, l_linenumber - 1 AS sample_idx,
         {", ".join(f"{sql} AS {name}" for name, sql in _RESULT_COLUMNS.items())}
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def line_results(spark: SparkSession, sf: str) -> DataFrame:
    """An order can repeat a line number; a sample exists once."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber")
    results = lines.agg(*[F.expr(sql).alias(name) for name, sql in _RESULT_COLUMNS.items()])
    return results.select(
        F.concat(F.lit("file-"), F.expr("l_orderkey div 100")).alias("task_file"),
        (F.col("l_orderkey") % 100).alias("row_idx"),
        (F.col("l_linenumber") - 1).alias("sample_idx"),
        *_RESULT_COLUMNS,
    )


# -- text pairs ------------------------------------------------------------------------------

DOC_PAIRS_SQL = """
first_doc AS (SELECT n_chars, min(doc_id) AS first_id FROM documents GROUP BY n_chars),
doc_pairs AS (
  SELECT d.source AS model, d.lang AS strategy, d.doc_id AS row_idx,
         r.text AS reference, d.text AS candidate, coalesce(l.quality = 1, false) AS correct
  FROM documents d
  JOIN first_doc f ON d.n_chars = f.n_chars
  JOIN documents r ON r.doc_id = f.first_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def doc_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against the first document of the same length."""
    docs = table(spark, sf, "documents")
    first = docs.groupBy("n_chars").agg(F.min("doc_id").alias("doc_id"))
    references = docs.join(first, ["n_chars", "doc_id"]).select("n_chars", F.col("text").alias("reference"))
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    # labels first, so that a row holds one text when it moves to them
    return (
        docs.join(labels, "doc_id", "left")
        .join(references, "n_chars")
        .select(
            F.col("source").alias("model"),
            F.col("lang").alias("strategy"),
            F.col("doc_id").alias("row_idx"),
            "reference",
            F.col("text").alias("candidate"),
            F.coalesce("good", F.lit(False)).alias("correct"),
        )
    )


TURN_PAIRS_SQL = """
turn_pairs AS (
  SELECT u.conv_id, u.turn, u.text AS reference, a.text AS candidate
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn against the assistant turn that follows it."""
    turns = table(spark, sf, "conversations")
    users = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    answers = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate")
    )
    return users.join(answers, ["conv_id", "turn"])


# -- raw model outputs -----------------------------------------------------------------------


def raw_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as model outputs: no fence, one of each kind, an empty block, two blocks."""
    text = F.col("text")
    kind = F.col("doc_id") % 9
    output = F.when(kind == 0, text)
    for i, fence in enumerate(CODE_DELIMITERS, start=1):
        output = output.when(kind == i, F.concat(F.lit(f"Intro {fence}\n"), text, F.lit("\n``` end")))
    output = output.when(kind == 7, F.concat(F.lit("a ```hcl\n``` "), text)).otherwise(
        F.concat(F.lit("x ```hcl\n"), text, F.lit("\n``` y ```hcl\nsecond\n```"))
    )
    return documents(spark, sf, "doc_id", "text").select("doc_id", output.alias("output"))


# what extraction must give, known from how the outputs are made
EXTRACTED_SQL = """
extracted AS (
  SELECT doc_id,
         CASE doc_id % 9 WHEN 0 THEN trim(text, chr(10) || ' ') WHEN 7 THEN 'a' WHEN 8 THEN 'x' ELSE 'Intro' END
           AS answer,
         CASE doc_id % 9 WHEN 0 THEN '' WHEN 7 THEN 'hcl' ELSE trim(text, chr(10) || ' ') END AS code
  FROM documents)"""


# -- judgements ------------------------------------------------------------------------------

JUDGED_SQL = """
judged AS (
  SELECT 'm' || (d.doc_id % 4) AS model, d.lang AS strategy, j.judge, l.quality = 1 AS correct,
         CASE WHEN d.n_chars % 10 = 1 THEN 'unrated'
              WHEN (j.judge = 'a' AND l.toxic = 0) OR (j.judge = 'b' AND d.doc_id % 3 = 0) THEN 'correct'
              ELSE 'incorrect' END AS rating
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id, unnest(['a', 'b']) AS j(judge))"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").selectExpr(
        "doc_id",
        "concat('m', doc_id % 4) AS model",
        "lang AS strategy",
        "source AS task_file",
        "doc_id AS row_idx",
        "0 AS sample_idx",
        "text",
        "n_chars",
    )
    return docs.join(table(spark, sf, "labels"), "doc_id")


def label_samples(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).selectExpr(
        "model",
        "strategy",
        "task_file",
        "row_idx",
        "sample_idx",
        "'p' AS prompt",
        "true AS plannable",
        "CASE WHEN quality = 1 THEN 'Success' ELSE 'Failure' END AS verdict",
    )


def judgements(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of two judges ending in a rating; some verdicts are missing, some rate nothing."""
    correct = "(judge = 'a' AND toxic = 0) OR (judge = 'b' AND doc_id % 3 = 0)"
    rating = f"concat('Rating: ', CASE WHEN {correct} THEN 'Correct' ELSE 'Incorrect' END)"
    judges = F.explode(F.array(F.lit("a"), F.lit("b")))
    return labelled(spark, sf).withColumn("judge", judges).selectExpr(
        "model",
        "strategy",
        "task_file",
        "row_idx",
        "sample_idx",
        "judge",
        "0 AS judge_run",
        f"""CASE n_chars % 10 WHEN 0 THEN concat(text, '\\n', {rating}, '\\nAs explained.')
                 WHEN 1 THEN concat(text, '\\nNo opinion.')
                 ELSE concat(text, '\\n', {rating}) END AS judge_output""",
        f"""CASE n_chars % 10 WHEN 0 THEN NULL WHEN 1 THEN 'No opinion.' ELSE {rating} END
              AS judge_verdict""",
    )


# -- plans -----------------------------------------------------------------------------------

# resource types of the derived plans; the last two belong to no family
PLAN_TYPES = [
    "aws_vpc",
    "aws_subnet",
    "aws_s3_bucket",
    "aws_iam_role",
    "aws_instance",
    "aws_lb",
    "aws_db_instance",
    "aws_lambda_function",
    "aws_sns_topic",
    "aws_neptune_cluster",
    "random_id",
    "null_resource",
]
_TYPE_LIST = ", ".join(f"'{t}'" for t in PLAN_TYPES)

RESOURCES_SQL = f"""
typed AS (
  SELECT o.*, i, list_extract([{_TYPE_LIST}], CAST(1 + (o_custkey + i) % 12 AS INTEGER)) AS type
  FROM orders o, unnest(range(1, 2 + o_orderkey % 5)) AS t(i)),
resources AS (
  SELECT o_orderkey AS plan_id, i - 1 AS pos, type || '.r' || i AS address,
         CASE WHEN i = 3 THEN 'data' ELSE 'managed' END AS mode, type, 'r' || i AS name,
         CASE WHEN o_orderstatus = 'F' THEN '10.' || (o_orderkey % 300) || '.0.0/16' END AS cidr_block,
         '1.' || (o_orderkey % 4) || '.0' AS engine_version,
         o_orderkey % 40 AS size,
         o_totalprice > 200000 AS enabled,
         CASE WHEN i > 1 THEN list_extract([{_TYPE_LIST}], CAST(1 + (o_custkey + i - 1) % 12 AS INTEGER))
           || '.r' || (i - 1) END AS parent,
         CASE WHEN i % 2 = 0 THEN list_extract([{_TYPE_LIST}], CAST(1 + (o_custkey + 1) % 12 AS INTEGER))
           || '.r1' END AS source
  FROM typed)"""


def _type_at(position: str) -> str:
    return f"element_at(array({_TYPE_LIST}), cast(1 + (o_custkey + {position}) % 12 AS int))"


def plan_texts(spark: SparkSession, sf: str, order_keys: DataFrame | None = None) -> DataFrame:
    """One plan per order, as JSON text: 1 to 5 resources with constants, references and blocks."""
    resource = f"""transform(sequence(1, cast(1 + o_orderkey % 5 AS int)), i -> named_struct(
        'address', concat({_type_at('i')}, '.r', i),
        'mode', if(i = 3, 'data', 'managed'),
        'type', {_type_at('i')},
        'name', concat('r', i),
        'expressions', named_struct(
          'cidr_block', if(o_orderstatus = 'F',
             named_struct('constant_value', concat('10.', o_orderkey % 300, '.0.0/16')), NULL),
          'engine_version', named_struct('constant_value', concat('1.', o_orderkey % 4, '.0')),
          'size', named_struct('constant_value', o_orderkey % 40),
          'enabled', named_struct('constant_value', o_totalprice > 200000),
          'computed', map_from_arrays(array(), array()),
          'parent_id', if(i > 1, named_struct('references', array(
             concat({_type_at('i - 1')}, '.r', i - 1, '.id'), concat({_type_at('i - 1')}, '.r', i - 1))), NULL),
          'ingress', if(i % 2 = 0, array(named_struct(
             'port', named_struct('constant_value', 443),
             'source', named_struct('references', array(
                concat({_type_at('1')}, '.r1.id'), concat({_type_at('1')}, '.r1'))))), NULL))))"""
    planned = f"""transform(sequence(1, cast(1 + o_orderkey % 5 AS int)), i -> named_struct(
        'address', concat({_type_at('i')}, '.r', i),
        'mode', if(i = 3, 'data', 'managed'),
        'type', {_type_at('i')},
        'name', concat('r', i),
        'values', named_struct('size', o_orderkey % 40, 'enabled', o_totalprice > 200000)))"""
    changes = f"""transform(sequence(1, cast(1 + o_orderkey % 5 AS int)), i -> named_struct(
        'address', concat({_type_at('i')}, '.r', i),
        'mode', if(i = 3, 'data', 'managed'),
        'type', {_type_at('i')},
        'name', concat('r', i),
        'change', named_struct('actions', array('create'),
           'after', named_struct('size', o_orderkey % 40, 'enabled', o_totalprice > 200000))))"""
    document = f"""to_json(named_struct('format_version', '1.2',
        'planned_values', named_struct('root_module', named_struct('resources', {planned})),
        'resource_changes', {changes},
        'configuration', named_struct('root_module', named_struct('resources', {resource}))))"""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )
    if order_keys is not None:
        orders = orders.join(order_keys, "o_orderkey", "left_semi")
    return dealt(orders).selectExpr("o_orderkey AS plan_id", f"{document} AS json")


def plans(spark: SparkSession, sf: str) -> DataFrame:
    return plan_documents.parse(plan_texts(spark, sf))


def document_plans(spark: SparkSession, sf: str) -> DataFrame:
    """The plans whose order key is the id of a document: the plans of the document tasks."""
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("o_orderkey"))
    return plan_documents.parse(plan_texts(spark, sf, ids)).withColumnRenamed("plan_id", "row_idx")


# -- policy outputs --------------------------------------------------------------------------

POLICY_LEAVES_SQL = """
policy_leaves AS (
  SELECT o_orderkey AS plan_id, 'pkg.allow' AS path,
         CAST(o_totalprice < 400000 AS VARCHAR) AS value, 'BOOLEAN' AS type FROM orders
  UNION ALL SELECT o_orderkey, 'pkg.rules.listed', CAST(o_orderstatus <> 'P' AS VARCHAR), 'BOOLEAN' FROM orders
  UNION ALL SELECT o_orderkey, 'pkg.rules.listed', 'true', 'BOOLEAN' FROM orders
  UNION ALL SELECT o_orderkey, 'pkg.rules.listed.count', CAST(o_orderkey % 6 AS VARCHAR), 'BIGINT' FROM orders
  UNION ALL SELECT o_orderkey, 'pkg.label', o_orderpriority, 'STRING' FROM orders)"""


def policy_outputs(spark: SparkSession, sf: str) -> DataFrame:
    document = """to_json(named_struct('pkg', named_struct(
        'allow', o_totalprice < 400000,
        'label', o_orderpriority,
        'empty', map_from_arrays(array(), array()),
        'none', array())))"""
    # a list of mixed scalars and objects has no Spark type, so that part is spliced in as text
    mixed = """concat('"rules":{"listed":[', o_orderstatus <> 'P', ',true,{"count":', o_orderkey % 6, '}]},')"""
    spliced = f"""regexp_replace({document}, '^\\\\{{"pkg":\\\\{{', concat('{{"pkg":{{', {mixed}))"""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    texts = dealt(orders).selectExpr("o_orderkey AS plan_id", f"{spliced} AS json")
    return plan_documents.parse(texts)


# -- file paths ------------------------------------------------------------------------------

PATH_RULES = [
    (model, strategy, folder)
    for model in ("alpha-34b", "alpha", "beta", "gamma")
    for strategy in ("COT", "FSP", "multi-turn", "RAG", "Standard")
    for folder in ("complete", "partial")
]

PATHS_SQL = """
paths AS (
  SELECT c_custkey AS path_id,
         'results/' || list_extract(['alpha-34b', 'beta', 'gamma', 'delta', 'beta'], CAST(1 + c_nationkey % 5 AS INTEGER))
         || CASE WHEN c_acctbal < 0 THEN '/pass' WHEN c_acctbal < 2000 THEN '/llm-judge-evaluation-metric'
                 WHEN c_acctbal < 4000 THEN '/partial' ELSE '/complete' END
         || '/evaluation-dataset-for-data-' || (c_custkey % 50)
         || CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '-COT' WHEN 'BUILDING' THEN '-RAG'
                 WHEN 'FURNITURE' THEN '-multi-turn' WHEN 'MACHINERY' THEN '-FSP-test' ELSE '' END
         || CASE WHEN c_acctbal > 8000 THEN '.txt' ELSE '.csv' END AS path
  FROM customer)"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS path_id",
        """concat('results/',
          element_at(array('alpha-34b', 'beta', 'gamma', 'delta', 'beta'), cast(1 + c_nationkey % 5 AS int)),
          CASE WHEN c_acctbal < 0 THEN '/pass' WHEN c_acctbal < 2000 THEN '/llm-judge-evaluation-metric'
               WHEN c_acctbal < 4000 THEN '/partial' ELSE '/complete' END,
          '/evaluation-dataset-for-data-', c_custkey % 50,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '-COT' WHEN 'BUILDING' THEN '-RAG'
               WHEN 'FURNITURE' THEN '-multi-turn' WHEN 'MACHINERY' THEN '-FSP-test' ELSE '' END,
          CASE WHEN c_acctbal > 8000 THEN '.txt' ELSE '.csv' END) AS path""",
    )


# -- turns of a multi-turn run ---------------------------------------------------------------

TURNS_SQL = """
turns AS (
  SELECT conv_id AS row_idx, turn, text AS prompt,
         CASE WHEN length(text) % 5 = 0 THEN '' ELSE 'code ' || turn END AS code,
         'policy ' || conv_id AS policy,
         length(text) % 3 <> 0 AS plannable,
         CASE WHEN length(text) % 4 = 0 THEN 'Success' ELSE 'Failure' END AS verdict,
         'plan error ' || turn AS plan_error, 'policy error ' || turn AS policy_error
  FROM conversations)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr(
        "conv_id AS row_idx",
        "turn",
        "text AS prompt",
        "CASE WHEN length(text) % 5 = 0 THEN '' ELSE concat('code ', turn) END AS code",
        "concat('policy ', conv_id) AS policy",
        "length(text) % 3 <> 0 AS plannable",
        "CASE WHEN length(text) % 4 = 0 THEN 'Success' ELSE 'Failure' END AS verdict",
        "concat('plan error ', turn) AS plan_error",
        "concat('policy error ', turn) AS policy_error",
    )


def with_sql(*views: str) -> str:
    return "WITH " + ",".join(views) + "\n"
