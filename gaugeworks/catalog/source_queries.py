"""Sources and sinks: each query writes derived data, reads it back and returns what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.catalog import metric_queries as M
from gaugeworks.catalog import views as V
from gaugeworks.catalog.registry import query
from gaugeworks.operators import measure, reshape, samples
from gaugeworks.plans import documents as plan_documents
from gaugeworks.session import scratch_path
from gaugeworks.sources import documents, sinks, tables

# a file holds at most this many consecutive ids of a source, so no file grows with the data
FILE_ROWS = 5000


def _task_table(spark, sf):
    """Documents under the column names of a task dataset; one prompt in each short text is missing."""
    return V.table(spark, sf, "documents").select(
        "source",
        "doc_id",
        F.floor(F.col("doc_id") / FILE_ROWS).alias("part"),
        F.when(F.col("n_chars") >= 100, F.concat(F.lit('say "'), "lang", F.lit('"'))).alias("Prompt"),
        F.col("text").alias("Reference output"),
        F.concat(F.lit("policy "), "doc_id").alias("Rego intent"),
        F.concat((1 + F.col("n_chars") % 6).cast("string"), F.lit(".0")).alias("Difficulty"),
        F.concat(F.lit("aws_vpc, "), "lang").alias("Resource"),
    )


def _written_tasks(spark, sf) -> str:
    path = scratch_path(spark, "tasks")
    rows = _task_table(spark, sf).repartition("source", "part").sortWithinPartitions("source", "part", "doc_id")
    (
        rows.drop("doc_id").write.partitionBy("source", "part")
        .option("header", True).option("quoteAll", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def _source_of(file: str = "task_file"):
    return F.regexp_extract(file, "source=([^/]+)/", 1).alias("source")


def _position_sql(order: str = "doc_id") -> str:
    return f"row_number() OVER (PARTITION BY source, doc_id // {FILE_ROWS} ORDER BY {order}) - 1"


_TASKS_SQL = f"""
task_rows AS (
  SELECT source, doc_id // {FILE_ROWS} AS part, {_position_sql()} AS row_idx, doc_id, n_chars,
         CASE WHEN n_chars >= 100 THEN 'say "' || lang || '"' END AS prompt, text, lang
  FROM documents)"""


@query(
    "s01_import_dataset",
    V.with_sql(_TASKS_SQL)
    + "SELECT source, row_idx, prompt, md5(text) AS reference, 'policy ' || doc_id AS policy FROM task_rows",
)
def s01(spark, sf):
    [table] = tables.read_tables(spark, _written_tasks(spark, sf))
    stored = scratch_path(spark, "imported")
    tables.as_tasks(table).write.parquet(stored)
    return spark.read.parquet(stored).select(
        _source_of(), "row_idx", "prompt", F.md5("reference").alias("reference"), "policy"
    )


@query(
    "s01_quick_test",
    V.with_sql(_TASKS_SQL)
    + "SELECT source, row_idx, 'policy ' || doc_id AS policy FROM task_rows ORDER BY source, part, row_idx LIMIT 2",
)
def s01_quick(spark, sf):
    [table] = tables.read_tables(spark, _written_tasks(spark, sf))
    return samples.quick_subset(tables.as_tasks(table)).select(_source_of(), "row_idx", "policy")


@query(
    "s02_header_promotion",
    V.with_sql(_TASKS_SQL)
    + """SELECT source, row_idx, prompt AS "Prompt", md5(text) AS "Reference output", 'policy ' || doc_id AS "Rego intent",
           CAST(1 + n_chars % 6 AS VARCHAR) || '.0' AS "Difficulty", 'aws_vpc, ' || lang AS "Resource"
         FROM task_rows""",
)
def s02(spark, sf):
    [table] = tables.read_tables(spark, _written_tasks(spark, sf))
    hashed = table.withColumn("Reference output", F.md5("Reference output"))
    return hashed.select(_source_of(), *hashed.columns[1:])


@query(
    "s03_typed_read",
    V.with_sql(_TASKS_SQL)
    + """SELECT source, row_idx, CAST(1 + n_chars % 6 AS INTEGER) AS difficulty, lang AS second_resource,
           CAST(2 AS INTEGER) AS n_resources FROM task_rows""",
)
def s03(spark, sf):
    [table] = tables.read_tables(spark, _written_tasks(spark, sf))
    return tables.as_tasks(table).select(
        _source_of(),
        "row_idx",
        "difficulty",
        F.get("resources", F.lit(1)).alias("second_resource"),
        F.size("resources").alias("n_resources"),
    )


@query(
    "s04_find_tables",
    f"SELECT source, count(DISTINCT doc_id // {FILE_ROWS}) AS n_files FROM documents GROUP BY source",
)
def s04(spark, sf):
    found = tables.find_tables(spark, _written_tasks(spark, sf))
    return found.groupBy(_source_of("path")).agg(F.count("*").alias("n_files"))


@query(
    "s05_plan_read",
    V.with_sql(V.RESOURCES_SQL) + "SELECT plan_id, CAST(pos AS INTEGER) AS pos, type, address FROM resources",
)
def s05(spark, sf):
    path = scratch_path(spark, "plans")
    lines = V.plan_texts(spark, sf).select(
        F.concat(F.lit('{"plan_id":"'), "plan_id", F.lit('","doc":'), "json", F.lit("}")).alias("value")
    )
    # plans repeat their keys; a file is as small as a partition, so it need not be cut
    lines.write.option("compression", "gzip").text(path)
    resources = plan_documents.plan_resources(documents.read_plan_lines(spark, path))
    return resources.select(F.col("plan_id").cast("bigint").alias("plan_id"), "pos", "type", "address")


@query(
    "s06_document_folder",
    """SELECT conv_id % 16 AS folder_id, md5(string_agg(text || chr(30), '' ORDER BY conv_id, turn)) AS text
       FROM conversations GROUP BY conv_id % 16""",
)
def s06(spark, sf):
    """Conversations in 16 files, however many there are, each read back whole."""
    path = scratch_path(spark, "folder")
    turns = V.table(spark, sf, "conversations").withColumn("folder", F.expr("conv_id % 16"))
    (
        turns.repartition("folder").sortWithinPartitions("folder", "conv_id", "turn")
        .select("folder", F.col("text").alias("value"))
        .write.partitionBy("folder").option("lineSep", "\x1e").text(path)
    )
    texts = documents.read_documents(spark, path, whole_path=True)
    folder = F.regexp_extract("doc_id", "folder=([0-9]+)", 1).cast("bigint")
    return texts.select(folder.alias("folder_id"), F.md5("text").alias("text"))


@query(
    "s07_sample_sink",
    V.with_sql(V.LINE_SAMPLES_SQL) + "SELECT model, strategy, task_file, row_idx, plannable, verdict FROM line_samples",
)
def s07(spark, sf):
    path = scratch_path(spark, "samples")
    rows = V.line_samples(spark, sf).select("model", "strategy", "task_file", "row_idx", "plannable", "verdict")
    sinks.write_samples(rows, path)
    return spark.read.parquet(path)


@query("s08_report_sink", M.REPORT_PATHS_SQL)
def s08(spark, sf):
    path = scratch_path(spark, "report")
    sinks.write_report(M.report_rows(spark, sf), path)
    return M.json_leaves(spark.read.text(path).withColumnRenamed("value", "json"))


@query(
    "s08_histogram_sink",
    V.with_sql(V.RESOURCES_SQL) + "SELECT type AS path, CAST(count(*) AS DOUBLE) AS value FROM resources GROUP BY type",
)
def s08_histogram(spark, sf):
    path = scratch_path(spark, "histogram")
    sinks.write_histogram(M._types(spark, sf), "type", "n_resources", path)
    return M.json_leaves(spark.read.text(path).withColumnRenamed("value", "json"))


@query(
    "r03_duplicate_columns",
    """SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS "x", CAST(l_suppkey AS VARCHAR) AS "x.1",
         CAST(l_linenumber AS VARCHAR) AS "x.1.1" FROM lineitem""",
)
def r03(spark, sf):
    path = scratch_path(spark, "duplicates")
    # CSV writers refuse repeated names, so header and records are written as lines
    lines = V.table(spark, sf, "lineitem").selectExpr(
        "concat_ws(',', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber) AS value"
    )
    header = F.lit("l_orderkey,l_linenumber,x,x,x.1")
    numbered = lines.select("value", F.spark_partition_id().alias("file"))
    with_header = numbered.select("file", F.lit(1).alias("at"), "value").unionAll(
        numbered.select("file").distinct().select("file", F.lit(0).alias("at"), header.alias("value"))
    )
    (
        with_header.repartition("file").sortWithinPartitions("file", "at").select("file", "value")
        .write.partitionBy("file").text(path)
    )
    [table] = tables.read_tables(spark, path, glob="*.txt")
    keys = [F.col(c).cast(t).alias(c) for c, t in (("l_orderkey", "bigint"), ("l_linenumber", "int"))]
    return table.select(*keys, "`x`", "`x.1`", "`x.1.1`")


@query(
    "s02_wide_samples_read",
    V.with_sql(V.LINE_RESULTS_SQL)
    + """SELECT task_file, row_idx, CAST(sample_idx AS INTEGER) AS sample_idx, output, plannable = 'true' AS plannable,
           verdict, plan_error, policy_error, notes FROM line_results""",
)
def s02_wide(spark, sf):
    path = scratch_path(spark, "wide")
    # the last sample needs no results, so the lines are not grouped for it
    n = reshape.sample_width(V.table(spark, sf, "lineitem").selectExpr("l_linenumber - 1 AS sample_idx"))
    wide = reshape.to_wide(V.line_results(spark, sf), ["task_file", "row_idx"], n)
    sinks.write_csv(wide.withColumnsRenamed({"task_file": "file", "row_idx": "row"}), path)
    [table] = tables.read_tables(spark, path)
    long = reshape.to_long(table, ["file", "row"])
    return long.withColumnsRenamed({"file": "task_file", "row": "row_idx"}).withColumn(
        "row_idx", F.col("row_idx").cast("bigint")
    )


@query(
    "s07_measured_sink",
    V.with_sql(*M._MEASURED)
    + "SELECT row_idx, loc, n_resources, interconnections, difficulty, resources FROM measured",
)
def s07_measured(spark, sf):
    path = scratch_path(spark, "measured")
    sinks.write_csv(M._measured(spark, sf).drop("resource_types", "policy_loc"), path)
    schema = "row_idx bigint, loc bigint, n_resources bigint, interconnections bigint, difficulty int, resources string"
    return spark.read.schema(schema).option("header", True).csv(path)


@query(
    "a16_histogram_of_read_table",
    V.with_sql(_TASKS_SQL)
    + """SELECT 'level-' || l AS level, count(n_chars) AS n_tasks FROM unnest([1, 2, 3, 4, 5, 6]) AS t(l)
         LEFT JOIN task_rows ON 1 + n_chars % 6 = l AND prompt IS NOT NULL GROUP BY l""",
)
def a16_read(spark, sf):
    [table] = tables.read_tables(spark, _written_tasks(spark, sf))
    return measure.level_histogram(samples.with_prompt(tables.as_tasks(table)))


# model, strategy and folder names that paths of evaluated files hold
_ATTRIBUTION = [(m, s, f) for m in ("alpha", "beta") for s in ("Standard", "COT", "RAG") for f in ("short", "wide")]


@query(
    "s01_attributed_read",
    """SELECT 'policy ' || doc_id AS policy, CASE doc_id % 2 WHEN 0 THEN 'alpha' ELSE 'beta' END AS model,
         CASE doc_id % 3 WHEN 0 THEN 'Standard' WHEN 1 THEN 'COT' ELSE 'RAG' END AS strategy,
         md5(text) AS reference
       FROM documents WHERE n_chars < 2000 OR n_chars % 3 > 0""",
)
def s01_attributed(spark, sf):
    """Model and strategy of evaluated tables, read off their paths; files that no rule fits are left out."""
    path = scratch_path(spark, "evaluated")
    folder = F.expr("CASE WHEN n_chars < 2000 THEN 'short' WHEN n_chars % 3 > 0 THEN 'wide' ELSE 'other' END")
    rows = V.table(spark, sf, "documents").select(
        F.expr("CASE doc_id % 2 WHEN 0 THEN 'alpha' ELSE 'beta' END").alias("model"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'Standard' WHEN 1 THEN 'COT' ELSE 'RAG' END").alias("strategy"),
        folder.alias("folder"),
        F.col("text").alias("Reference output"),
        F.concat(F.lit("policy "), "doc_id").alias("Rego intent"),
    )
    # each writing task adds a file to a folder, so files stay as small as partitions
    (
        rows.write.partitionBy("model", "strategy", "folder")
        .option("header", True).option("quoteAll", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    [table] = tables.read_tables(spark, path)
    found = tables.with_attribution(table, _ATTRIBUTION).where(F.col("model").isNotNull())
    return found.select(
        F.col("Rego intent").alias("policy"), "model", "strategy", F.md5("Reference output").alias("reference")
    )


@query(
    "s05_plan_files",
    """SELECT l_suppkey AS plan_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_returnflag) - 1 AS INTEGER) AS pos,
         'aws_' || lower(l_returnflag) AS type, 'aws_' || lower(l_returnflag) || '.r' || l_orderkey || '_' || l_linenumber AS address
       FROM lineitem""",
)
def s05_files(spark, sf):
    """One file a plan, the plan of a supplier's deliveries; a folder of them is read as documents."""
    path = scratch_path(spark, "plan-files")
    resource = F.expr(
        """struct(l_orderkey, l_linenumber, concat('aws_', lower(l_returnflag)) AS type,
             concat('aws_', lower(l_returnflag), '.r', l_orderkey, '_', l_linenumber) AS address)"""
    )
    plans = V.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(resource)).alias("r"))
    text = F.to_json(F.struct(F.struct(F.struct(F.col("r").alias("resources")).alias("root_module")).alias("configuration")))
    sinks.write_files(plans.select(F.col("l_suppkey").alias("plan"), text.alias("value")), path, "plan", "value")
    resources = plan_documents.plan_resources(documents.read_plans(spark, path, glob="*.txt"))
    plan = F.regexp_extract("plan_id", "plan=([0-9]+)", 1).cast("bigint")
    return resources.select(plan.alias("plan_id"), "pos", "type", "address")


@query(
    "r01_wide_judgements",
    """SELECT CAST(doc_id AS VARCHAR) AS file, CAST(doc_id % 2 AS INTEGER) AS sample_idx, judge, CAST(run AS INTEGER) AS judge_run,
         lang || ' "' || n_chars || '"' AS judge_output,
         CASE (doc_id + run) % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' END AS judge_verdict
       FROM documents, unnest(['a', 'b c']) AS j(judge), unnest([0, 1]) AS r(run)""",
)
def r01_judgements(spark, sf):
    """Judge columns of a wide table, written and read; judges, runs and samples come from its header."""
    path = scratch_path(spark, "judged")
    rows = V.table(spark, sf, "documents")
    names = [(judge, run, sample) for judge in ("a", "b c") for run in (0, 1) for sample in (0, 1)]
    cells = []
    for judge, run, sample in names:
        of = {"judge": judge, "run": run, "sample": sample}
        here = F.col("doc_id") % 2 == sample
        verdict = F.expr(f"CASE (doc_id + {run}) % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' END")
        output = F.concat("lang", F.lit(' "'), "n_chars", F.lit('"'))
        cells.append(F.when(here, output).otherwise("").alias(reshape.JUDGE_OUTPUT.format(**of)))
        cells.append(F.when(here, F.coalesce(verdict, F.lit(""))).otherwise("").alias(reshape.JUDGE_VERDICT.format(**of)))
    sinks.write_csv(rows.select(F.col("doc_id").cast("string").alias("file"), *cells), path)
    [table] = tables.read_tables(spark, path)
    return reshape.judgements_to_long(table, ["file"]).where(F.col("judge_output").isNotNull())
