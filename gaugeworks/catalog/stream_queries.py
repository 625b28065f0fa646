"""Streaming forms, run over what has arrived so far and read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.catalog import metric_queries as M
from gaugeworks.catalog import views as V
from gaugeworks.catalog.registry import query, rounded
from gaugeworks.operators import ordinals
from gaugeworks.schemas import GROUP, TASK_KEY
from gaugeworks.session import checkpointed, scratch_path
from gaugeworks.streaming import live

_LIVE = {
    "model": "concat('m', user_id % 4)",
    "strategy": f"element_at({V._SPARK_NAMES}, cast(1 + (user_id div 4) % 5 AS int))",
    "row_idx": "event_id",
    "sample_idx": "0",
    "prompt": "CASE WHEN value >= 2.0 THEN 'p' END",
    "plannable": "event_type <> 'error'",
    "verdict": "CASE WHEN event_type IN ('purchase', 'signup') THEN 'Success' ELSE 'Failure' END",
}


def _arriving(spark, sf, table: str):
    """A table of the given folder as a stream of files."""
    schema = V.table(spark, sf, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


_LIVE_SQL = f"""WITH live AS (
  SELECT 'm' || (user_id % 4) AS model, list_extract({V._SQL_NAMES}, CAST(1 + (user_id // 4) % 5 AS INTEGER)) AS strategy,
         event_type <> 'error' AS plannable, event_type IN ('purchase', 'signup') AS correct
  FROM events WHERE value >= 2.0)
SELECT model, strategy, 'accuracy' AS metric, '' AS key, round(avg(CAST(correct AS DOUBLE)), 6) AS value FROM live GROUP BY ALL
UNION ALL SELECT model, strategy, 'plan_accuracy', '', round(avg(CAST(plannable AS DOUBLE)), 6) FROM live GROUP BY ALL"""


@query("st1_live_report", _LIVE_SQL)
def st1(spark, sf):
    path, checkpoint = scratch_path(spark, "live"), scratch_path(spark, "live-state")
    arriving = _arriving(spark, sf, "events").selectExpr(*[f"{sql} AS {name}" for name, sql in _LIVE.items()])
    live.start_report(arriving, path, checkpoint).awaitTermination()
    return rounded(live.read_report(spark, path), "value")


FILES = 4  # so many batches arrive, in no order of keys


@query(
    "st2_resumable_ingestion",
    """SELECT DISTINCT l_orderkey AS row_idx, CAST(l_linenumber AS INTEGER) AS sample_idx FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND l_linenumber = 1)""",
)
def st2(spark, sf):
    """Lines arrive in several batches, sorted by nothing; the stream is started twice and goes on."""
    source, path, checkpoint = (scratch_path(spark, name) for name in ("arriving", "ingested", "ingested-state"))
    lines = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("row_idx"),
        F.col("l_linenumber").alias("sample_idx"),
        F.col("l_shipdate").cast("timestamp").alias("at"),
    )
    lines.repartition(FILES, "at").write.parquet(source)
    done = V.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("row_idx"), F.lit(1).alias("sample_idx")
    )
    for _ in range(2):
        arriving = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = live.start_ingestion(arriving, path, checkpoint, ["row_idx", "sample_idx"], done, remember="1 day")
        query.awaitTermination()
    return spark.read.parquet(path).drop("at")


@query(
    "st1_live_task_report",
    V.with_sql(V.EVENT_SAMPLES_SQL, M._PASSK_SQL)
    + "SELECT model, strategy, metric, CAST(k AS VARCHAR) AS key, round(value, 6) AS value FROM pass_at_k",
)
def st1_tasks(spark, sf):
    """pass@k of samples that arrive in several batches."""
    source, path, checkpoint = (scratch_path(spark, name) for name in ("arriving", "task-report", "task-report-state"))
    samples = ordinals.first_rows(V.event_rows(spark, sf), [*GROUP, *TASK_KEY], ["ts", "event_id"], M.N)
    samples = samples.select(*GROUP, *TASK_KEY, "sample_idx", "prompt", "plannable", "verdict")
    samples.repartition(FILES, "sample_idx", "row_idx").write.parquet(source)
    arriving = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(source)
    # of the written samples, and stored: each batch joins the tasks, which would be found anew for it
    tasks = spark.read.parquet(source).select("task_file", "row_idx").distinct().withColumn("difficulty", F.lit(1))
    tasks = checkpointed(tasks, "tasks")
    live.start_task_report(arriving, tasks, path, checkpoint, M.N).awaitTermination()
    report = live.read_task_report(spark, path, M.N)
    return rounded(report.where("metric LIKE 'pass@k%'"), "value")
