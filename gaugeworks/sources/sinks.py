"""Writers."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator, Sequence
from urllib.parse import quote, urlparse

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import report as reports


def write_samples(
    samples: DataFrame, path: str, partition_by: Sequence[str] = ("model", "strategy"), format: str = "parquet"
) -> None:
    """Evaluated samples, one folder per model and strategy so that reports prune to theirs."""
    samples.write.mode("overwrite").format(format).partitionBy(*partition_by).save(path)


def write_csv(table: DataFrame, path: str) -> None:
    """CSV with a header record per file; every cell quoted, quotes doubled, spaces kept."""
    (
        table.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_report(report: DataFrame, path: str) -> None:
    """The nested JSON report as a text file; the long table stays the primary result."""
    reports.nested_json(report).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_histogram(histogram: DataFrame, key: str, value: str, path: str) -> None:
    reports.flat_json(histogram, key, value).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The folder of ``path`` in the machines' own file tree, None if it lies in another file system."""
    uri = urlparse(path)
    scheme = uri.scheme or urlparse(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).scheme
    return path[len(uri.scheme) + 1 if uri.scheme else 0 :] if scheme == "file" and not uri.netloc else None


def write_files(rows: DataFrame, path: str, key: str, text: str) -> None:
    """A file for each row below the new folder ``path``, with ``key``=value in its path; it holds the text and a line feed.

    For a file in a mounted folder Hadoop starts three processes, to set permissions: its own, its
    checksum's and its folder's. There the tasks write the files, each in a folder of its own that is named when it is whole, so
    a task that failed or ran twice leaves nothing behind.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("value"))
    folder = mounted(rows.sparkSession, path)
    if folder is None:
        rows.withColumnRenamed("key", key).write.partitionBy(key).text(path)
        return
    os.makedirs(folder)
    named = rows.select(F.coalesce(F.col("key").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("key"), "value")

    def run(part: Iterator[Row]) -> None:
        task = TaskContext.get()
        own = f"{folder}/_temporary/{task.taskAttemptId()}"
        os.makedirs(own)
        for n, (value, content) in enumerate(part):
            with open(f"{own}/{key}={quote(value, safe='')}.{n}.txt", "w", encoding="utf-8", newline="") as file:
                file.write(f"{content or ''}\n")
        try:
            os.rename(own, f"{folder}/part-{task.partitionId():05d}")
        except OSError:
            # another attempt has named its folder
            if not os.path.isdir(f"{folder}/part-{task.partitionId():05d}"):
                raise
            shutil.rmtree(own)

    named.foreachPartition(run)
    shutil.rmtree(f"{folder}/_temporary", ignore_errors=True)
