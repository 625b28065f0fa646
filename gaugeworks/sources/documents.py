"""Whole-file sources: plan documents and document folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_plans(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """``plan_id`` (the file) and the parsed document of every plan below a folder."""
    texts = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path, wholetext=True)
    )
    return texts.select(F.col("_metadata.file_path").alias("plan_id"), F.parse_json("value").alias("doc"))


def read_plan_lines(spark: SparkSession, path: str, key: str = "plan_id") -> DataFrame:
    """Many plans per file: each line an object with ``plan_id`` and the document ``doc``."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.parse_json("value").alias("v"))
    return lines.select(
        F.variant_get("v", f"$.{key}", "string").alias(key), F.variant_get("v", "$.doc", "variant").alias("doc")
    )


def read_documents(spark: SparkSession, path: str, whole_path: bool = False) -> DataFrame:
    """``doc_id`` (the file name, or the whole path) and ``text`` of every file below a folder."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.col("_metadata.file_path") if whole_path else F.col("_metadata.file_name")
    return texts.select(name.alias("doc_id"), F.col("value").alias("text"))
