"""CSV tables: headerless files whose first record is the header, dynamic widths, typed reads."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.operators import files as paths
from gaugeworks.sources.records import read_records

# Dataset columns and the names they had in older files.
TASK_COLUMNS = {
    "prompt": ["Prompt"],
    "reference": ["Reference output", "Desired output"],
    "policy": ["Rego intent"],
    "difficulty": ["Difficulty", "Complexity", "Calculated Complexity"],
    "resources": ["Resource"],
}

CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _numbered(names: Sequence[str]) -> list[str]:
    seen: dict[str, int] = {}
    renamed = []
    for name in names:
        repeat = seen.get(name, 0)
        renamed.append(f"{name}.{repeat}" if repeat else name)
        seen[name] = repeat + 1
    return renamed


def unique_names(names: Sequence[str]) -> list[str]:
    """Number repeated header names ``x, x.1, x.2``; again while that collides with a given name."""
    names = list(names)
    while len(set(names)) < len(names):
        names = _numbered(names)
    return names


def find_tables(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of every CSV file below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select("path")
    )


def _header_cells(text_: str) -> list[str]:
    return next(csv.reader(io.StringIO(text_, newline="")))


def read_tables(spark: SparkSession, path: str | Sequence[str], glob: str = "*.csv") -> list[DataFrame]:
    """The CSV files below ``path``: one DataFrame per distinct header.

    Each has ``task_file`` (the file), ``row_idx`` (record position in the file, from 0) and the
    named columns as text, empty cells NULL. Any cell, of the header too, may hold line breaks and
    doubled quotes. Cells beyond the header have no name and are left out. Files are read in
    blocks, by as many tasks as they have, and stored as records in the shared folder.
    """
    records = read_records(spark, path, glob)
    headers = records.filter("row_idx = -1")
    # as many distinct headers as there are kinds of files, not as there are files
    kinds: dict[tuple[str, ...], list[str]] = {}
    for row in headers.select("record").distinct().collect():
        kinds.setdefault(tuple(_header_cells(row.record)), []).append(row.record)
    tables = []
    for cells, texts in sorted(kinds.items()):
        rows = records.filter("row_idx >= 0")
        if len(kinds) > 1:
            rows = rows.join(headers.filter(F.col("record").isin(texts)).select("task_file"), "task_file", "left_semi")
        parsed = F.from_csv("record", ", ".join(f"_{i} string" for i in range(len(cells))), CSV_OPTIONS).alias("_cells")
        named = [
            F.nullif(F.col(f"_cells._{i}"), F.lit("")).alias(name) for i, name in enumerate(unique_names(cells))
        ]
        tables.append(rows.select("task_file", "row_idx", parsed).select("task_file", "row_idx", *named))
    return tables


def as_tasks(table: DataFrame) -> DataFrame:
    """The typed task table, from current or older column names."""

    def given(name: str):
        found = [c for c in TASK_COLUMNS[name] if c in table.columns]
        return F.col(f"`{found[0]}`") if found else F.lit(None).cast("string")

    return table.select(
        "task_file",
        "row_idx",
        given("prompt").alias("prompt"),
        given("reference").alias("reference"),
        given("policy").alias("policy"),
        given("difficulty").try_cast("double").cast("int").alias("difficulty"),
        F.split(given("resources"), ", ").alias("resources"),
    )


def as_booleans(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that arrive as a boolean or as text, as booleans."""
    return table.withColumns({c: text.lenient_true(F.col(f"`{c}`")) for c in columns})


def with_attribution(table: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Model and strategy of each row, from the path of its file."""
    return paths.attribute(table, rules, path="task_file").drop("folder", "n_matches")
