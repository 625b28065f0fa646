"""File paths: filters, attribution to a model and strategy, and derived names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strategies a file name can carry; a path naming none is Standard.
NAMED_STRATEGIES = ["multi-turn", "RAG", "COT", "FSP"]
EVALUATED_PREFIX = "evaluation-dataset-for-"


def _has(path: Column, needle: str) -> Column:
    return F.contains(path, F.lit(needle))


def contains_any(path: Column, needles: Sequence[str]) -> Column:
    return reduce(or_, [_has(path, n) for n in needles], F.lit(False))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def parent_of(path: Column) -> Column:
    """Name of the folder that holds the file."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def stem_of(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def without(files: DataFrame, needles: Sequence[str], path: str = "path") -> DataFrame:
    """Files whose path, folder or name, contains none of the needles."""
    return files.filter(~contains_any(F.col(path), needles))


def in_folder(files: DataFrame, needle: str, path: str = "path") -> DataFrame:
    """Files whose folder contains the needle."""
    return files.filter(_has(folder_of(F.col(path)), needle))


def csv_files(files: DataFrame, path: str = "path") -> DataFrame:
    return files.filter(F.col(path).endswith(".csv"))


def attribute(
    files: DataFrame, rules: Sequence[tuple[str, str, str]], path: str = "path"
) -> DataFrame:
    """Model, strategy and folder of each file, with the number of rules that fit.

    ``rules`` are (model, strategy, folder) names in order; a rule fits when its names are in the
    path. A path without a strategy name fits ``Standard`` rules only, by model and folder. The
    first fitting rule wins. The rules are literals of the expression, so nothing is joined.
    """
    p = F.col(path)
    standard = ~contains_any(p, NAMED_STRATEGIES)
    fitting = []
    for model, strategy, folder in rules:
        fits = _has(p, model) & _has(p, folder)
        named = ~standard & _has(p, strategy)
        fits = fits & ((standard | named) if strategy == "Standard" else named)
        rule = F.struct(
            F.lit(model).alias("model"), F.lit(strategy).alias("strategy"), F.lit(folder).alias("folder")
        )
        fitting.append(F.when(fits, rule))
    hits = files.withColumn("_hits", F.array_compact(F.array(*fitting)))
    first = F.get(F.col("_hits"), F.lit(0))
    return hits.select(
        *files.columns,
        first["model"].alias("model"),
        first["strategy"].alias("strategy"),
        first["folder"].alias("folder"),
        F.size("_hits").alias("n_matches"),
    )


def attribution_status(n_matches: Column) -> Column:
    return (
        F.when(n_matches == 0, F.lit("excluded"))
        .when(n_matches > 1, F.lit("ambiguous"))
        .otherwise(F.lit("assigned"))
    )


def dataset_file(path: Column, dataset_dir: str, prefix: str = "") -> Column:
    """The dataset file an evaluated file was made from, in a folder of the same name."""
    stem = F.get(F.split(stem_of(path), EVALUATED_PREFIX), F.lit(1))
    name = stem
    for strategy in NAMED_STRATEGIES:
        cut = F.substring_index(stem, f"-{strategy}", 1)
        name = F.when(_has(stem, strategy), cut).otherwise(name)
    return F.concat(F.lit(f"{dataset_dir}/"), parent_of(path), F.lit(f"/{prefix}"), name, F.lit(".csv"))


def evaluated_file(path: Column, model: Column, strategy: Column, base_dir: str) -> Column:
    """Where the evaluated copy of a dataset file goes; Standard runs carry no strategy suffix."""
    suffix = F.when(strategy == "Standard", F.lit("")).otherwise(F.concat(F.lit("-"), strategy))
    return F.concat(
        F.lit(f"{base_dir}/"),
        model,
        F.lit("/"),
        parent_of(path),
        F.lit(f"/{EVALUATED_PREFIX}"),
        stem_of(path),
        suffix,
        F.lit(".csv"),
    )


def judged_file(path: Column, judge: str, metric_dir: str = "llm-judge-evaluation-metric") -> Column:
    """Where the judge copy of an evaluated file goes."""
    return F.concat(
        folder_of(path), F.lit(f"/{metric_dir}/{judge}-single-"), stem_of(path), F.lit(".csv")
    )


def measured_file(path: Column, base_dir: str) -> Column:
    """Where the measured copy of a dataset file goes."""
    return F.concat(F.lit(f"{base_dir}/"), parent_of(path), F.lit("/completed-"), stem_of(path), F.lit(".csv"))
