"""Assembling the report: metrics by name, enrichment, order and the nested JSON form."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import prompts
from gaugeworks.operators import accuracy, bleu
from gaugeworks.schemas import GROUP, REPORT

Metric = Callable[[DataFrame], DataFrame]


class Metrics:
    """Metrics by name; a metric maps its input rows to result rows."""

    def __init__(self, named: Mapping[str, Metric] | None = None):
        self._named = dict(named or {})

    def add(self, name: str, metric: Metric) -> None:
        self._named[name] = metric

    def names(self) -> list[str]:
        return sorted(self._named)

    def run(self, name: str, rows: DataFrame) -> DataFrame:
        if name not in self._named:
            raise ValueError(f"unknown metric {name!r}; known: {', '.join(self.names())}")
        return self._named[name](rows)


def _bleu_report(pairs: DataFrame) -> DataFrame:
    key = [c for c in pairs.columns if c not in ("reference", "candidate")]
    return accuracy.mean_scores(bleu.bleu(pairs, key), ["bleu"])


def _judge_requests(pairs: DataFrame, metric: str) -> DataFrame:
    request = prompts.judge_prompt(metric, F.col("prompt"), F.col("candidate"), F.col("reference"))
    return pairs.select(*[c for c in pairs.columns if c not in ("reference", "candidate")], request.alias("request"))


def default_metrics() -> Metrics:
    """Metrics on pairs ``model, strategy, <key>, prompt, reference, candidate``."""
    return Metrics(
        {
            "bleu": _bleu_report,
            "exact_match": lambda pairs: accuracy.exact_match_rate(pairs, GROUP),
            "llm-single": lambda pairs: _judge_requests(pairs, "llm-single"),
            "llm-reference": lambda pairs: _judge_requests(pairs, "llm-reference"),
        }
    )


def assemble(*families: DataFrame) -> DataFrame:
    """One long report from metric families."""
    return reduce(DataFrame.unionByName, [f.select(*REPORT) for f in families])


def enrich(report: DataFrame, other: DataFrame, metric: str = "accuracy", group: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """Add one metric of another report to every group of this one; NULL where it has none."""
    extra = other.filter((F.col("metric") == metric) & (F.col("key") == ""))
    groups = report.select(*group).distinct()
    added = groups.join(extra.select(*group, "value"), list(group), "left").select(
        *group, F.lit(metric).alias("metric"), F.lit("").alias("key"), "value"
    )
    return report.select(*added.columns).unionByName(added)


def sorted_report(report: DataFrame) -> DataFrame:
    return report.orderBy("model", "strategy", "metric", "key")


def nested_json(report: DataFrame) -> DataFrame:
    """One row ``json``: model -> strategy -> metric -> value, or key -> value.

    A report has as many rows as models x strategies x metrics, so it fits one row.
    """

    def mapping(key: str, value: Column) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), value))))

    by_metric = report.groupBy("model", "strategy", "metric").agg(
        F.max("key").alias("_last_key"),
        F.max("value").alias("_value"),
        F.to_json(mapping("key", F.col("value"))).alias("_keyed"),
    )
    scalar = F.coalesce(F.col("_value").cast("string"), F.lit("null"))
    node = F.when(F.col("_last_key") == "", scalar).otherwise(F.col("_keyed"))

    def joined(rows: DataFrame, group: list[str], name: str, text) -> DataFrame:
        quoted = F.regexp_replace(F.to_json(F.array(F.col(name))), r"^\[|\]$", "")
        member = F.concat(quoted, F.lit(": "), text)
        members = F.array_join(F.array_sort(F.collect_list(member)), ", ")
        return rows.groupBy(*group).agg(F.concat(F.lit("{"), members, F.lit("}")).alias("json"))

    by_strategy = joined(by_metric.withColumn("json", node), ["model", "strategy"], "metric", F.col("json"))
    by_model = joined(by_strategy, ["model"], "strategy", F.col("json"))
    return joined(by_model, [], "model", F.col("json"))


def flat_json(histogram: DataFrame, key: str, value: str) -> DataFrame:
    """One row ``json`` from a small table of names and counts."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))
    return histogram.agg(F.to_json(F.map_from_entries(entries)).alias("json"))
