"""Rules given as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.catalog import views as V
from gaugeworks.catalog.registry import query
from gaugeworks.operators import rules

_WORDS_SQL = """
needles AS (
  SELECT DISTINCT needle FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS needle FROM benchmark)
  WHERE length(needle) >= 8),
found AS (
  SELECT d.doc_id, first(n.needle ORDER BY length(n.needle) DESC, n.needle) AS longest
  FROM documents d JOIN needles n ON contains(d.text, n.needle) GROUP BY d.doc_id)"""


def _word_rules(spark, sf):
    """Words of at least eight letters of the benchmark, the longest first."""
    words = V.table(spark, sf, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("needle"))
    long_words = words.where("char_length(needle) >= 8").distinct()
    return long_words.select((-F.char_length("needle")).alias("place"), "needle", F.col("needle").alias("label"))


@query("u03_rule_table", "WITH " + _WORDS_SQL + " SELECT d.doc_id, f.longest FROM documents d LEFT JOIN found f USING (doc_id)")
def u03_rule_table(spark, sf):
    documents = V.documents(spark, sf, "doc_id", "text")
    return rules.first_rule(documents, "text", _word_rules(spark, sf), "longest").select("doc_id", "longest")


@query(
    "u03_texts_without_needles",
    "WITH " + _WORDS_SQL + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)",
)
def u03_texts_without_needles(spark, sf):
    documents = V.documents(spark, sf, "doc_id", "text")
    return rules.without_needles(documents, "text", _word_rules(spark, sf)).select("doc_id")
