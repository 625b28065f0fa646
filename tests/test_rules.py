"""Rules as tables against a search for each needle."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import rules

SCHEMA = "place long, needle string, label string"


def first_by_hand(text, table):
    if text is None:
        return None
    for place, needle, label in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if needle in text:
            return label
    return None


def test_many_needles_as_by_hand(spark):
    rng = random.Random(4)
    words = list({"".join(rng.choices("abcé", k=rng.randint(3, 7))) for _ in range(12_000)})
    table = [(rng.randint(0, 300), w, f"l{i % 50}") for i, w in enumerate(words)]
    texts = ["".join(rng.choices("abcdéx ", k=rng.randint(0, 60))) for _ in range(200)] + ["", None, "😀abc"]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, place string")
    found = rules.first_rule(rows, "text", spark.createDataFrame(table, SCHEMA))
    assert {r.id: r.label for r in found.collect()} == {i: first_by_hand(t, table) for i, t in enumerate(texts)}
    kept = rules.without_needles(rows, "text", spark.createDataFrame(table, SCHEMA))
    assert {r.id for r in kept.collect()} == {i for i, t in enumerate(texts) if first_by_hand(t, table) is None}


def test_order_nulls_and_repeated_needles(spark):
    table = [(5, "ab", "late"), (None, "abc", "none"), (2, "ab", "early"), (2, "b", "other"), (1, None, "no"), (9, "", "any"), (0, "zz", None)]
    rows = spark.createDataFrame([("xaby",), ("abcd",), ("b",), ("q",), ("zz",), (None,)], "text string")
    found = {r.text: r.label for r in rules.first_rule(rows, "text", spark.createDataFrame(table, SCHEMA)).collect()}
    assert found == {"xaby": "early", "abcd": "none", "b": "other", "q": "any", "zz": None, None: None}


def test_no_rules_and_too_many(spark):
    rows = spark.createDataFrame([("a",)], "text string")
    empty = spark.createDataFrame([], SCHEMA)
    assert rules.first_rule(rows, "text", empty).first().label is None
    assert rules.without_needles(rows, "text", empty).count() == 1
    wide = spark.range(10).select(F.col("id").alias("place"), F.format_string("needle%d", "id").alias("needle"), F.lit("l").alias("label"))
    with pytest.raises(ValueError, match="80 characters"):
        rules.load_rules(wide, max_chars=50)
