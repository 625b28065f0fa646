"""Rules as tables: the first of very many needles that a text contains.

A few fixed rules are best written as a chain of ``contains``. A table of thousands would search
each text as often; here one automaton of all needles reads each text once. The rules are a
dimension table of a checked size, sent to the workers; texts stay where they are, unshuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 8_000_000  # of all needles; an automaton takes some tens of bytes a character


def load_rules(rules: DataFrame, max_chars: int = MAX_CHARS) -> list[tuple[str, str | None]]:
    """(needle, label) of the rules (place, needle, label) in order, each needle once.

    Rules go by place, NULL first, then needle, then label. Rules without a needle are left out.
    More than ``max_chars`` characters in all needles are an error.
    """
    first = F.min(F.struct("place", "label"))
    each = rules.where("needle IS NOT NULL").groupBy("needle").agg(first.alias("first"))
    chars = each.agg(F.sum(F.char_length("needle") + 1)).first()[0] or 0
    if chars > max_chars:
        raise ValueError(f"the needles hold {chars} characters, more than {max_chars}")
    rows = each.select("first.place", "needle", "first.label").collect()
    rows.sort(key=lambda r: (r.place is not None, r.place or 0, r.needle))
    return [(r.needle, r.label) for r in rows]


@lru_cache(maxsize=2)
def _automaton(needles: tuple[str, ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for place, needle in enumerate(needles):
        if needle:
            automaton.add_word(needle, place)
    automaton.make_automaton()
    return automaton


def first_place(text: Column, needles: DataFrame | list[str]) -> Column:
    """Index of the first of ``needles`` that the text contains; NULL if none or no text.

    An empty needle is in every text.
    """
    if isinstance(needles, DataFrame):
        needles = [needle for needle, _ in load_rules(needles)]
    known = tuple(needles)
    everywhere = known.index("") if "" in known else None

    @F.pandas_udf("long")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(known)
        for texts in batches:
            places = []
            for value in texts:
                if value is None:
                    places.append(None)
                    continue
                found = (place for _, place in automaton.iter(value)) if len(automaton) else ()
                lowest = min(found, default=None)
                if everywhere is not None:
                    lowest = everywhere if lowest is None else min(lowest, everywhere)
                places.append(lowest)
            yield pd.Series(places, dtype="Int64")

    return find(text)


def first_rule(rows: DataFrame, text: str, rules: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with the label of the first rule whose needle is in column ``text``, NULL if none is.

    ``rules`` has the columns place, needle and label; see ``load_rules`` for their order.
    """
    known = load_rules(rules)
    if not known:
        return rows.withColumn(label, F.lit(None).cast("string"))
    place = first_place(F.col(text), [needle for needle, _ in known])
    labels = F.lit([name for _, name in known]) if any(n is not None for _, n in known) else None
    if labels is None:
        return rows.withColumn(label, F.lit(None).cast("string"))
    return rows.withColumn(label, F.element_at(labels.cast("array<string>"), (place + 1).cast("int")))


def without_needles(rows: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """Rows whose ``text`` contains no needle of ``rules``; rows without text stay."""
    known = [needle for needle, _ in load_rules(rules)]
    return rows.where(first_place(F.col(text), known).isNull()) if known else rows
