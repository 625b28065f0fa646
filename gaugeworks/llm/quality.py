"""Quality rules learned as a decision list and applied as Spark conditions.

Texts are described by counts of words, symbols, repeats and cases. From a bounded sample of
labelled documents, sequential covering grows one conjunction of thresholds at a time on two
thirds of the sample, prunes it on the rest, keeps it while it is precise there, and goes on with
what it does not cover. The rules become one ordered CASE expression over the counts.

NULL and empty texts have no words; they fail the base rule. Repeated rows are judged alike.
Without labelled rows there are no rules and only the base rule decides. An empty table gives an
empty one; of further columns only those asked for are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.batches import bounded

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_digits",
    "n_marks",
    "n_distinct",
)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.frombuffer(b"!?", np.uint8)

SAMPLE_ROWS = 20_000  # labelled rows the rules are fitted on
MIN_PRECISION = 0.9  # share of a rule's rows on the pruning part that must be bad
MIN_ROWS = 4  # bad rows a rule must cover
MAX_RULES = 12
MAX_CONDITIONS = 3


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside any 3-word window that occurs twice or more, and the number of distinct words."""
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    if len(words) < 4:
        return 0, len(numbers)
    # pairs are numbered first, so that the key of a window cannot overflow
    _, pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
    _, windows, found = np.unique(
        pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True
    )
    again = found[windows] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= again
    return int(covered.sum()), len(numbers)


def count_text(text: str | None) -> tuple[int, ...]:
    """The numbers named in ``COUNTS``."""
    content = (text or "").encode()
    data = np.frombuffer(content, np.uint8)
    per_byte = np.bincount(data, minlength=256)
    words = content.split()
    lines = [line for line in content.split(b"\n") if line.strip(_SPACES)]
    repeats, distinct = repeated_words(words)
    continuing = int(per_byte[0x80:0xC0].sum())
    return (
        len(words),
        len(data) - continuing - int(per_byte[_SPACE].sum()),
        int(per_byte[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        int(per_byte[ord("A") : ord("Z") + 1].sum()),
        int(per_byte[ord("0") : ord("9") + 1].sum()),
        int(per_byte[_MARKS].sum()),
        distinct,
    )


def counts(text: Column) -> Column:
    """A struct of the counts of a text."""

    @F.pandas_udf(", ".join(f"{name} long" for name in COUNTS))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([count_text(t) for t in batch], columns=list(COUNTS), dtype="int64")

    return count(text)


def base_failed(of: Column) -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (of["n_words"] < 50) | (100 * of["n_repeat_words"] > 50 * of["n_words"])


def features(of: Column) -> dict[str, Column]:
    """What rules may test, by name; all are numbers that long and short texts can share."""
    words = F.greatest(of["n_words"], F.lit(1))
    chars = F.greatest(of["word_chars"], F.lit(1))
    return {
        "n_words": of["n_words"].cast("double"),
        "word_length": of["word_chars"] / words,
        "symbols_per_word": of["n_symbols"] / words,
        "repeated_lines": of["n_dup_lines"] / F.greatest(of["n_lines"], F.lit(1)),
        "repeated_words": of["n_repeat_words"] / words,
        "words_per_line": of["n_words"] / F.greatest(of["n_lines"], F.lit(1)),
        "upper_share": of["n_upper"] / chars,
        "digit_share": of["n_digits"] / chars,
        "marks_per_word": of["n_marks"] / words,
        "distinct_share": of["n_distinct"] / words,
    }


@dataclass(frozen=True)
class Condition:
    """One threshold: the feature is above it, or not."""

    feature: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        values = columns[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        value = columns[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for condition in rule:
        held &= condition.holds(columns)
    return held


def _best_condition(columns: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold of the largest information gain for the bad rows (that of FOIL).

    Of equal gains that in the widest gap is taken, measured by the spread of its feature.
    """
    p0, n0 = bad.sum(), len(bad)
    best: tuple[float, float, Condition | None] = (0.0, 0.0, None)
    for name, values in columns.items():
        order = np.argsort(values, kind="stable")
        ordered, hits = values[order], np.cumsum(bad[order])
        cuts = np.flatnonzero(ordered[1:] > ordered[:-1])
        if not len(cuts):
            continue
        for above in (False, True):
            p = (p0 - hits[cuts]) if above else hits[cuts]
            n = (n0 - cuts - 1) if above else cuts + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), 0.0)
            gaps = (ordered[cuts + 1] - ordered[cuts]) / (ordered[-1] - ordered[0])
            top = np.flatnonzero(gain >= gain.max() - 1e-9)
            at = int(top[np.argmax(gaps[top])])
            found = (round(float(gain[at]), 6), float(gaps[at]))
            if found[0] > 0 and found > best[:2]:
                middle = float((ordered[cuts[at]] + ordered[cuts[at] + 1]) / 2)
                best = (*found, Condition(name, above, middle))
    return best[0], best[2]


def grow(columns: dict[str, np.ndarray], bad: np.ndarray, most: int = MAX_CONDITIONS) -> Rule:
    """Conditions added one by one until only bad rows are covered or nothing is gained."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and not bad[inside].all():
        _, condition = _best_condition({k: v[inside] for k, v in columns.items()}, bad[inside])
        if condition is None:
            break
        rule += (condition,)
        inside &= condition.holds(columns)
    return rule


def prune(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The first conditions of a rule that do best on other rows: (rule, precision, bad rows covered)."""
    best: tuple[float, Rule, float, int] = (-2.0, (), 0.0, 0)
    for size in range(1, len(rule) + 1):
        held = _covered(rule[:size], columns, len(bad))
        p = int(bad[held].sum())
        n = int(held.sum()) - p
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0] + 1e-9:
            best = (worth, rule[:size], p / (p + n) if p + n else 0.0, p)
    return best[1:]


def learn(columns: dict[str, np.ndarray], bad: np.ndarray, pruning: np.ndarray) -> list[Rule]:
    """The decision list: rules for bad rows in the order in which they were found.

    ``pruning`` marks the rows kept back for pruning.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        growing, testing = left & ~pruning, left & pruning
        if bad[growing].sum() < MIN_ROWS or bad[growing].all():
            break
        rule = grow({k: v[growing] for k, v in columns.items()}, bad[growing])
        rule, precision, hits = prune(rule, {k: v[testing] for k, v in columns.items()}, bad[testing])
        if not rule or precision < MIN_PRECISION or hits < MIN_ROWS // 2:
            break
        rules.append(rule)
        left &= ~_covered(rule, columns, len(bad))
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules for documents labelled with quality 0.

    Fitted on the ``sample_rows`` labelled rows of lowest key hash, whose number bounds what is
    broadcast and what the driver receives. Documents that fail the base rule are left out.
    """
    by_hash = F.xxhash64("doc_id")
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .select("doc_id", "quality")
        .orderBy(by_hash, "doc_id", "quality")
        .limit(sample_rows)
    )
    known = bounded(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    described = known.select(by_hash.alias("hash"), "quality", counts(F.col("text")).alias("of"))
    rows = described.where(~base_failed(F.col("of"))).select(
        "hash", "quality", *(c.alias(name) for name, c in features(F.col("of")).items())
    )
    # documents that repeat a doc_id could be more than the sample
    table = rows.limit(sample_rows).toPandas().sort_values(["hash", "quality"], kind="stable")
    columns = {name: table[name].to_numpy(float) for name in features(F.col("of"))}
    return learn(columns, (table["quality"] == 0).to_numpy(bool), (table["hash"] % 3 == 0).to_numpy(bool))


def verdict(rules: list[Rule], of: Column) -> Column:
    """True unless the first rule that holds, if any, says that the document is bad."""
    if not rules:
        return F.lit(True)
    named = features(of)
    chosen = None
    for rule in rules:
        holds = rule[0].column(named)
        for condition in rule[1:]:
            holds &= condition.column(named)
        chosen = F.when(holds, False) if chosen is None else chosen.when(holds, False)
    return chosen.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """The columns ``keep``, the counts, base_failed and kept of each document."""
    of = F.col("_of")
    described = bounded(docs).select(F.struct(*keep).alias("_row"), counts(F.col("text")).alias("_of"))
    failed = base_failed(of)
    return described.select(
        "_row.*", "_of.*", failed.alias("base_failed"), (~failed & verdict(rules, of)).alias("kept")
    )


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that pass, with their own columns."""
    of = F.col("_of")
    described = bounded(docs).select(F.struct(*docs.columns).alias("_row"), counts(F.col("text")).alias("_of"))
    return described.where(~base_failed(of) & verdict(rules, of)).select("_row.*")
