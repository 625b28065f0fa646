"""Language of a text by cross-parsing against labelled text of each language.

A suffix automaton of a language's training text recognises exactly the substrings of that text.
A text is cut greedily into the longest phrases that the automaton knows; a phrase ends with the
first letter that cannot continue it. The language that needs the fewest phrases, each weighted
with the logarithm of its training text's length, wins; of several, the one with most training
rows, then the alphabetically first. Texts are parsed in stretches of a fixed length, many at
once: the steps of all automata lie in one compact table, and every step of all stretches and
languages is one look-up. Every labelled language is learned, and all its letters are told apart.

Texts are read as lower-case letters, with one blank for whatever stands between them. NULL texts
and texts without a letter are "und" with score 0; of a very long text every letter counts.
Repeated rows give repeated results, and teach once. Without training rows every text is "und".
An empty table gives an empty one; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.batches import bounded

UNKNOWN = "und"
TRAIN_ROWS = 64  # labelled texts read for each language
TRAIN_LETTERS = 40_000  # letters and blanks of them that its automaton holds
_STRETCH = 1024
_BATCH_CHARS = 1_000_000
_TRIES = 16  # places tried for a state before the search moves on


@dataclass(frozen=True)
class Model:
    """Training text of each language; small, and all that a task needs."""

    languages: tuple[str, ...]
    texts: tuple[str, ...]


def letters_only(text: str) -> str:
    """Lower-case letters with single blanks in place of all else."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in symbols:
        state = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in steps[at]:
            steps[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = steps[at][symbol]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(steps)
                steps.append(dict(steps[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and steps[at].get(symbol) == target:
                    steps[at][symbol] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    return steps


def packed(steps: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each state, owner of each cell, target of each cell).

    The step of a state by a symbol lies in the cell of its place plus the symbol, if that cell is
    its own. States with several steps are laid first, those with most before the others, into the
    gaps of what lies there; states with one step, by far the most, fill the cells that are left.
    """
    width = max((symbol for step in steps for symbol in step), default=0) + 1
    n_steps = sum(map(len, steps))
    # cells below ``width`` stay free, so that no place is negative
    taken = bytearray(b"\1" * width + bytes(n_steps + width))
    place = np.zeros(len(steps), np.int32)
    low = width
    several = [state for state, step in enumerate(steps) if len(step) > 1]
    for state in sorted(several, key=lambda state: -len(steps[state])):
        symbols = sorted(steps[state])
        cell, tries = low - 1, 0
        while True:
            cell = taken.find(0, cell + 1)
            at = cell - symbols[0]
            if cell < 0 or at + symbols[-1] >= len(taken):
                cell = len(taken) if cell < 0 else cell
                taken.extend(bytes(cell + 2 * width - len(taken)))
                at = cell - symbols[0]
            if not any(taken[at + symbol] for symbol in symbols):
                break
            tries += 1
        if tries > _TRIES:
            # states with one step fill what is left behind
            low = cell
        place[state] = at
        for symbol in symbols:
            taken[at + symbol] = 1
    single = [state for state, step in enumerate(steps) if len(step) == 1]
    free = np.flatnonzero(np.frombuffer(taken, np.uint8) == 0)
    if len(free) < len(single):
        free = np.concatenate([free, len(taken) + np.arange(len(single) - len(free))])
    place[single] = free[: len(single)] - np.array([next(iter(steps[s])) for s in single], np.int64)
    cells = int(place.max(initial=0)) + width
    owner, target = np.full(cells, -1, np.int32), np.zeros(cells, np.int32)
    of = np.repeat(np.arange(len(steps)), list(map(len, steps)))
    at = place[of] + np.fromiter((c for step in steps for c in step), np.int64, n_steps)
    owner[at] = of
    target[at] = np.fromiter((t for step in steps for t in step.values()), np.int64, n_steps)
    return place, owner, target


class Parser:
    """Phrase counts of many texts in all languages of a model.

    Where a state has no step by a symbol, a new phrase begins in the state that the symbol leads
    to from the automaton's start. Parsing begins, and goes on after a letter that the language
    lacks, in a state without steps.
    """

    def __init__(self, model: Model) -> None:
        found = Counter(c for text in model.texts for c in text if c != " ")
        known = [c for c, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))]
        # 0: between words, 1: a letter of no language
        number = {" ": 0} | {c: n for n, c in enumerate(known, 2)}
        self.width = len(known) + 2
        self.symbol_of = np.zeros(0x110000, np.int32)
        self.symbol_of[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
        self.symbol_of[list(map(ord, known))] = range(2, self.width)
        self.start, self.weight = [], []
        places, owners, targets, firsts = [], [], [], []
        states = cells = 0
        for text in model.texts:
            steps = suffix_automaton([number[c] for c in text])
            outside = len(steps)
            steps.append({})
            place, owner, target = packed(steps)
            first = np.full(self.width, states + outside, np.int32)
            first[list(steps[0])] = states + np.array(list(steps[0].values()), np.int32)
            places.append(place + cells)
            owners.append(np.where(owner < 0, -1, owner + states).astype(np.int32))
            targets.append(target + states)
            firsts.append(first)
            self.start.append(states + outside)
            self.weight.append(math.log2(max(len(text), 2)))
            states += len(steps)
            cells += len(owner)
        # a state's place plus any symbol is a cell
        beyond = np.full(self.width, -1, np.int32)
        self.place = np.concatenate(places)
        self.owner = np.concatenate([*owners, beyond])
        self.target = np.concatenate([*targets, beyond])
        self.first = np.concatenate(firsts)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, one after the other, and how many each has."""
        lower = [text.lower() for text in texts]
        code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
        found = self.symbol_of[code]
        doubled = np.zeros(len(found), bool)
        doubled[1:] = (found[1:] == 0) & (found[:-1] == 0) & (of[1:] == of[:-1])
        found, of = found[~doubled], of[~doubled]
        return found, np.bincount(of, minlength=len(lower))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by language and text, symbols of each text, whether it has a letter)."""
        symbols, sizes = self.symbols(texts)
        ends = np.cumsum(sizes)
        has_letter = np.zeros(len(texts), bool)
        begins = ends - sizes
        has_letter[np.searchsorted(ends, np.flatnonzero(symbols), side="right")] = True
        pieces = -(-sizes // _STRETCH)
        text_of = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = begins[text_of] + nth * _STRETCH
        size = np.minimum(_STRETCH, ends[text_of] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, text_of = begin[order], size[order], text_of[order]
        state = np.repeat(np.array(self.start, np.int32)[:, None], len(order), 1)
        count = np.zeros(state.shape, np.int32)
        row = (np.arange(len(self.start), dtype=np.int32) * self.width)[:, None]
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for step, n in enumerate(active.tolist()):
            now, symbol = state[:, :n], symbols[begin[:n] + step]
            cell = self.place.take(now) + symbol
            ended = self.owner.take(cell) != now
            count[:, :n] += ended
            state[:, :n] = np.where(ended, self.first.take(row + symbol), self.target.take(cell))
        total = np.array([np.bincount(text_of, c, len(texts)) for c in count])
        return total.reshape(len(self.start), len(texts)), sizes, has_letter

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the language, score, bits a symbol, whether there is a letter) of each text.

        The score is the share of the second-best language's cost that the best one saves. The
        bits are what the best one's phrases after the first cost for each symbol.
        """
        total, sizes, has_letter = self.phrases(texts)
        cost = total * np.array(self.weight)[:, None]
        best = np.argmin(cost, axis=0)
        bits = (cost.min(axis=0) - np.array(self.weight)[best]) / np.maximum(sizes, 1)
        if len(cost) == 1:
            return best, has_letter.astype(float), bits, has_letter
        two = np.sort(cost, axis=0)[:2]
        score = np.where(has_letter, 1 - two[0] / np.maximum(two[1], 1e-9), 0.0)
        return best, score, bits, has_letter


@lru_cache(maxsize=1)
def _parser(model: Model) -> Parser:
    return Parser(model)


def equal_shares(texts: list[str], letters: int) -> list[str]:
    """The beginnings of the texts, equally long but for shorter texts, of ``letters`` in all."""
    shares, left = {}, letters
    for n, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        shares[i] = min(len(texts[i]), left // (len(texts) - n))
        left -= shares[i]
    return [text[: shares[i]] for i, text in enumerate(texts)]


def fit(
    docs: DataFrame, train_rows: int = TRAIN_ROWS, train_letters: int = TRAIN_LETTERS
) -> Model:
    """Training text of each language, from rows with text and lang.

    Read are the ``train_rows`` different texts of each language that have the lowest hash; each
    gives an equal share of the ``train_letters`` that an automaton holds. Shares are taken in
    tasks, so the driver gets one text a language, of that length at most.
    """
    spark = docs.sparkSession
    rows = bounded(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64("text").alias("hash"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model((), ())
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    lowest = rows.select("lang", "hash").distinct().select("lang", "hash", nth.alias("nth"))
    last = lowest.where(F.col("nth") <= train_rows).groupBy("lang").agg(F.max("hash").alias("last")).collect()
    # one number a language, less than the model that every task gets
    last = spark.createDataFrame([(r.lang, r["last"]) for r in last], "lang string, last long")
    chosen = rows.join(F.broadcast(last), "lang").where(F.col("hash") <= F.col("last"))
    once = chosen.groupBy("lang", "hash").agg(F.min("text").alias("text"))

    @F.pandas_udf("string")
    def beginning(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: letters_only(text)[:train_letters])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        texts = group.sort_values("hash").text.tolist()
        # the blank between two shares makes up for one at the end of a share, so that languages
        # with text enough have equally long ones and equal weights
        shares = equal_shares([t for t in texts if t], train_letters + 1)
        text = " ".join(s.strip() for s in shares)[:train_letters]
        return pd.DataFrame({"lang": group.lang.iloc[:1], "text": [text]})

    found = (
        once.select("lang", "hash", beginning("text").alias("text"))
        .groupBy("lang")
        .applyInPandas(joined, "lang string, text string")
        .collect()
    )
    learned = sorted((r for r in found if r.text), key=lambda r: (-counts[r.lang], r.lang))
    return Model(tuple(r.lang for r in learned), tuple(r.text for r in learned))


def predict(text: Column, model: Model) -> Column:
    """A struct lang_pred, score, bits of a text; see ``Parser.predict``."""

    @F.pandas_udf("lang_pred string, score double, bits double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = _parser(model) if model.languages else None
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts = [t or "" for t in batch]
            found, scores, all_bits, at = [], [], [], 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and size < _BATCH_CHARS:
                    size += len(texts[end])
                    end += 1
                if parser is None:
                    best, known = np.full(end - at, -1), np.zeros(end - at, bool)
                    score = bits = np.zeros(end - at)
                else:
                    best, score, bits, known = parser.predict(texts[at:end])
                found.append(names[np.where(known, best, -1)])
                scores.append(score)
                all_bits.append(bits)
                at = end
            yield pd.DataFrame(
                {
                    "lang_pred": np.concatenate(found) if found else [],
                    "score": np.concatenate(scores) if scores else [],
                    "bits": np.concatenate(all_bits) if all_bits else [],
                }
            )

    return run(text)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The documents in a learned language, with their own columns.

    Rejected are texts without a letter, and those for which even the best language needs more
    bits a symbol than a symbol drawn at random from the letters learned.
    """
    random_bits = math.log2(max(2, len({c for text in model.texts for c in text})))
    of = docs.select(F.struct(*docs.columns).alias("row"), predict(F.col("text"), model).alias("of"))
    return of.where((F.col("of.lang_pred") != UNKNOWN) & (F.col("of.bits") <= random_bits)).select("row.*")


def held_out(folds: int = 4, rest: int = 2) -> Column:
    """Whether a row is held out: the checksum of its key's text has this rest."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return F.coalesce(part == rest, F.lit(False))
