"""Texts scored by a log-bilinear language model trained with noise-contrastive estimation.

Tokens are lower-case words and one end a text. The model predicts the class of the next token
from the three before it: frequent words and the end are classes of their own, other words share
a class with those of the same last letters. Inside a class a word has its share of the
training counts, with half a count for each seen word and for all unseen ones together, so the
probabilities of all tokens sum to 1. Context words have one vector for each hash bucket, weighted by
place; a class has a vector and a bias, and their products are normalised over all classes. Classes
and buckets grow with the fourth root of the training vocabulary.

Counts cover all training rows. They meet the texts by blocks of documents: each block asks for
the counts of the words it has, so neither the vocabulary nor a text is ever in one place.
Training deals all training rows to rounds by hash. A round goes over its rows in every partition,
starting from the average of the round before; the first starts from random vectors. So every
training row teaches, and no model stands on a sample. A table of few rows has two rounds over all
of them, the first of several passes.

NULL texts count as empty: their only token is the end. Repeated rows are scored alike. A row
without doc_id is a training row. Without training rows every count is 0, and the scores are those
of the untrained model. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.batches import bounded
from gaugeworks.llm.shingles import word_spans
from gaugeworks.llm.words import slices
from gaugeworks.session import checkpointed

END = b""
BLOCK_BYTES = 16 << 20  # text of one block of documents
WORD_CLASSES = 126  # frequent words at least
SUFFIX_CLASSES = 128  # endings at least
BUCKETS = 4096  # at least
GROWTH = 5  # frequent words for each unit of the vocabulary's fourth root
WIDTH = 16
CONTEXT = 3
NOISE = 32
BATCH = 8192
_SCORE_CELLS = 1 << 18  # tokens times classes of one matrix product, which then fits the cache
ROUND_DOCS = 6000  # a round has about so many training rows at least
TASK_DOCS = 1500  # a task learns from about so many in a round at least, or averages are of models that know little
RATES = (0.3, 0.3, 0.3, 0.2, 0.1, 0.05)  # of the rounds
FEW_PASSES = 4  # over a table too small for two rounds
_HELD_WORDS = 500_000
_OTHER, _END_CLASS = 0, 1
_END_BUCKET = 0
_MARKS = b".,;:!?#*$%&|<>()\"'"
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS)] = True


def tokens(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words of a text and its end."""
    found = (text or "").encode().lower().split()
    found.append(END)
    return found


def suffix(word: bytes) -> bytes:
    """The last two bytes before closing marks."""
    return (word.rstrip(_MARKS) or word)[-2:]


def suffix_code(ending: bytes) -> int:
    return ending[-1] + 256 * (ending[-2] + 1 if len(ending) > 1 else 0)


def held_out(folds: int = 5, rest: int = 1) -> Column:
    """Whether a row is held out: the checksum of its key's text has this rest."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return F.coalesce(part == rest, F.lit(False))


def class_numbers(n_words: int) -> tuple[int, int, int]:
    """(frequent words, endings, buckets) of a model for a vocabulary of this size."""
    grown = int(GROWTH * n_words**0.25)
    frequent = max(WORD_CLASSES, grown)
    return frequent, max(SUFFIX_CLASSES, grown), max(BUCKETS, 32 * frequent)


@dataclass(frozen=True)
class Classes:
    """Classes of all words, their share of the training tokens, and the size of the corpus.

    Classes of one word have numbers below ``first_suffix``.
    """

    words: dict[bytes, int]
    suffixes: dict[bytes, int]
    mass: np.ndarray
    n_tokens: int
    n_words: int
    first_suffix: int
    buckets: int

    def of(self, word: bytes) -> int:
        known = self.words.get(word)
        return self.suffixes.get(suffix(word), _OTHER) if known is None else known


@dataclass
class Weights:
    """Parameters of the model as one vector, with views."""

    flat: np.ndarray
    buckets: int = BUCKETS

    @classmethod
    def start(cls, mass: np.ndarray, buckets: int = BUCKETS) -> Weights:
        n = len(mass)
        rng = np.random.default_rng(0)
        flat = rng.normal(0, 0.1, buckets * WIDTH + n * WIDTH + CONTEXT * WIDTH + n).astype(np.float32)
        self = cls(flat, buckets)
        self.place[:] = 1.0
        self.bias[:] = np.log(mass / mass.sum())
        return self

    @property
    def n(self) -> int:
        return (len(self.flat) - (self.buckets + CONTEXT) * WIDTH) // (WIDTH + 1)

    @property
    def context(self) -> np.ndarray:
        return self.flat[: self.buckets * WIDTH].reshape(self.buckets, WIDTH)

    @property
    def target(self) -> np.ndarray:
        return self.flat[self.buckets * WIDTH :][: self.n * WIDTH].reshape(self.n, WIDTH)

    @property
    def place(self) -> np.ndarray:
        return self.flat[(self.buckets + self.n) * WIDTH :][: CONTEXT * WIDTH].reshape(CONTEXT, WIDTH)

    @property
    def bias(self) -> np.ndarray:
        return self.flat[-self.n :]


def contexts(buckets: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Buckets of the tokens 1, 2, ... places before; before a text stands the end."""
    out = np.full((CONTEXT, len(buckets)), _END_BUCKET, np.int64)
    for back in range(1, CONTEXT + 1):
        out[back - 1, back:] = np.where(nth[back:] >= back, buckets[:-back], _END_BUCKET)
    return out


def class_log10(weights: Weights, before: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each token's class, by batched matrix products."""
    out = np.empty(len(classes))
    size = max(1, _SCORE_CELLS // weights.n)
    with_bias = np.vstack([weights.target.T, weights.bias])
    ones = np.ones(weights.n, np.float32)
    # a vector is weighted by place once, not with each token; a context predicts the sum of its vectors
    placed = np.zeros((CONTEXT, weights.buckets, WIDTH + 1), np.float32)
    placed[:, :, :WIDTH] = weights.context * weights.place[:, None]
    placed[0, :, WIDTH] = 1  # the factor of the bias
    rows = np.arange(size)
    for at in range(0, len(classes), size):
        given = placed[0].take(before[0, at : at + size], axis=0)
        for back in range(1, CONTEXT):
            given += placed[back].take(before[back, at : at + size], axis=0)
        logits = given @ with_bias
        own = logits[rows[: len(logits)], classes[at : at + size]]
        np.exp(logits, out=logits)
        out[at : at + size] = own - np.log(logits @ ones)
    return out / math.log(10)


class Trainer:
    """Noise-contrastive training with one set of noise classes a batch, by AdaGrad."""

    def __init__(self, weights: Weights, mass: np.ndarray, rate: float, seed: int) -> None:
        self.weights = weights
        self.noise = mass / mass.sum()
        self.log_noise = np.log(NOISE * self.noise).astype(np.float32)
        self.rate = rate
        self.seen = np.full(len(weights.flat), 1.0, np.float32)
        self.rng = np.random.default_rng(seed)
        self.tokens = 0

    def batch(self, before: np.ndarray, classes: np.ndarray) -> None:
        w = self.weights
        n = len(classes)
        noise = self.rng.choice(len(self.noise), NOISE, p=self.noise)
        vectors = w.context[before]
        given = np.einsum("cnw,cw->nw", vectors, w.place)
        true, false = w.target[classes], w.target[noise]
        score = np.einsum("nw,nw->n", given, true) + w.bias[classes] - self.log_noise[classes]
        scores = given @ false.T + (w.bias[noise] - self.log_noise[noise])
        pull = 1 / (1 + np.exp(np.clip(score, -30, 30)))
        push = -1 / (1 + np.exp(-np.clip(scores, -30, 30)))
        towards = pull[:, None] * true + push @ false
        step = Weights(np.zeros_like(w.flat), w.buckets)
        size = step.n
        # columns that lie together, and one sum for all places
        pulled, drawn, places_ = (pull[:, None] * given).T.copy(), towards.T.copy(), before.ravel()
        for j in range(WIDTH):
            step.target[:, j] = np.bincount(classes, pulled[j], size)
            step.context[:, j] = np.bincount(places_, np.outer(w.place[:, j], drawn[j]).ravel(), w.buckets)
        np.add.at(step.target, noise, push.T @ given)
        step.bias[:] = np.bincount(classes, pull, size)
        np.add.at(step.bias, noise, push.sum(axis=0))
        step.place[:] = np.einsum("nw,cnw->cw", towards, vectors)
        step.flat /= n / 64  # a batch weighs as 64 tokens
        self.seen += step.flat * step.flat
        w.flat += self.rate * step.flat / np.sqrt(self.seen)
        self.tokens += n


class Encoder:
    """Words as classes and context buckets, without a Python step for each word."""

    def __init__(self, classes: Classes) -> None:
        frequent = {w: c for w, c in classes.words.items() if w != END}
        hashes = word_spans([b" ".join(frequent)])[0]
        order = np.argsort(hashes)
        self._hashes = hashes[order]
        self._classes = np.array(list(frequent.values()), np.int64)[order]
        self._buckets = np.uint64(classes.buckets)
        self._of_suffix = np.full(257 * 256, _OTHER, np.int64)
        for ending, number in classes.suffixes.items():
            self._of_suffix[suffix_code(ending)] = number

    def words(self, content: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, bucket, number of its text) of every word."""
        hashes, of, first, last, data = word_spans(content)
        if not len(hashes):
            return of, of, of
        end = last - 1
        marked = np.flatnonzero(_IS_MARK[data[end]])
        if len(marked):
            # most words end in no mark or few
            for _ in range(3):
                end[marked] -= 1
                marked = marked[_IS_MARK[data[end[marked]]] & (end[marked] >= first[marked])]
            if len(marked):
                kept = np.where(_IS_MARK[data], -1, np.arange(len(data)))
                end[marked] = np.maximum.accumulate(kept)[last[marked] - 1]
        end = np.where(end < first, last - 1, end)
        before = np.where(end > first, data[end - 1].astype(np.int64) + 1, 0)
        found = self._of_suffix[before * 256 + data[end]]
        if len(self._hashes):
            at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
            found = np.where(self._hashes[at] == hashes, self._classes[at], found)
        return found, (hashes % self._buckets).astype(np.int64), of

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, bucket, place in its text) of every token."""
        classes, buckets, of = self.words([t.encode() for t in texts])
        sizes = np.bincount(of, minlength=len(texts))
        ends = np.cumsum(sizes)
        return np.insert(classes, ends, _END_CLASS), np.insert(buckets, ends, _END_BUCKET), places(sizes + 1)


def places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive runs of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``docs``; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"]
            )

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                if len(held) > _HELD_WORDS:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def find_classes(counts: DataFrame) -> Classes:
    """Classes from the stored counts; the driver receives the frequent words and suffix totals."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_frequent, n_suffixes, buckets = class_numbers(total.v)
    first_suffix = 2 + n_frequent
    top = counts.where(F.length("word") > 0).orderBy(F.desc("c"), "word").limit(n_frequent).collect()
    words = {END: _END_CLASS} | {bytes(r.word): n for n, r in enumerate(top, 2)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for word, c in zip(*(column.to_pylist() for column in batch.columns)):
                if word not in words:
                    sums[suffix(word)] += c + 0.5
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.keys(), pa.binary()), pa.array(sums.values(), pa.float64())], ["suffix", "mass"]
        )

    by_suffix = counts.mapInArrow(run, "suffix binary, mass double").groupBy("suffix").agg(F.sum("mass").alias("mass"))
    rows = by_suffix.orderBy(F.desc("mass"), "suffix").collect()  # two bytes: at most 65,793 rows
    suffixes = {bytes(r.suffix): n for n, r in enumerate(rows[:n_suffixes], first_suffix)}
    mass = np.full(first_suffix + n_suffixes, 0.5)
    for r in rows:
        mass[suffixes.get(bytes(r.suffix), _OTHER)] += r.mass
    for r in top:
        mass[words[bytes(r.word)]] = r.c + 0.5
    ends = counts.where(F.length("word") == 0).first()
    mass[_END_CLASS] = (ends.c if ends else 0) + 0.5
    return Classes(words, suffixes, mass, total.n or 0, total.v, first_suffix, buckets)


def averaged(rows: list) -> np.ndarray | None:
    """The mean of weights, each by its number of tokens; None without any."""
    n = sum(r.n for r in rows)
    return (sum(np.frombuffer(r.weights) for r in rows) / n).astype(np.float32) if n else None


def train(docs: DataFrame, classes: Classes, seed_docs: int = ROUND_DOCS) -> Weights:
    """A model of all ``docs``; no round has fewer than about ``seed_docs`` of them, where there are as many."""

    def fitted(start: np.ndarray | None, passes: int, rate: float, part: DataFrame) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            if start is None:
                begin = Weights.start(classes.mass, classes.buckets)
            else:
                begin = Weights(start.copy(), classes.buckets)
            trainer = Trainer(begin, classes.mass, rate, TaskContext.get().partitionId())
            encode = Encoder(classes)
            for batch in batches:
                for texts in slices([t or "" for t in batch.column(0).to_pylist()]):
                    of, buckets, nth = encode(texts)
                    before = contexts(buckets, nth)
                    for _ in range(passes):
                        for at in range(0, len(of), BATCH):
                            trainer.batch(before[:, at : at + BATCH], of[at : at + BATCH])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()], pa.int64()),
                    pa.array([trainer.tokens], pa.int64()),
                    pa.array([trainer.weights.flat.tobytes()], pa.binary()),
                ],
                ["part", "n", "weights"],
            )

        def add(table: pa.Table) -> pa.Table:
            total = sum(
                n * np.frombuffer(w, np.float32).astype(np.float64)
                for n, w in zip(table["n"].to_pylist(), table["weights"].to_pylist())
            )
            return pa.table({"n": [sum(table["n"].to_pylist())], "weights": [np.asarray(total).tobytes()]})

        rows = part.select("text").mapInArrow(run, "part long, n long, weights binary")
        groups = rows.where("n > 0").withColumn("part", F.pmod("part", F.lit(64)))
        return groups.groupBy("part").applyInArrow(add, "n long, weights binary").collect()

    n_docs = docs.count()
    parts = max(1, min(len(RATES), n_docs // seed_docs))
    tasks = max(1, n_docs // parts // TASK_DOCS)
    of_part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    few = ((FEW_PASSES, RATES[0]), (1, RATES[-1]))
    flat = None
    for n, (passes, rate) in enumerate(few if parts == 1 else [(1, rate) for rate in RATES]):
        part = docs.where(of_part == n % parts).coalesce(tasks)
        found = averaged(fitted(flat, passes, rate, part))
        flat = flat if found is None else found
    return Weights.start(classes.mass, classes.buckets) if flat is None else Weights(flat, classes.buckets)


def score(docs: DataFrame, counts: DataFrame, classes: Classes, weights: Weights, *keep: str) -> DataFrame:
    """The columns ``keep`` and n_tokens, n_known, base_score, score of each document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    row = F.struct(*keep)
    block = F.pmod(F.xxhash64(row, "text"), F.lit(blocks)).cast("long")
    dealt = docs.select(block.alias("block"), row.alias("row"), "text")

    def distinct(table: pa.Table) -> pa.Table:
        words: set[bytes] = set()
        for text in table["text"].to_pylist():
            words.update(tokens(text))
        found = pa.array(words, pa.binary())
        return pa.table({"block": pa.array([table["block"][0].as_py()] * len(found), pa.int64()), "word": found})

    asked = dealt.groupBy("block").applyInArrow(distinct, "block long, word binary")
    answered = asked.join(counts, "word", "left").select("block", "word", F.coalesce("c", F.lit(0)).cast("long").alias("c"))
    names = ("n_tokens", "n_known", "base_score", "score")
    flat, buckets, n_words, n_tokens = weights.flat, weights.buckets, classes.n_words, classes.n_tokens

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        model = Weights(flat, buckets)
        # frequent words lie together, so most look-ups stay in the cache
        found = found.sort_by([("c", "descending")])
        words, c = found["word"].to_pylist(), found["c"].to_numpy()
        place = dict(zip(words, range(len(words))))
        # the end is the only word that is empty
        end = place[END]
        of, bucket_of, _ = Encoder(classes).words([b" ".join(words)])
        of, bucket_of = np.insert(of, end, _END_CLASS), np.insert(bucket_of, end, _END_BUCKET)
        # a class of one word is that word
        inside = np.where(of < classes.first_suffix, 0.0, np.log10((c + 0.5) / classes.mass[of]))
        inside[of == _OTHER] = np.log10((c[of == _OTHER] + 0.5) / classes.mass[_OTHER])
        base = np.log10((c + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
        columns: list[list] = [[], [], [], []]
        for part in slices([t or "" for t in texts["text"].to_pylist()], 2_000_000):
            lists = [tokens(text) for text in part]
            sizes = np.array([len(x) for x in lists])
            ids = np.fromiter(map(place.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
            before = contexts(bucket_of[ids], places(sizes))
            own = class_log10(model, before, of[ids]) + inside[ids]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            columns[0] += sizes.tolist()
            columns[1] += np.bincount(doc, c[ids] > 0, len(sizes)).astype(np.int64).tolist()
            columns[2] += np.bincount(doc, base[ids], len(sizes)).tolist()
            columns[3] += np.bincount(doc, own, len(sizes)).tolist()
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        scored = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.Table.from_arrays(
            [texts["row"], *scored], schema=pa.schema([texts.schema.field("row"), *map(pa.field, names, kinds)])
        )

    schema = T.StructType([dealt.schema["row"]])
    for name, kind in zip(names, (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())):
        schema.add(name, kind)
    scored = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)
    return scored.select("row.*", "n_tokens", "n_known", "base_score", "score")


def train_and_score(docs: DataFrame) -> DataFrame:
    """Score all documents by a model learned from those that are not held out."""
    marked = bounded(docs).select("doc_id", "text", held_out().alias("held_out"))
    training = marked.where(~F.col("held_out"))
    counts = checkpointed(word_counts(training), "lm-counts")
    classes = find_classes(counts)
    weights = train(training, classes)
    scored = score(marked, counts, classes, weights, "doc_id", "held_out")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(classes.n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
