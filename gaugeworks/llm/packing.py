"""Packing documents into sequences of bounded length by a grouping genetic algorithm.

A document's ids end with an end id; only documents longer than a sequence are cut, into pieces
of full length and a rest. Full pieces are sequences of their own. All other pieces are dealt by
a hash to blocks of bounded size; each block is packed by several islands. On an
island an individual is a set of bins; crossover takes the best-filled whole bins of one parent,
drops those of the other that share a piece with them, and fits the displaced pieces in: they
take the place of smaller pieces of a bin which they fill better, and what is loose in the end goes
where it fits best; mutation dissolves the worst-filled bins. Islands start from one best fit of
the longest first and from fits in random orders. Between epochs every island sends its best
individual to the next island of its block. An island stops when generations bring nothing more, or as
soon as the number of bins is the total length divided by a bin, rounded up, which nothing can beat.

NULL texts count as empty and hold the end id alone. Repeated rows are packed as often as they
come, with equal keys. NULL doc_ids are packed like others. An empty table gives no rows; only
the columns named here are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.batches import bounded, freeing
from gaugeworks.llm.bpe import split_pattern
from gaugeworks.llm.words import Pieces, WordIds, slices
from gaugeworks.session import checkpointed, shuffle_partitions

CAPACITY = 2048
BLOCK_PIECES = 8192
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 6
POPULATION = 8
PATIENCE = 8  # an island runs at most so many times its generations without gain
SWAPPED = 6  # a bin's longest pieces, of which one or two are swapped at a time

# fixed value: the splitting pattern of the lower-case vocabulary
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def blank_words(text: str) -> list[str]:
    """Words of a plain text; lowered at once where lowering letter by letter gives the same."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ").split(" ")
    return text.lower().replace("\n", " ").split(" ")


class LowerPieces(Pieces):
    """Ids of words whose tokenizer lowers letters and drops white space.

    Words up to U+00FF need no normal form; all others go through the whole tokenizer.
    """

    def __init__(self, tokenizer) -> None:
        findall = split_pattern(_PATTERN)
        super().__init__(tokenizer.model, lambda word: findall(word.lower()))
        self._tokenizer = tokenizer

    def __call__(self, words: list[str]):
        for word in words:
            if not word or max(word) <= "\xff":
                yield from super().__call__([word])
            else:
                yield self._tokenizer.encode(word, add_special_tokens=False).ids, (), ()


@lru_cache(maxsize=2)
def _lower_words(path: str, remember: int | None = None) -> WordIds:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    # this tokenizer drops white space and never joins what it parts
    return WordIds(LowerPieces(tokenizer), blank_words, lambda text: [text], remember=remember)


def pieces(
    docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, remember: int | None = None
) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32.

    ``remember`` bounds the words whose ids a worker keeps; it costs time, not results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _lower_words(path, remember)
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for texts in slices([t or "" for t in batch.column(1).to_pylist()]):
                ids, ends = codec.encode(texts)
                rows, begin = [], 0
                for key, end in zip(keys[at:], ends.tolist()):
                    own = np.append(ids[begin:end], end_id).astype("<u4")
                    for n, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start : start + capacity]
                        rows.append((key, n, start, len(piece), zlib.crc32(piece)))
                    begin = end
                at += len(texts)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(freeing(run), schema)


class Bins:
    """Bins under construction, found by their free room.

    ``free`` lists (room, bin) ascending, so the fullest bin that still takes a piece is one
    bisection away.
    """

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[tuple[int, int]] = []

    def add(self, bin_: list[int]) -> None:
        room = self.capacity - sum(self.sizes[p] for p in bin_)
        if room:
            insort(self.free, (room, len(self.bins)))
        self.bins.append(bin_)

    def best_fit(self, pieces_: list[int], longest_first: bool = True) -> list[list[int]]:
        """Put each piece, the longest first, where it leaves the least room; else in a new bin."""
        for p in sorted(pieces_, key=lambda p: (-self.sizes[p], p)) if longest_first else pieces_:
            size = self.sizes[p]
            at = bisect_left(self.free, (size, -1))
            if at < len(self.free):
                room, bin_ = self.free.pop(at)
            else:
                room, bin_ = self.capacity, len(self.bins)
                self.bins.append([])
            self.bins[bin_].append(p)
            if room > size:
                insort(self.free, (room - size, bin_))
        return self.bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, fuller full ones (the mean squared fill)."""
    fill = [sum(sizes[p] for p in b) / capacity for b in bins]
    return -len(bins), sum(f * f for f in fill) / max(len(fill), 1)


def swap_in(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """``bins`` with loose pieces: first in place of smaller ones, then where they fit best.

    One or two pieces of a bin make room for one or two loose ones that leave less of it empty. What
    comes out is smaller than what goes in, so it is fitted in more easily.
    """
    loose = sorted(loose, key=lambda p: sizes[p])
    keys = [sizes[p] for p in loose]
    done = Bins(sizes, capacity)
    for bin_ in bins:
        bin_ = list(bin_)
        room = capacity - sum(sizes[p] for p in bin_)
        if room and loose:
            longest = sorted(bin_, key=lambda p: -sizes[p])[:SWAPPED]
            gain, out, into = 0, (), ()
            for given in [*((p,) for p in longest), *combinations(longest, 2)]:
                size = sum(sizes[p] for p in given)
                one = bisect_right(keys, room + size) - 1
                if one >= 0 and keys[one] - size > gain:
                    gain, out, into = keys[one] - size, given, (one,)
                # the second of two is the longest that the first, one of the longest, leaves room for
                for first in range(one, max(one - SWAPPED, 0), -1):
                    second = min(bisect_right(keys, room + size - keys[first]), first) - 1
                    if second >= 0 and keys[first] + keys[second] - size > gain:
                        gain, out, into = keys[first] + keys[second] - size, given, (first, second)
                if gain == room:
                    break
            if gain:
                bin_ = [p for p in bin_ if p not in out] + [loose[i] for i in into]
                for i in sorted(into, reverse=True):
                    del loose[i], keys[i]
                for p in out:
                    at = bisect_left(keys, sizes[p])
                    loose.insert(at, p)
                    keys.insert(at, sizes[p])
        done.add(bin_)
    return done.best_fit(loose)


def crossover(
    giver: list[list[int]], taker: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator
) -> list[list[int]]:
    """Whole well-filled bins of ``giver`` go into ``taker``; what they displace is fitted in anew."""
    rest = np.array([capacity - sum(sizes[p] for p in b) for b in giver])
    good = np.flatnonzero(rest <= np.quantile(rest, 0.5))
    chosen = [giver[b] for b in rng.choice(good, max(1, len(good) // 2), replace=False).tolist()]
    taken = {p for b in chosen for p in b}
    kept = [b for b in taker if taken.isdisjoint(b)]
    displaced = [p for b in taker if not taken.isdisjoint(b) for p in b if p not in taken]
    return swap_in(chosen + kept, displaced, sizes, capacity)


def mutate(
    bins: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator
) -> list[list[int]]:
    """Dissolve the emptiest bins and a few others, and fit their pieces in anew."""
    rest = np.array([capacity - sum(sizes[p] for p in b) for b in bins])
    worst = np.argsort(-rest, kind="stable")[: max(2, len(bins) // 50)].tolist()
    gone = {*worst, *rng.choice(len(bins), max(1, len(bins) // 50)).tolist()}
    kept = [b for n, b in enumerate(bins) if n not in gone]
    return swap_in(kept, [p for n in sorted(gone) for p in bins[n]], sizes, capacity)


def evolve(
    sizes: list[int], seeds: list[list[list[int]]], capacity: int, generations: int, seed: int
) -> list[list[int]]:
    """The best bins found for pieces of the given sizes, from some individuals to start with.

    Ends after ``generations`` without gain, or after PATIENCE times as many.
    """
    lowest = -(-sum(sizes) // capacity)
    rng = np.random.default_rng(seed)

    def ranked(bins: list[list[int]]) -> tuple[tuple[int, float], list[list[int]]]:
        return fitness(bins, sizes, capacity), bins

    def rank(individual: tuple[tuple[int, float], list[list[int]]]) -> tuple[int, float]:
        return individual[0]

    population = [ranked(s) for s in seeds if s]
    if not population:
        population.append(ranked(Bins(sizes, capacity).best_fit(list(range(len(sizes))))))
    best = max(population, key=rank)
    if len(best[1]) <= lowest:
        return best[1]
    while generations and len(population) < POPULATION:
        order = rng.permutation(len(sizes)).tolist()
        population.append(ranked(Bins(sizes, capacity).best_fit(order, longest_first=False)))
    without = 0
    for _ in range(PATIENCE * generations):
        population.sort(key=rank, reverse=True)
        best = population[0]
        if len(best[1]) <= lowest or without >= generations:
            break
        a, b = (population[n][1] for n in rng.permutation(len(population))[:2].tolist())
        children = [
            crossover(a, b, sizes, capacity, rng),
            crossover(best[1], a, sizes, capacity, rng),
            mutate(best[1], sizes, capacity, rng),
        ]
        # the worst make place, never the best
        population = population[: POPULATION - len(children)] + [ranked(c) for c in children]
        without = 0 if max(map(rank, population)) > rank(best) else without + 1
    return max(population, key=rank)[1]


def _lists(bins: list[list[int]], n: int) -> list[int]:
    """The bin of each of n pieces."""
    of = [0] * n
    for number, b in enumerate(bins):
        for p in b:
            of[p] = number
    return of


def _bins(of: list[int] | None) -> list[list[int]]:
    if not of:
        return []
    bins: list[list[int]] = [[] for _ in range(max(of) + 1)]
    for piece, b in enumerate(of):
        bins[b].append(piece)
    return bins


def pack(
    parts: DataFrame,
    capacity: int = CAPACITY,
    block_pieces: int = BLOCK_PIECES,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
) -> DataFrame:
    """Add sequence_id and offset to ``parts`` (doc_id, piece, length and further columns).

    ``parts`` is read several times and must be a stored table, so that its rows keep their places.
    Lengths above ``capacity`` raise.
    """
    columns = parts.columns
    row = F.struct(*columns)
    checked = F.when(F.col("length") <= capacity, F.col("length")).otherwise(
        F.raise_error(F.lit(f"a piece is longer than {capacity}")).cast("long")
    )
    keyed = parts.select(checked.alias("size"), row.alias("row"))
    part_rows = keyed.where(f"size < {capacity}")
    blocks = max(1, -(-part_rows.count() // block_pieces))

    # the place in the stored table parts repeated rows
    block = F.pmod(F.xxhash64("row", F.monotonically_increasing_id()), F.lit(blocks))
    dealt = part_rows.select(block.alias("block"), "size", "row")
    gathered = dealt.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("size"), "row"))).alias("all")
    )
    stored = checkpointed(gathered, "packing-blocks")
    # islands are few bytes and much work, so their tasks are counted, not sized
    tasks = max(1, min(blocks * islands, shuffle_partitions(parts.sparkSession)))

    def run(generations_: int, epoch: int):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block_, island, sizes, own, guest in zip(*(c.to_pylist() for c in batch.columns)):
                    seed = (block_ * islands + island) * epochs + epoch
                    found = evolve(sizes, [_bins(own), _bins(guest)], capacity, generations_, seed)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block_], pa.int64()),
                            pa.array([island], pa.int64()),
                            pa.array([sizes], pa.list_(pa.int64())),
                            pa.array([_lists(found, len(sizes))], pa.list_(pa.int64())),
                            pa.array([len(found)], pa.int64()),
                        ],
                        ["block", "island", "sizes", "bins", "n_bins"],
                    )

        return step

    schema = "block long, island long, sizes array<long>, bins array<long>, n_bins long"
    nothing = F.lit(None).cast("array<long>")
    evolved = (
        stored.select(
            "block",
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))).alias("island"),
            F.transform("all", lambda p: -p["size"]).alias("sizes"),
            nothing.alias("own"),
            nothing.alias("guest"),
        )
        .repartition(tasks, "block", "island")
        .mapInArrow(run(generations, 0), schema)
    )
    for epoch in range(1, epochs):
        now = checkpointed(evolved, "packing-islands")
        guests = now.select(
            "block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("bins").alias("guest")
        )
        evolved = (
            now.withColumnRenamed("bins", "own")
            .join(guests, ["block", "island"])
            .select("block", "island", "sizes", "own", "guest")
            .repartition(tasks, "block", "island")
            .mapInArrow(run(generations, epoch), schema)
        )
    best = evolved.groupBy("block").agg(F.min_by("bins", F.struct("n_bins", "island")).alias("bins"))
    placed = (
        stored.join(best, "block")
        .select("block", F.explode(F.arrays_zip(F.col("all.row").alias("row"), F.col("bins").alias("bin"))).alias("p"))
        .select(
            F.col("block"), F.col("p.bin").alias("bin"), F.col("p.row").alias("row")
        )
    )
    ahead = (
        Window.partitionBy("block", "bin").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    )
    small = placed.select(
        "row.*",
        (F.col("block") * (1 << 32) + F.col("bin")).alias("sequence_id"),
        F.coalesce(F.sum("row.length").over(ahead), F.lit(0)).cast("long").alias("offset"),
    )
    full = keyed.where(f"size = {capacity}").select(
        "row.*",
        (-F.monotonically_increasing_id() - 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return small.unionByName(full)


def pack_documents(
    docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, remember: int | None = None
) -> DataFrame:
    """Encode, cut and pack ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    stored = checkpointed(pieces(docs, path, end_id, capacity, remember), "packing-pieces")
    return pack(stored, capacity)
