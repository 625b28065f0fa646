"""Exact Jaccard join on word shingles: size-aware, with a light and a heavy way, and components.

Two documents link when their sets of shingles are alike enough. Equal sets are one node. A light
(small) set is found by enumeration: it shares a whole subset of a known size with each light
partner, so the hashes of these subsets are its keys. A heavy set scans inverted lists: ordered
by rising corpus frequency, the first shingles of two alike sets must meet, so these are its
keys, and those of the light sets that are large enough to be its partner. The boundary is the
size at which, over the corpus, enumerating costs more than scanning.

Before whole sets are fetched, their parity sketches are compared: the bits in which two sketches
differ are at most the elements in which the sets differ, so no alike pair is refuted. A sketch has
at least as many bits as its set has elements, so those of long texts tell them apart as well; of
two sizes the longer sketch is folded to the shorter.

Links are only needed to join components. So each list first proposes links to a few of its
nodes, and these are verified; then, list by list, members of different components are paired,
which leaves few pairs where copies abound, and none is lost. Every proposed link is verified on
the whole sets.

NULL texts and texts without words have an empty set that links with nothing; texts with fewer
words than a shingle have one shingle, all of them. Repeated rows link like other copies. A
document without doc_id links like any other but gives no component its number; its own is NULL
if it has no partner with a number. An empty table gives an empty one; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.batches import bounded, freeing
from gaugeworks.llm.components import connected
from gaugeworks.llm.shingles import mixed, shingle_sets, sliced
from gaugeworks.session import checkpointed

WIDTH = 3
PERCENT = 90
MAX_LIGHT = 19  # light sets have at most so many shingles
CELL_BITS = 18  # cells that shingles are counted in; their number bounds what tasks receive
_CHUNKS = 8
PIVOTS = 4  # nodes of a list that all others are first compared with
SKETCH_WORDS = 8  # of 64 bits, each the parity of the elements it stands for; more for large sets
_BIT_BITS = 23  # size of the filter for documents whose sets are read again


def least_overlap(a: int, b: int, percent: int) -> int:
    """Common elements that sets of these sizes need to be alike enough."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(size, percent: int):
    """How many of its first elements a set of this size posts; numbers or arrays."""
    return size + (-percent * size // 100) + 1


def subset_keys(hashes: np.ndarray, percent: int, largest: int) -> list[int]:
    """Keys of the subsets that a light set shares with any light partner it is alike with."""
    size = len(hashes)
    partners = range(-(-percent * size // 100), min(100 * size // percent, largest) + 1)
    gone = {size - least_overlap(size, other, percent) for other in partners}
    spread = mixed(~hashes)
    keys: list[int] = []
    for n in sorted(g for g in gone if g >= 0):
        left_out = np.array(list(combinations(range(size), n)), np.int64)
        sums = spread.sum(dtype=np.uint64, keepdims=True) - spread[left_out].sum(axis=1, dtype=np.uint64)
        keys += mixed(sums ^ np.uint64(size - n)).astype(np.int64).tolist()
    return keys


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def cell_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How often shingles of each hash cell occur in the corpus, one count a document.

    Each task counts whole partitions in one byte a cell (what is more stays 255); the sums only
    order shingles, so any counts give the same links. Two steps add up the tasks' counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for texts in sliced([t or "" for t in batch.column(0).to_pylist()]):
                found, _ = shingle_sets(texts, width)
                cells += np.bincount(cell_of(found), minlength=len(cells))
        parts = np.split(np.minimum(cells, 255).astype(np.uint32), _CHUNKS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(_CHUNKS), pa.int64()),
                pa.array([TaskContext.get().partitionId() % 64] * _CHUNKS, pa.int64()),
                pa.array([p.astype(np.uint8).tobytes() for p in parts], pa.binary()),
            ],
            ["chunk", "part", "cells"],
        )

    def add(kind: str):
        def run(table: pa.Table) -> pa.Table:
            total = np.zeros((1 << CELL_BITS) // _CHUNKS, np.uint32)
            for cells in table["cells"]:
                total += np.frombuffer(cells.as_buffer(), kind)
            return pa.table({"chunk": [table["chunk"][0].as_py()], "cells": [total.tobytes()]})

        return run

    counted = docs.select("text").mapInArrow(freeing(count), "chunk long, part long, cells binary")
    some = counted.groupBy("chunk", "part").applyInArrow(add("u1"), "chunk long, cells binary")
    rows = some.groupBy("chunk").applyInArrow(add("<u4"), "chunk long, cells binary").collect()
    parts = {r.chunk: np.frombuffer(r.cells, "<u4") for r in rows}
    return np.concatenate([parts[c] for c in range(_CHUNKS)]) if parts else np.zeros(1 << CELL_BITS, np.uint32)


def sketch_words(sizes: np.ndarray) -> np.ndarray:
    """Words of the sketches: a power of two, with a bit for each element at least."""
    steps = np.ceil(np.log2(np.maximum(sizes, 1) / (64 * SKETCH_WORDS)))
    return SKETCH_WORDS << np.maximum(steps, 0).astype(np.int64)


def sketches(found: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """The parity sketches of sets, given all their hashes and the number of the set of each."""
    words = sketch_words(sizes)
    first = np.cumsum(words) - words
    flat = np.zeros(int(words.sum()), np.uint64)
    bit = found >> np.uint64(8)
    word = (bit >> np.uint64(6)).astype(np.int64) & (words[of] - 1)
    np.bitwise_xor.at(flat, first[of] + word, np.uint64(1) << (bit & np.uint64(63)))
    bounds = np.concatenate((first, [len(flat)]))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))


def describe_sets(
    docs: DataFrame, cells: np.ndarray, width: int, percent: int, keyed: bool = False
) -> DataFrame:
    """Per row: doc_id, n_shingles, the set's digest (d1, d2) and sketch, its keys and what scanning costs.

    ``prefix`` are the keys for inverted lists, ``subsets`` those of a set that may be light,
    ``scan`` the lengths of its lists, as far as the cells tell. ``keyed`` adds the text's hash, text_key.
    """
    more = ["text_key"] if keyed else []
    usual = float(cells.mean())
    # what is above 2^16 need not be ordered further; equal counts are ordered by hash
    rank = np.minimum(cells, (1 << 16) - 1).astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in sliced([t or "" for t in batch.column(1).to_pylist()]):
                found, sizes = shingle_sets(texts, width)
                count = rank[cell_of(found)]
                of = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
                order = np.argsort(count, kind="stable")
                order = order[np.argsort(of[order].astype(np.uint16), kind="stable")]
                begin = np.cumsum(sizes) - sizes
                place = np.arange(len(found)) - begin[of]
                kept = order[place < prefix_size(sizes, percent)[of]]
                per_text = np.bincount(of[kept], minlength=len(texts))
                scan = np.bincount(of[kept], np.maximum(count[kept] - usual, 1.0), len(texts))
                digests, subsets = [], []
                for start, size in zip(begin.tolist(), sizes.tolist()):
                    own = found[start : start + size]
                    digests.append(xxhash.xxh3_128_digest(own))
                    light = 0 < size <= MAX_LIGHT
                    subsets.append(subset_keys(own, percent, MAX_LIGHT) if light else [])
                digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                bounds = pa.array(np.concatenate(([0], np.cumsum(per_text))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(sizes, pa.int32()),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.ListArray.from_arrays(bounds, pa.array(found[kept].view(np.int64))),
                        pa.array(subsets, pa.list_(pa.int64())),
                        pa.array(scan.astype(np.float64)),
                        sketches(found, of, sizes),
                        *(batch.column(2).slice(at, len(texts)) for _ in more),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "prefix", "subsets", "scan", "sketch", *more],
                )
                at += len(texts)

    schema = (
        "doc_id long, n_shingles int, d1 long, d2 long, prefix array<long>, subsets array<long>, scan double, "
        + ", ".join(["sketch array<long>", *(f"{m} long" for m in more)])
    )
    keys = [F.xxhash64("text").alias(name) for name in more]
    return docs.select(F.col("doc_id").cast("long"), "text", *keys).mapInArrow(freeing(run), schema)


def light_boundary(nodes: DataFrame) -> int:
    """The size up to which enumerating subsets costs less than scanning lists."""
    by_size = nodes.where(F.col("size") <= MAX_LIGHT).groupBy("size")
    costs = by_size.agg(F.sum("n_subsets").alias("subsets"), F.sum("scan").alias("scan")).collect()
    gain = np.zeros(MAX_LIGHT + 1)
    for r in costs:
        gain[r["size"]] = r.scan - r.subsets
    return int(np.argmax(np.cumsum(gain)))


def read_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of the nodes in ``wanted`` (node, doc_id, d1, d2), read from a document of each.

    A filter of fixed size on doc_ids spares most other documents the way to the join.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _BIT_BITS))
    # Spark's bitmaps count from 1: the first number is bit 0 of bucket 1
    maps = (
        wanted.select((place + 1).alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        .collect()
    )
    bits = np.zeros((1 << _BIT_BITS) // 8, np.uint8)
    for r in maps:
        begin = (r.bucket - 1) * 4096
        bits[begin : begin + len(r.bits)] = np.frombuffer(r.bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            marked = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(marked.astype(bool)))
            done = 0
            for texts in sliced([t or "" for t in batch.column(1).to_pylist()]):
                found, sizes = shingle_sets(texts, width)
                parts = np.split(found, np.cumsum(sizes)[:-1])
                digests = b"".join(xxhash.xxh3_128_digest(np.ascontiguousarray(p)) for p in parts)
                digest = np.frombuffer(digests, np.int64).reshape(-1, 2)
                bounds = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(texts)),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.ListArray.from_arrays(bounds, pa.array(found.view(np.int64))),
                    ],
                    ["doc_id", "d1", "d2", "hashes"],
                )
                done += len(texts)

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("place", place)
    found = rows.mapInArrow(freeing(run), "doc_id long, d1 long, d2 long, hashes array<long>")
    # any document of the digest has the set; dropped and joined by the same key, so shuffled once
    one = found.select("d1", "d2", "hashes").dropDuplicates(["d1", "d2"])
    return one.join(wanted.select("node", "d1", "d2"), ["d1", "d2"]).select("node", "hashes")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return pairs.join(left, "a").join(right, "b").where(100 * common >= percent * union).select("a", "b")


def _possible(x: str, y: str, percent: int):
    """Whether sets that meet first at these places, of these sizes, can be alike enough."""
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    left = F.least(a - F.col(f"{x}.place"), b - F.col(f"{y}.place"))
    return left * (100 + percent) >= percent * (a + b)


def _folded(sketch, words):
    """A sketch with words laid over each other, down to the given number."""
    over = lambda i: F.aggregate(
        F.sequence(i, F.size(sketch), words), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(sketch, j - 1))
    )
    return F.when(F.size(sketch) == words, sketch).otherwise(F.transform(F.sequence(F.lit(1), words), over))


def _unrefuted(x: str, y: str, percent: int, sketched: bool):
    """Whether the sketches allow as few elements in one set alone as alike sets have."""
    if not sketched:
        return F.lit(True)
    a, b = F.col(f"{x}.sketch"), F.col(f"{y}.sketch")
    words = F.least(F.size(a), F.size(b))
    bits = F.zip_with(_folded(a, words), _folded(b, words), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    return apart * (100 + percent) <= (100 - percent) * (F.col(f"{x}.size") + F.col(f"{y}.size"))


def joined_lists(lists: DataFrame) -> DataFrame:
    """Entries (node, size, place, key) of the lists that hold two nodes, with n and nth.

    n is the list's length, nth the entry's number in it in an order that differs from list to
    list. The entries are shuffled once, by key; all else is done where they are.
    """
    lists = lists.repartition("key")
    lengths = lists.groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")
    )
    met = lists.join(lengths.where("low < high").select("key", "n"), "key")
    mixed_order = Window.partitionBy("key").orderBy(F.xxhash64("node", "key"), "node")
    return met.withColumn("nth", F.row_number().over(mixed_order))


def _pairs(x: DataFrame, y: DataFrame, condition) -> DataFrame:
    """Distinct pairs (a, b) of entries of the same lists that meet a condition."""
    found = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & condition)
    return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def node_components(met: DataFrame, nodes: DataFrame, verify, percent: int) -> DataFrame:
    """(node, component) of all nodes that link with another; a component is its lowest node.

    ``met`` is a stored result of ``joined_lists``, in which any two alike sets share a list at
    their first common key; ``nodes`` has their sizes and, if any, sketches. ``verify`` gives
    those of a stored table of pairs (a, b) whose whole sets are alike.
    """
    sketch = "sketch" in nodes.columns
    known = nodes.select("node", "size", *(["sketch"] if sketch else []))
    pivots = met.where(F.col("nth") <= PIVOTS)
    star = _pairs(met, pivots, (F.col("x.node") != F.col("y.node")) & _possible("x", "y", percent))
    likely = (
        star.alias("s")
        .join(known.alias("x"), F.col("s.a") == F.col("x.node"))
        .join(known.alias("y"), F.col("s.b") == F.col("y.node"))
        .where(_unrefuted("x", "y", percent, sketch))
        .select("a", "b")
    )
    star = checkpointed(likely, "jaccard-pairs")
    links = checkpointed(verify(star), "jaccard-links")
    joined = connected(links)

    # of shorter lists all pairs have been proposed
    label = F.coalesce("component", "node").alias("component")
    labelled = met.where(F.col("n") > PIVOTS).join(joined, "node", "left").select("key", "node", "place", label)
    by_component = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = (
        by_component.groupBy("key")
        .agg(F.max_by("component", "n").alias("main"), F.count("*").alias("components"))
        .where("components > 1")
        .select("key", "main")
    )
    open_ = checkpointed(labelled.join(main, "key").join(known, "node"), "jaccard-open")
    apart = (F.col("x.component") != F.col("y.component")) & (
        (F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    )
    apart = apart & _possible("x", "y", percent) & _unrefuted("x", "y", percent, sketch)
    others = _pairs(open_.where("component != main"), open_, apart)
    unseen = checkpointed(others.join(star, ["a", "b"], "left_anti"), "jaccard-pairs")
    if unseen.isEmpty():
        return joined
    more = checkpointed(verify(unseen), "jaccard-links")
    return joined if more.isEmpty() else connected(links.unionByName(more))


def shingle_components(
    docs: DataFrame, described: DataFrame, nodes: DataFrame, boundary: int, width: int, percent: int
) -> DataFrame:
    """(node, component) of the nodes of ``docs`` that link with another."""
    size = F.col("size")
    same = (
        (F.col("r.d1") == F.col("n.d1"))
        & (F.col("r.d2") == F.col("n.d2"))
        & F.col("r.doc_id").eqNullSafe(F.col("n.doc_id"))
    )
    keyed = described.alias("r").join(nodes.alias("n"), same).select("n.node", "n.size", "r.prefix", "r.subsets")
    nothing = F.array().cast("array<long>")
    scanned = F.when(100 * size >= percent * (boundary + 1), F.col("prefix")).otherwise(nothing)
    subsets = F.when(size <= boundary, F.col("subsets")).otherwise(nothing)
    # subsets meet at the first place: nothing is known of what stands before it
    keys = F.concat(
        F.transform(scanned, lambda key, place: F.struct(place.alias("place"), key.alias("key"))),
        F.transform(subsets, lambda key: F.struct(F.lit(0).alias("place"), key.alias("key"))),
    )
    lists = keyed.select("node", "size", F.inline(keys))
    met = checkpointed(joined_lists(lists), "jaccard-lists")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = checkpointed(nodes.join(both, "node").select("node", "doc_id", "d1", "d2"), "jaccard-wanted")
        return verified(pairs, checkpointed(read_sets(docs, wanted, width), "jaccard-sets"), percent)

    return node_components(met, nodes, verify, percent)


def component_rows(docs: DataFrame, width: int, percent: int, keyed: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the lowest doc_id reachable by links).

    ``keyed`` adds text_key, the text's hash, and first (doc_id, text_key), the document that stands
    for the component: of those of the lowest doc_id, or of all if none has one, that of the lowest
    text_key.
    """
    cells = cell_counts(bounded(docs), width)
    described = checkpointed(describe_sets(docs, cells, width, percent, keyed), "jaccard-described")
    # the least struct has a doc_id if any has
    key = [F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), *([F.col("text_key")] if keyed else [])]
    first = F.struct(*key)
    nodes = checkpointed(
        described.where("n_shingles > 0")
        .groupBy("d1", "d2")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.max("n_shingles").alias("size"),
            F.max(F.size("subsets")).alias("n_subsets"),
            F.max("scan").alias("scan"),
            F.first("sketch").alias("sketch"),
            *([F.min(first).alias("first")] if keyed else []),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "jaccard-nodes",
    )
    joined = shingle_components(docs, described, nodes, light_boundary(nodes), width, percent)
    lowest = [F.min("first").alias("first")] if keyed else []
    own = nodes.join(joined, "node", "left").select(
        "d1", "d2", "doc_id", F.coalesce("component", "node").alias("component"), *(["first"] if keyed else [])
    )
    numbers = own.groupBy("component").agg(F.min("doc_id").alias("component_id"), *lowest)
    of_set = own.select("d1", "d2", "component").join(numbers, "component").drop("component")
    rows = described.select("doc_id", "n_shingles", "d1", "d2", *(["text_key"] if keyed else []))
    linked = rows.join(of_set, ["d1", "d2"], "left")
    return linked.select(
        "doc_id",
        F.col("n_shingles").cast("long").alias("n_shingles"),
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        *(["text_key", "first"] if keyed else []),
    )


def similar_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the lowest doc_id reachable by links)."""
    return component_rows(docs, width, percent)


def keep_one(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One document of each component, one of the lowest doc_id, with its own columns.

    Documents without words are all kept. A component in which none has a doc_id keeps one too, that
    of the lowest hash of its text. Of rows repeated with the same doc_id and text one is kept.
    Documents are told apart by doc_id and text, so several texts of one doc_id stand each for its
    own component.
    """
    found = component_rows(docs, width, percent, keyed=True)
    stands = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    gone = found.where((F.col("n_shingles") > 0) & ~stands)
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key")).distinct()
    same_id = docs["doc_id"].cast("long").eqNullSafe(gone["_gone"])
    kept = docs.join(gone, same_id & (F.xxhash64(docs["text"]) == gone["_gone_key"]), "left_anti")
    words = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) > 0
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    numbered = kept.select(F.struct(*docs.columns).alias("row"), words.alias("words"), F.row_number().over(same).alias("nth"))
    return numbered.where("nth = 1 OR NOT words").select("row.*")
