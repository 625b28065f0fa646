"""Nearest vectors through cells: most of the vectors are ruled out by the triangle inequality.

Every vector belongs to the coarse centroid it is closest to; a cell has a centroid and a radius.
A question first meets its own cell, which gives it a distance to beat; another cell holds nothing
better if its centroid is farther away than that distance and its radius together. So the result
is exact, and centroids, learned on a bounded sample, only decide how much is ruled out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.vectors import best_of, searched, searched_pairs, unit_rows, usable
from gaugeworks.session import checkpointed, shuffle_partitions

SAMPLE_VECTORS = 20_000
MOST_CELLS = 2048
BLOCK_VECTORS = 2048
QUESTIONS_PER_BLOCK = 1024
_ROUNDING = 1e-9  # distances may be off by so much


@dataclass(frozen=True)
class Cells:
    """An index: centroids and radii, and the stored vectors in blocks of one cell."""

    centroids: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    blocks: DataFrame  # _cell, _c_ids, _c_values
    chunk_id: str
    chunk_type: str

    def distances(self, unit: np.ndarray) -> np.ndarray:
        """From each row to each centroid."""
        if self.centroids.shape[1] != unit.shape[1]:
            raise ValueError(f"vectors of different widths: {self.centroids.shape[1]}, {unit.shape[1]}")
        square = (unit**2).sum(axis=1)[:, None] + (self.centroids**2).sum(axis=1) - 2 * unit @ self.centroids.T
        return np.sqrt(np.maximum(square, 0))


def learned_centroids(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """Centroids of a sample of unit vectors: spread starts, then means of what is nearest."""
    rng = np.random.default_rng(0)
    centroids = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ centroids.T - (centroids**2).sum(axis=1) / 2).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        size = np.bincount(own, minlength=len(centroids))
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return centroids


def build(chunks: DataFrame, chunk_id: str = "chunk_id", vector: str = "embedding", cells: int | None = None) -> Cells | None:
    """The index of all ``chunks`` with a vector; None without any. About sqrt(n) cells by default.

    Zero vectors, which have no direction, stand in the cell of the centroid nearest to zero and
    are compared like others: the radius holds for them too.
    """
    rows = usable(chunks, vector).select(chunk_id, vector)
    n = rows.count()
    if not n:
        return None
    order = F.xxhash64(chunk_id, vector)
    sample = rows.orderBy(order).limit(SAMPLE_VECTORS).select(vector).toArrow()[vector]
    centroids = learned_centroids(unit_rows(sample), cells or max(1, min(MOST_CELLS, int(n**0.5))))
    chunk_type = rows.schema[chunk_id].dataType.simpleString()
    bare = Cells(centroids, np.zeros(0), np.zeros(0), rows, chunk_id, chunk_type)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(batch.column(1))
            apart = bare_distances(unit)
            cell = apart.argmin(axis=1)
            values = pa.ListArray.from_arrays(
                pa.array(np.arange(len(unit) + 1) * unit.shape[1], pa.int32()), pa.array(unit.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(unit)), cell]), batch.column(0), values],
                ["_cell", "_apart", chunk_id, "_unit"],
            )

    bare_distances = _distances_of(centroids)
    placed = checkpointed(
        rows.mapInArrow(place, f"_cell int, _apart double, {chunk_id} {chunk_type}, _unit array<double>"), "cells"
    )
    radii, counts = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    sizes = placed.groupBy("_cell").agg(F.max("_apart").alias("radius"), F.count("*").alias("n"))
    for r in sizes.collect():
        radii[r._cell], counts[r._cell] = r.radius, r.n
    # a large cell has as many groups as it fills blocks, so none is gathered whole
    groups = sizes.select("_cell", F.ceil(F.col("n") / BLOCK_VECTORS).alias("_groups"))
    group = F.pmod(F.xxhash64(chunk_id), F.col("_groups"))
    packed = (
        placed.join(groups, "_cell")
        .groupBy("_cell", group.alias("_group"))
        .agg(F.collect_list(F.struct(chunk_id, "_unit")).alias("_all"))
        .select("_cell", F.col(f"_all.{chunk_id}").alias("_c_ids"), F.flatten("_all._unit").alias("_c_values"))
    )
    return Cells(centroids, radii, counts, checkpointed(packed, "cell-blocks"), chunk_id, chunk_type)


def _distances_of(centroids: np.ndarray):
    return Cells(centroids, centroids[:, 0], centroids[:, 0], None, "", "").distances


def _asked(rows: DataFrame, index: Cells, question_id: str, visited) -> DataFrame:
    """Blocks of questions (_cell, _q_ids, _q_values) for each cell that ``visited`` names for them.

    ``rows`` is (question_id, vector, ...); visited(batch, distances) gives a mask questions x cells.
    """
    kind = rows.schema[question_id].dataType.simpleString()
    distances = _distances_of(index.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(batch.column(1))
            mask = visited(batch, distances(unit))
            for cell in np.flatnonzero(mask.any(axis=0)).tolist():
                of = np.flatnonzero(mask[:, cell])
                ids = pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), batch.column(0).take(pa.array(of)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell], pa.int32()), ids, pa.array([unit[of].ravel()], pa.list_(pa.float64()))],
                    ["_cell", "_q_ids", "_q_values"],
                )

    return rows.mapInArrow(run, f"_cell int, _q_ids array<{kind}>, _q_values array<double>")


def own_cells(questions: DataFrame, index: Cells, question_id: str, vector: str) -> DataFrame:
    """Blocks of questions in the cell of the nearest centroid that has vectors."""
    empty = index.counts == 0

    def nearest(_, apart: np.ndarray) -> np.ndarray:
        apart = np.where(empty, np.inf, apart)
        return np.arange(apart.shape[1]) == apart.argmin(axis=1)[:, None]

    return _asked(usable(questions, vector).select(question_id, vector), index, question_id, nearest)


def other_cells(first: DataFrame, index: Cells, question_id: str, vector: str) -> DataFrame:
    """Blocks of questions in all other cells that may hold a better vector than ``first`` found.

    ``first`` is (question_id, vector, score); of unit vectors the distance follows from the score.
    """
    return _asked(first.select(question_id, vector, "score"), index, question_id, _possible(index))


def _possible(index: Cells):
    """The mask of all other cells that may hold a better vector, of batches (question_id, vector, score)."""
    radii, empty = index.radii, index.counts == 0

    def possible(batch: pa.RecordBatch, apart: np.ndarray) -> np.ndarray:
        score = batch.column(2).to_numpy(zero_copy_only=False)
        # where a zero vector may take part, distance says nothing about the score
        beat = np.where(score > 0, np.sqrt(np.maximum(2 - 2 * score, 0)), np.inf)
        mask = ~empty & (apart - radii <= beat[:, None] + _ROUNDING)
        own = np.where(empty, np.inf, apart).argmin(axis=1)
        mask[np.arange(len(mask)), own] = False
        return mask

    return possible


def dealt_questions(first: DataFrame, index: Cells, question_id: str, vector: str, side: int) -> DataFrame:
    """The questions of :func:`other_cells`, a block once for each of ``side`` columns of cells.

    ``_column, _q_ids, _q_values`` with ``_q_cells``, the cells of the column (by rest of ``side``) that
    a question of the block is to visit, and ``_q_masks``, for each of them which questions, as bits. A
    vector is written ``side`` times at most, however many cells it visits.
    """
    rows = first.select(question_id, vector, "score")
    kind = rows.schema[question_id].dataType.simpleString()
    distances, visited = _distances_of(index.centroids), _possible(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, QUESTIONS_PER_BLOCK):
                batch = whole.slice(at, QUESTIONS_PER_BLOCK)
                unit = unit_rows(batch.column(1))
                mask = visited(batch, distances(unit))
                for column in range(side):
                    part = mask[:, column::side]
                    of, cells = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
                    if not len(of):
                        continue
                    bits = np.packbits(part[np.ix_(of, cells)], axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([column], pa.int32()),
                            pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), batch.column(0).take(pa.array(of))),
                            pa.array([unit[of].ravel()], pa.list_(pa.float64())),
                            pa.array([column + side * cells], pa.list_(pa.int32())),
                            pa.array([[bits[:, j].tobytes() for j in range(len(cells))]], pa.list_(pa.binary())),
                        ],
                        ["_column", "_q_ids", "_q_values", "_q_cells", "_q_masks"],
                    )

    return rows.mapInArrow(
        run, f"_column int, _q_ids array<{kind}>, _q_values array<double>, _q_cells array<int>, _q_masks array<binary>"
    )


def _searched_on_grid(first: DataFrame, index: Cells, question_id: str, vector: str) -> DataFrame:
    """(question_id, chunk_id, score) of the best in the other cells that may hold better than ``first``.

    Cells are dealt to the columns of a square grid, blocks of questions to its rows, so what is
    shuffled are ``side`` copies of the vectors at most, and not one for each cell that a question visits.
    """
    side = max(1, int(math.sqrt(shuffle_partitions(first.sparkSession))))
    row = F.pmod(F.xxhash64("_q_ids"), F.lit(side))
    asked = dealt_questions(first, index, question_id, vector, side)
    asked = asked.select("*", (F.col("_column") * side + row).cast("int").alias("_place")).drop("_column")
    start = F.pmod("_cell", F.lit(side)) * side
    offered = index.blocks.select("*", F.explode(F.sequence(start, start + (side - 1))).alias("_place"))
    met = asked.join(offered, (asked["_place"] == offered["_place"]) & F.array_contains("_q_cells", F.col("_cell")))
    mask = F.element_at("_q_masks", F.array_position("_q_cells", F.col("_cell")).cast("int"))
    return searched_pairs(met.withColumn("_q_mask", mask), question_id, index.chunk_id, first)


def nearest_by_cells(
    questions: DataFrame, index: Cells, question_id: str = "question_id", vector: str = "embedding"
) -> DataFrame:
    """``question_id, chunk_id, score`` of the most similar chunk; ties go to the lowest id."""
    asked = usable(questions, vector).select(question_id, vector)
    first = searched(own_cells(asked, index, question_id, vector), index.blocks, "_cell", question_id, index.chunk_id, asked)
    first = checkpointed(best_of(first, question_id, index.chunk_id), "cells-first")
    bounded = asked.join(first, question_id)
    more = _searched_on_grid(bounded, index, question_id, vector)
    return best_of(first.unionByName(more), question_id, index.chunk_id)
