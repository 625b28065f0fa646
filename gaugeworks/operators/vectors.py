"""Best cosine match between two sets of vectors, without emitting their pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import shuffle_partitions

BLOCK_VECTORS = 512
TOKENS_PER_BLOCK = 512
HELD_QUESTIONS = 200_000  # best chunks that a task holds before it returns them


def unit_rows(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of unit rows; zero vectors stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = set(column.value_lengths().to_pylist())
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {sorted(widths)}")
    width = widths.pop() if widths else 0
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    return rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0))


def _packed(rows: DataFrame, name: str, vector: str, per_block: int, out: str) -> DataFrame:
    """Rows packed into blocks where they are: ``{out}_ids``, ``{out}_values`` (unit rows), ``{out}_block``.

    The block number is a hash of its ids, so a repeated task gives the same blocks.
    """
    kind = rows.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, per_block):
                part = batch.slice(first, per_block)
                values = unit_rows(part.column(1))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([values.ravel()], pa.list_(pa.float64()))], [f"{out}_ids", f"{out}_values"]
                )

    blocks = rows.select(name, vector).mapInArrow(run, f"{out}_ids array<{kind}>, {out}_values array<double>")
    return blocks.withColumn(f"{out}_block", F.xxhash64(f"{out}_ids"))


def nearest(
    questions: DataFrame,
    chunks: DataFrame,
    question_id: str = "question_id",
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    per_block: int = BLOCK_VECTORS,
) -> DataFrame:
    """``question_id, chunk_id, score`` of the most similar chunk; ties go to the lowest id.

    Both sides are packed into blocks, and the blocks dealt to the cells of a square grid, about
    as many as there are shuffle partitions: a question block meets the chunk blocks of its row of
    cells, a chunk block the question blocks of its column, so each pair of blocks meets once, on
    an executor. A task holds two blocks and the best chunk so far of a bounded number of questions,
    and returns one row a question. Nothing runs before the result is read. With very many chunks,
    :mod:`gaugeworks.operators.cells` compares far fewer pairs.
    """
    side = max(1, int(math.sqrt(shuffle_partitions(questions.sparkSession))))
    own = F.pmod(F.xxhash64(F.lit(1), "_q_block"), F.lit(side))
    asked = _packed(usable(questions, vector), question_id, vector, per_block, "_q").select(
        "*", F.explode(F.sequence(own * side, own * side + side - 1)).alias("_cell")
    )
    column = F.pmod(F.xxhash64(F.lit(1), "_c_block"), F.lit(side))
    last = F.lit(side * (side - 1)).cast("bigint")
    offered = _packed(usable(chunks, vector), chunk_id, vector, per_block, "_c").select(
        "*", F.explode(F.sequence(column, column + last, F.lit(side).cast("bigint"))).alias("_cell")
    )
    return best_of(searched(asked, offered, "_cell", question_id, chunk_id, questions), question_id, chunk_id)


def best_of(found: DataFrame, question_id: str, chunk_id: str) -> DataFrame:
    """One row a question: the highest score, then the lowest id."""
    # the least struct is the highest score, then the lowest id
    best = F.min(F.struct((-F.col("score")).alias("negative"), F.col(chunk_id).alias("id"))).alias("best")
    return found.groupBy(question_id).agg(best).select(
        question_id, F.col("best.id").alias(chunk_id), (-F.col("best.negative")).alias("score")
    )


def searched(
    asked: DataFrame, offered: DataFrame, on: str, question_id: str, chunk_id: str, questions: DataFrame
) -> DataFrame:
    """(question_id, chunk_id, score): the best chunk that each question meets in each task.

    ``asked`` holds blocks of questions (_q_ids, _q_values), ``offered`` blocks of chunks (_c_ids,
    _c_values); blocks meet where ``on`` is equal. ``questions`` gives the type of the ids.
    """
    return searched_pairs(asked.join(offered, on), question_id, chunk_id, questions)


def searched_pairs(met: DataFrame, question_id: str, chunk_id: str, questions: DataFrame) -> DataFrame:
    """:func:`searched` of blocks that have met; bits ``_q_mask``, if any, name the questions that take part."""
    id_type = questions.schema[question_id].dataType.simpleString()
    chunk_type = met.schema["_c_ids"].dataType.elementType.simpleString()
    mask = [c for c in met.columns if c == "_q_mask"]
    return met.select("_q_ids", "_q_values", "_c_ids", "_c_values", *mask).mapInArrow(
        _search(question_id, chunk_id), f"{question_id} {id_type}, {chunk_id} {chunk_type}, score double"
    )


def _search(question_id: str, chunk_id: str):
    def matrix(batch: pa.RecordBatch, side: str, row: int) -> tuple[pa.Array, np.ndarray]:
        ids = batch.column(f"{side}_ids")[row].values
        values = batch.column(f"{side}_values")[row].values.to_numpy(zero_copy_only=False)
        return ids, values.reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}  # blocks come in any order, so the best of many questions are held

        def hits() -> Iterator[pa.RecordBatch]:
            if best:
                names, scores = zip(*best.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(best), ids_type), pa.array(names, chunks_type), pa.array(scores, pa.float64())],
                    [question_id, chunk_id, "score"],
                )

        ids_type = chunks_type = None
        for batch in batches:
            ids_type = batch.schema.field("_q_ids").type.value_type
            chunks_type = batch.schema.field("_c_ids").type.value_type
            for row in range(batch.num_rows):
                asked, wanted = matrix(batch, "_q", row)
                if "_q_mask" in batch.schema.names:
                    bits = np.frombuffer(batch.column("_q_mask")[row].as_py(), np.uint8)
                    of = np.flatnonzero(np.unpackbits(bits, count=len(asked)))
                    asked, wanted = asked.take(pa.array(of)), wanted[of]
                names, offered = matrix(batch, "_c", row)
                if wanted.shape[1] != offered.shape[1]:
                    raise ValueError(f"vectors of different widths: {wanted.shape[1]}, {offered.shape[1]}")
                order = pc.sort_indices(names)
                names = names.take(order)
                similarity = wanted @ offered[order.to_numpy()].T
                at = similarity.argmax(axis=1)  # the lowest id of equal scores
                top = similarity[np.arange(len(asked)), at].tolist()
                for question, name, score in zip(asked.to_pylist(), names.take(pa.array(at)).to_pylist(), top):
                    held = best.get(question)
                    if held is None or score > held[1] or (score == held[1] and name < held[0]):
                        best[question] = (name, score)
                if len(best) > HELD_QUESTIONS:
                    yield from hits()
                    best = {}
        yield from hits()

    return run


def _blocks(tokens: DataFrame, key: Sequence[str], side: str, per_block: int) -> DataFrame:
    """Token vectors packed into blocks of bounded length; a long text spreads over many."""
    place = F.col("token_idx").cast("bigint")
    rows = tokens.filter(F.col("side") == side).withColumns(
        {"token_idx": place, "block": F.floor(place / per_block)}
    )
    packed = F.collect_list(F.struct("token_idx", "embedding"))
    return rows.groupBy(*key, "block").agg(packed.alias(f"{side}_tokens")).drop("block")


def soft_match(
    tokens: DataFrame, key: Sequence[str], per_block: int = TOKENS_PER_BLOCK
) -> DataFrame:
    """``key, precision, recall, f1, f3`` of token vectors matched greedily by cosine.

    ``tokens`` holds ``key, side, token_idx, embedding`` with side ``candidate`` or ``reference``
    and token positions counted from 0. Precision averages the best match of each candidate
    token, recall that of each reference token. Blocks of the two sides meet; each meeting
    returns one best value per token, so memory is bounded by two blocks however long a text is.
    A pair with an empty side scores 0 throughout.
    """
    key = list(key)
    rows = usable(tokens, "embedding")
    candidates = _blocks(rows, key, "candidate", per_block)
    references = _blocks(rows, key, "reference", per_block)
    key_ddl = ", ".join(f"`{k}` {tokens.schema[k].dataType.simpleString()}" for k in key)
    best = (
        candidates.join(references, key)
        .mapInArrow(_match_blocks(key), f"{key_ddl}, is_candidate boolean, token_idx bigint, best double")
        .groupBy(*key, "is_candidate", "token_idx")
        .agg(F.max("best").alias("best"))
    )
    means = best.groupBy(*key).agg(
        F.avg(F.when(F.col("is_candidate"), F.col("best"))).alias("precision"),
        F.avg(F.when(~F.col("is_candidate"), F.col("best"))).alias("recall"),
    )
    both = tokens.groupBy(*key).agg(F.count("*").alias("_n")).drop("_n").join(means, key, "left")
    means = both.fillna(0.0, ["precision", "recall"])
    p, r = F.col("precision"), F.col("recall")

    def f_score(beta: int):
        b = float(beta * beta)
        return F.coalesce(F.try_divide((1 + b) * p * r, b * p + r), F.lit(0.0))

    return means.select(*key, "precision", "recall", f_score(1).alias("f1"), f_score(3).alias("f3"))


def _match_blocks(key: Sequence[str]):
    def side(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        structs = cell.values
        return structs.field("token_idx").to_numpy(zero_copy_only=False), unit_rows(structs.field("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows, flags, positions, best = [], [], [], []
            for row in range(batch.num_rows):
                c_idx, c = side(batch.column("candidate_tokens")[row])
                r_idx, r = side(batch.column("reference_tokens")[row])
                similarity = c @ r.T
                rows.append(np.full(len(c_idx) + len(r_idx), row))
                flags.append(np.arange(len(c_idx) + len(r_idx)) < len(c_idx))
                positions += [c_idx, r_idx]
                best += [similarity.max(axis=1), similarity.max(axis=0)]
            origin = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_pydict(
                {k: batch.column(k).take(origin) for k in key}
                | {
                    "is_candidate": np.concatenate(flags),
                    "token_idx": np.concatenate(positions),
                    "best": np.concatenate(best),
                }
            )

    return run
