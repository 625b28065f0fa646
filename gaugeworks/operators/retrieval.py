"""Document chunks, their vectors, and the contexts retrieved for a prompt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import prompts, text
from gaugeworks.operators import vectors
from gaugeworks.operators.ordinals import first_rows
from gaugeworks.operators.samples import with_question

CHUNK_TOKENS = 400
CHUNK_OVERLAP = 20


def token_windows(tokens: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping windows of a token array; a window that would add nothing new is not made."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    last = F.greatest(F.size(tokens) - overlap, F.lit(1)) - 1
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    windows = F.transform(starts, lambda s: F.slice(tokens, s + 1, size))
    return F.when(F.size(tokens) > 0, windows)


def chunk_documents(
    documents: DataFrame, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, key: str = "doc_id"
) -> DataFrame:
    """``doc_id, chunk_idx, text`` of every whole document; a document without tokens has none."""
    windows = token_windows(F.col("_tokens"), size, overlap)
    return (
        documents.select(key, text.tokens(F.col("text")).alias("_tokens"))
        .select(key, F.posexplode(windows).alias("chunk_idx", "_window"))
        .select(key, "chunk_idx", F.array_join("_window", " ").alias("text"))
    )


def with_vectors(chunks: DataFrame, vector_table: DataFrame, key: Sequence[str] = ("doc_id", "chunk_idx")) -> DataFrame:
    """All chunks with their vector; NULL marks those that have none yet."""
    return chunks.join(vector_table.select(*key, "embedding"), list(key), "left")


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The stored vector table, built and stored first where there is none.

    The last thing a build writes is a marker beside the table; a table without one never
    finished, whatever it holds, and is built anew.
    """
    marker = f"{path.rstrip('/')}.complete"
    try:
        spark.read.parquet(marker)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        build().write.mode("overwrite").parquet(path)
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(marker)
    return spark.read.parquet(path)


def distinct_contexts(hits: DataFrame, key: Sequence[str] = ("prompt_id",)) -> DataFrame:
    """Each context once per prompt, at the position of the first question that found it."""
    return hits.groupBy(*key, "text").agg(F.min("q_pos").alias("q_pos"))


def prompt_contexts(
    contexts: DataFrame, key: Sequence[str] = ("prompt_id",), limit: int = prompts.CONTEXTS_PER_PROMPT
) -> DataFrame:
    """The knowledge text of each prompt: its first contexts, numbered and joined."""
    kept = first_rows(contexts, key, ["q_pos", "text"], limit, name="rank")
    listed = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return (
        kept.groupBy(*key)
        .agg(listed.alias("_listed"))
        .select(*key, prompts.join_contexts(F.col("_listed")["text"], limit).alias("context"))
    )


def retrieve_contexts(
    questions: DataFrame, chunks: DataFrame, limit: int = prompts.CONTEXTS_PER_PROMPT
) -> DataFrame:
    """``prompt_id, context`` from question vectors and chunk vectors.

    ``questions`` holds ``prompt_id, q_pos, question_id, question, embedding``; ``chunks`` holds
    ``chunk_id, text, embedding``.
    """
    asked = with_question(questions)
    best = vectors.nearest(asked, chunks)
    hits = (
        asked.select("prompt_id", "q_pos", "question_id")
        .join(best, "question_id")
        .join(chunks.select("chunk_id", "text"), "chunk_id")
    )
    return prompt_contexts(distinct_contexts(hits), limit=limit)


def prompts_with_contexts(
    asked: DataFrame, questions: DataFrame, chunks: DataFrame, limit: int = prompts.CONTEXTS_PER_PROMPT
) -> DataFrame:
    """``asked`` (``prompt_id, prompt``) with the text that is sent, retrieved contexts filled in.

    ``questions`` and ``chunks`` are those of :func:`retrieve_contexts`. A prompt for which
    nothing was found is sent with an empty context, so no prompt is lost.
    """
    contexts = retrieve_contexts(questions, chunks, limit)
    filled = prompts.enhance_prompt(
        F.col("prompt"), F.lit("RAG"), F.coalesce("context", F.lit("")), cot_examples="", fsp_examples=""
    )
    return asked.join(contexts, "prompt_id", "left").select(*asked.columns, filled.alias("sent"))
