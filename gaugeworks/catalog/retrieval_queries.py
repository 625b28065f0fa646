"""Chunks, nearest chunks and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.catalog import views as V
from gaugeworks.catalog.registry import query, rounded
from gaugeworks.catalog.text_queries import _filled_sql
from gaugeworks.functions import prompts
from gaugeworks.operators import cells, retrieval, vectors
from gaugeworks.session import scratch_path

_CHUNKS_SQL = """
words AS (
  SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
starts AS (
  SELECT doc_id, w, unnest(range(0, greatest(len(w) - 20, 1), 380)) AS s FROM words WHERE len(w) > 0),
chunks AS (
  SELECT doc_id, CAST(s // 380 AS INTEGER) AS chunk_idx, array_to_string(w[s + 1:s + 400], ' ') AS text FROM starts)"""


def _chunks(spark, sf):
    return retrieval.chunk_documents(V.documents(spark, sf, "doc_id", "text"))


def _vector_table(spark, sf):
    """A vector for every chunk: vector (7 * doc_id + chunk_idx) modulo their number."""
    embeddings = V.table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = embeddings.count()
    chosen = F.expr(f"(doc_id * 7 + chunk_idx) % {max(n, 1)}").cast("bigint").alias("vec_id")
    return _chunks(spark, sf).select("doc_id", "chunk_idx", chosen).join(embeddings, "vec_id").drop("vec_id")


@query("rt01_chunks", V.with_sql(_CHUNKS_SQL) + "SELECT doc_id, chunk_idx, md5(text) AS text FROM chunks")
def rt01(spark, sf):
    return _chunks(spark, sf).withColumn("text", F.md5("text"))


_VECTOR_JOIN_SQL = """SELECT c.doc_id, c.chunk_idx, md5(c.text) AS text, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_value
  FROM chunks c JOIN embeddings e ON e.vec_id = (c.doc_id * 7 + c.chunk_idx) % (SELECT count(*) FROM embeddings)"""


def _first_value(rows):
    first = F.round(F.get("embedding", F.lit(0)).cast("double"), 6)
    return rows.select("doc_id", "chunk_idx", F.md5("text").alias("text"), first.alias("first_value"))


@query("rt02_vector_table", V.with_sql(_CHUNKS_SQL) + _VECTOR_JOIN_SQL)
def rt02(spark, sf):
    return _first_value(retrieval.with_vectors(_chunks(spark, sf), _vector_table(spark, sf)))


@query("s09_load_or_build", V.with_sql(_CHUNKS_SQL) + _VECTOR_JOIN_SQL)
def s09(spark, sf):
    path = scratch_path(spark, "vectors")

    def build():
        return retrieval.with_vectors(_chunks(spark, sf), _vector_table(spark, sf))

    retrieval.load_or_build(spark, path, build)

    def unexpected():
        raise AssertionError("the stored table was not found")

    return _first_value(retrieval.load_or_build(spark, path, unexpected))


# vectors of labels 0 to 4 are questions, the others are chunks
_NEAREST_SQL = """
questions AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label < 5),
candidates AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE label >= 5),
scored AS (
  SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, c.label, list_cosine_similarity(q.v, c.v) AS score
  FROM questions q CROSS JOIN candidates c),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) = 1)"""


def _questions(spark, sf):
    return (
        V.table(spark, sf, "embeddings")
        .filter("label < 5")
        .selectExpr(
            "vec_id AS question_id",
            "vec_id div 25 AS prompt_id",
            "cast(vec_id % 25 AS int) AS q_pos",
            "concat('question ', vec_id) AS question",
            "embedding",
        )
    )


def _candidates(spark, sf):
    rows = V.table(spark, sf, "embeddings").filter("label >= 5")
    return rows.selectExpr("vec_id AS chunk_id", "concat('context ', label) AS text", "embedding")


@query(
    "rt03_nearest_chunk",
    V.with_sql(_NEAREST_SQL) + "SELECT question_id, chunk_id, round(score, 6) AS score FROM best",
)
def rt03(spark, sf):
    return rounded(vectors.nearest(_questions(spark, sf), _candidates(spark, sf)), "score")


@query(
    "rt03_nearest_by_cells",
    V.with_sql(_NEAREST_SQL) + "SELECT question_id, chunk_id, round(score, 6) AS score FROM best",
)
def rt03_cells(spark, sf):
    index = cells.build(_candidates(spark, sf))
    return rounded(cells.nearest_by_cells(_questions(spark, sf), index), "score")


_CONTEXTS_SQL = """
contexts AS (
  SELECT question_id // 25 AS prompt_id, 'context ' || label AS text, CAST(min(question_id % 25) AS INTEGER) AS q_pos
  FROM best GROUP BY ALL)"""


@query("rt04_distinct_contexts", V.with_sql(_NEAREST_SQL, _CONTEXTS_SQL) + "SELECT * FROM contexts")
def rt04(spark, sf):
    asked, chunks = _questions(spark, sf), _candidates(spark, sf)
    hits = (
        vectors.nearest(asked, chunks)
        .join(asked.select("question_id", "prompt_id", "q_pos"), "question_id")
        .join(chunks.select("chunk_id", "text"), "chunk_id")
    )
    return retrieval.distinct_contexts(hits)


@query(
    "rt05_prompt_contexts",
    V.with_sql(_NEAREST_SQL, _CONTEXTS_SQL)
    + """SELECT prompt_id, string_agg('Context ' || (rank - 1) || ': ' || chr(10) || text, '' ORDER BY rank) AS context
         FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY q_pos) AS rank FROM contexts)
         WHERE rank <= 4 GROUP BY prompt_id""",
)
def rt05(spark, sf):
    return retrieval.retrieve_contexts(_questions(spark, sf), _candidates(spark, sf))


@query(
    "rt05_retrieved_prompts",
    V.with_sql(_NEAREST_SQL, _CONTEXTS_SQL)
    + f"""SELECT prompt_id, n_questions, md5({_filled_sql(prompts.CONTEXT_PROMPT, "coalesce(context, '')", "'prompt ' || prompt_id")}) AS sent
         FROM (SELECT vec_id // 25 AS prompt_id, CAST(count_if(label < 5) AS BIGINT) AS n_questions FROM embeddings GROUP BY ALL)
         LEFT JOIN (
           SELECT prompt_id, string_agg('Context ' || (rank - 1) || ': ' || chr(10) || text, '' ORDER BY rank) AS context
           FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY q_pos) AS rank FROM contexts)
           WHERE rank <= 4 GROUP BY prompt_id) USING (prompt_id)""",
)
def rt05_prompts(spark, sf):
    """Questions to nearest chunks, to contexts, to the prompt that is sent; prompts without questions too."""
    rows = V.table(spark, sf, "embeddings").selectExpr("vec_id div 25 AS prompt_id", "label")
    asked = rows.groupBy("prompt_id").agg(F.count_if(F.col("label") < 5).alias("n_questions"))
    asked = asked.withColumn("prompt", F.concat(F.lit("prompt "), "prompt_id"))
    sent = retrieval.prompts_with_contexts(asked, _questions(spark, sf), _candidates(spark, sf))
    return sent.select("prompt_id", "n_questions", F.md5("sent").alias("sent"))
