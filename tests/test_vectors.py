import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import cells, retrieval, vectors


def _rows(spark, matrix, names):
    return spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, matrix)], "id long, embedding array<float>")


def _unit(matrix):
    matrix = matrix.astype(np.float32).astype(np.float64)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


@pytest.mark.parametrize("per_block", [1000, 7])
def test_nearest_is_exact_however_vectors_are_packed(spark, per_block):
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(40, 8)), rng.normal(size=(300, 8))
    c[200] = c[7]  # a tie: the lower id must win
    q[0] = c[7]
    questions = _rows(spark, q, range(40)).withColumnRenamed("id", "question_id").repartition(3)
    chunks = _rows(spark, c, range(300)).withColumnRenamed("id", "chunk_id").repartition(5)
    got = {r["question_id"]: r for r in vectors.nearest(questions, chunks, per_block=per_block).collect()}
    similarity = _unit(q) @ _unit(c).T
    assert len(got) == 40 and got[0]["chunk_id"] == 7
    for i in range(40):
        assert got[i]["chunk_id"] == similarity[i].argmax()
        assert got[i]["score"] == pytest.approx(similarity[i].max())


@pytest.mark.parametrize("per_block", [1000, 3])
def test_soft_match_is_exact_however_tokens_are_packed(spark, per_block):
    rng = np.random.default_rng(2)
    pairs = {p: (rng.normal(size=(1 + p * 5, 6)), rng.normal(size=(2 + p * 3, 6))) for p in range(5)}
    rows = [
        (p, side, i, [float(x) for x in v])
        for p, sides in pairs.items()
        for side, matrix in zip(("candidate", "reference"), sides)
        for i, v in enumerate(matrix)
    ]
    tokens = spark.createDataFrame(rows, "pair long, side string, token_idx long, embedding array<float>")
    got = {r["pair"]: r for r in vectors.soft_match(tokens, ["pair"], per_block).collect()}
    for p, (c, r) in pairs.items():
        s = _unit(c) @ _unit(r).T
        precision, recall = s.max(axis=1).mean(), s.max(axis=0).mean()
        assert got[p]["precision"] == pytest.approx(precision)
        assert got[p]["recall"] == pytest.approx(recall)
        assert got[p]["f3"] == pytest.approx(10 * precision * recall / (9 * precision + recall))


def test_soft_match_of_equal_texts_is_one(spark):
    rows = [(1, side, i, [1.0 + i, 2.0, -1.0 * i]) for side in ("candidate", "reference") for i in range(4)]
    tokens = spark.createDataFrame(rows, "pair long, side string, token_idx long, embedding array<double>")
    assert vectors.soft_match(tokens, ["pair"]).first()["f1"] == pytest.approx(1)


def test_chunk_ranges(spark):
    lengths = {10: [(0, 10)], 400: [(0, 400)], 401: [(0, 400), (380, 401)], 781: [(0, 400), (380, 780), (760, 781)], 0: []}
    rows = spark.createDataFrame([(n, " ".join(map(str, range(n)))) for n in lengths], "doc_id long, text string")
    got = {n: [] for n in lengths}
    for r in retrieval.chunk_documents(rows).orderBy("doc_id", "chunk_idx").collect():
        words = r["text"].split(" ")
        got[r["doc_id"]].append((int(words[0]), int(words[-1]) + 1))
    assert got == lengths


def test_contexts(spark):
    hits = spark.createDataFrame([(1, 3, "b"), (1, 0, "a"), (1, 1, "a"), (2, 0, "z")], "prompt_id long, q_pos int, text string")
    contexts = retrieval.distinct_contexts(hits)
    assert contexts.count() == 3
    got = {r["prompt_id"]: r["context"] for r in retrieval.prompt_contexts(contexts, limit=1).collect()}
    assert got == {1: "Context 0: \na", 2: "Context 0: \nz"}
    full = retrieval.prompt_contexts(contexts).filter(F.col("prompt_id") == 1).first()["context"]
    assert full == "Context 0: \naContext 1: \nb"


def test_empty_sides_score_nothing(spark):
    rows = [(1, "candidate", 0, [1.0, 0.0]), (1, "reference", 0, [1.0, 0.0]), (2, "reference", 0, [1.0, 0.0]), (3, "candidate", 0, None)]
    tokens = spark.createDataFrame(rows, "pair long, side string, token_idx int, embedding array<double>")
    got = {r["pair"]: (r["precision"], r["recall"], r["f1"]) for r in vectors.soft_match(tokens, ["pair"]).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 0, 0), 3: (0, 0, 0)}


def test_widths_must_agree(spark):
    questions = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, embedding array<double>")
    chunks = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "chunk_id long, embedding array<double>")
    with pytest.raises(Exception, match="different widths"):
        vectors.nearest(questions, chunks).collect()


def test_unfinished_tables_are_built_again(spark, tmp_path):
    path = str(tmp_path / "index")
    spark.range(3).write.parquet(path)
    assert retrieval.load_or_build(spark, path, lambda: spark.range(10)).count() == 10
    assert retrieval.load_or_build(spark, path, lambda: spark.range(99)).count() == 10


def _clustered(rng, n, around):
    return around[rng.integers(0, len(around), n)] + 0.05 * rng.normal(size=(n, around.shape[1]))


def test_cells_are_exact_and_rule_out_most_pairs(spark):
    rng = np.random.default_rng(7)
    around = rng.normal(size=(40, 16))
    q, c = _clustered(rng, 200, around), _clustered(rng, 3000, around)
    c[2000] = c[5]  # a tie in one cell
    q[0], q[1] = c[5], -c[5]
    questions = _rows(spark, q, range(200)).withColumnRenamed("id", "question_id").repartition(3)
    chunks = _rows(spark, c, range(3000)).withColumnRenamed("id", "chunk_id").repartition(5)
    index = cells.build(chunks)
    got = {r["question_id"]: r for r in cells.nearest_by_cells(questions, index).collect()}
    similarity = _unit(q) @ _unit(c).T
    assert len(got) == 200
    for i in range(200):
        assert got[i]["chunk_id"] == similarity[i].argmax()
        assert got[i]["score"] == pytest.approx(similarity[i].max())
    own = cells.own_cells(questions, index, "question_id", "embedding")
    first = questions.join(vectors.best_of(vectors.searched(own, index.blocks, "_cell", "question_id", "chunk_id", questions), "question_id", "chunk_id"), "question_id")
    visits = own.unionByName(cells.other_cells(first, index, "question_id", "embedding"))
    compared = sum(len(r["_q_ids"]) * int(index.counts[r["_cell"]]) for r in visits.collect())
    assert index.counts.sum() == 3000 and compared < 200 * 3000 / 5


@pytest.mark.parametrize("n_cells", [1, 3, 500])
def test_cells_with_zero_vectors_ties_and_any_number(spark, n_cells):
    rng = np.random.default_rng(n_cells)
    q, c = rng.normal(size=(30, 4)), rng.normal(size=(60, 4))
    q[3], c[10], c[20] = 0, 0, 0
    c[30:40] = c[0]
    questions = _rows(spark, q, range(30)).withColumnRenamed("id", "question_id")
    chunks = _rows(spark, c, range(60)).withColumnRenamed("id", "chunk_id")
    index = cells.build(chunks, cells=n_cells)
    got = {r["question_id"]: (r["chunk_id"], round(r["score"], 9)) for r in cells.nearest_by_cells(questions, index).collect()}
    want = {r["question_id"]: (r["chunk_id"], round(r["score"], 9)) for r in vectors.nearest(questions, chunks).collect()}
    assert got == want and len(got) == 30
    assert cells.build(chunks.limit(0)) is None


def test_a_question_returns_one_row_a_task(spark):
    rng = np.random.default_rng(3)
    questions = _rows(spark, rng.normal(size=(256, 4)), range(256)).withColumnRenamed("id", "question_id")
    chunks = _rows(spark, rng.normal(size=(2000, 4)), range(2000)).withColumnRenamed("id", "chunk_id")
    asked = vectors._packed(questions, "question_id", "embedding", 16, "_q").withColumn("_cell", F.lit(0))
    offered = vectors._packed(chunks, "chunk_id", "embedding", 16, "_c").withColumn("_cell", F.lit(0))
    for joined in (F.broadcast(asked), asked):
        found = vectors.searched(joined, offered, "_cell", "question_id", "chunk_id", questions)
        assert found.count() <= 256 * found.rdd.getNumPartitions()


def test_cell_widths_must_agree(spark):
    index = cells.build(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "chunk_id long, embedding array<double>"))
    questions = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, embedding array<double>")
    with pytest.raises(Exception, match="different widths"):
        cells.nearest_by_cells(questions, index).collect()


def test_a_question_is_written_once_a_column_of_cells(spark):
    rng = np.random.default_rng(5)
    questions = _rows(spark, rng.normal(size=(50, 8)), range(50)).withColumnRenamed("id", "question_id")
    chunks = _rows(spark, rng.normal(size=(900, 8)), range(900)).withColumnRenamed("id", "chunk_id")
    index = cells.build(chunks, cells=30)
    first = questions.withColumn("score", F.lit(0.2))
    visits = {(q, r._cell) for r in cells.other_cells(first, index, "question_id", "embedding").collect() for q in r._q_ids}
    dealt = cells.dealt_questions(first, index, "question_id", "embedding", 3).collect()
    written = [q for r in dealt for q in r._q_ids]
    assert len(written) <= 50 * 3 < len(visits)
    bits = lambda mask, n: np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=n))
    found = [(r._q_ids[i], c) for r in dealt for c, m in zip(r._q_cells, r._q_masks) for i in bits(m, len(r._q_ids))]
    assert set(found) == visits and len(found) == len(visits)
