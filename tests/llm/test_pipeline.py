"""The pipeline's stages on a small corpus with a known answer."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, labels = [], []
    syllables = {"aa": ["lom", "tir", "sen", "ba"], "bb": ["gau", "ich", "zen", "kno"]}
    for i in range(240):
        lang = rng.choice(["aa", "bb"])
        text = " ".join("".join(rng.choices(syllables[lang], k=4)) + str(i) for _ in range(rng.randint(60, 120)))
        bad = i % 6 == 0
        rows.append((i, "%%% ".join(text.split()) if bad else text, lang, "s", 0))
        labels.append((i, int(not bad), 0))
    rows += [(1000 + i, rows[i][1] + " tail", rows[i][2], "s", 0) for i in range(1, 30)]
    rows += [(2000, "12 34 " * 60, "aa", "s", 0), (2001, None, None, None, None), (2002, "lom", "aa", "s", 0)]
    return rows, labels


def test_stages_keep_what_they_should(spark, tmp_path, corpus):
    rows, labels = corpus
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = {r[0] for r in rows}
    assert kept[0] == everything - {2000, 2001}
    bad = {r[0] for r in rows if r[1] and "%%%" in r[1]}
    assert kept[0] - kept[1] == bad | {2002}
    assert kept[2] == {i for i in kept[1] if i < 1000}
    assert kept[3] == kept[2]
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in result.collect()} == kept[3]


def test_stages_of_an_empty_corpus(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
