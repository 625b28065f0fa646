"""Tokenizer operators against the libraries and against exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugeworks.llm import bpe, packing, token_files
from gaugeworks.llm.elias_fano import EliasFano
from gaugeworks.session import checkpointed, scratch_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_JSON = public_tokenizers.path("byte_bpe_50k.json")
WORD_JSON = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n", "a  b\t\tc", "I'll don't", "----====", "ananas memem", "日本語 😀é", "x" * 5000, "<|endoftext|>", "\x00 a"]
SCHEMA = "doc_id long, text string, n_tokens long, ids string"


def random_texts(n):
    rng = random.Random(1)
    parts = list("aaabxyzI 019=-.*\n\t\xa0éß😀'") + ["'ll", "an", " the", "ANA", "  "]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in enumerate(texts)], SCHEMA)


def test_ids_equal_those_of_the_rank_library():
    codec = bpe.RankCodec(RANKS, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = ODD + random_texts(2000)
    ids, ends = codec.encode(texts)
    for own, text in zip(np.split(ids, ends[:-1]), texts):
        assert own.tolist() == other.encode_ordinary(text)
        assert codec.decode(own) == text.encode()


def test_words_are_forgotten_without_a_trace(monkeypatch):
    monkeypatch.setattr("gaugeworks.llm.words.CACHED_WORDS", 20)
    codec, fresh = (bpe.RankCodec(RANKS, public_tokenizers.PATTERN) for _ in range(2))
    for text in random_texts(300):
        assert codec.encode([text, "a b a b"])[0].tolist() == fresh.encode([text, "a b a b"])[0].tolist()


def test_offsets_and_split_characters(spark):
    docs = table(spark, [*ODD, None])
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in encoded.collect()}
    assert rows[len(ODD)].ids == []
    for i, text in enumerate(ODD):
        assert all(0 <= a < b <= len(text) for a, b in zip(rows[i]["first"], rows[i]["last"]))
        if text.isascii():
            assert "".join(text[a:b] for a, b in zip(rows[i]["first"], rows[i]["last"])) == text
    decoded = {r.doc_id: r for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(bytes(decoded[i].content).decode() == t == "".join(decoded[i].pieces) for i, t in enumerate(ODD))
    emoji = decoded[7]
    assert len(rows[7].ids) > len(ODD[7].split()) and "" in emoji.pieces


def test_byte_that_is_no_character_is_replaced():
    codec = bpe.RankCodec(RANKS, public_tokenizers.PATTERN)
    assert codec.decode_pieces([codec.ranks[b"\xff"]]) == ["�"]


def test_digests_of_nulls_and_empty_tables(spark):
    rows = bpe.round_trip(table(spark, [None, "", None]), RANKS, public_tokenizers.PATTERN).collect()
    assert len({r.ids_sha256 for r in rows}) == 1 and {r.n_tokens for r in rows} == {0}
    assert bpe.round_trip(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("numbers", [[], [0], [5, 5, 5], [-3, 0, 2**40], list(range(0, 3000, 7)), [0] * 700 + [10**9]])
def test_elias_fano_gives_back_each_number(numbers):
    packed, at = EliasFano.read(b"xx" + EliasFano.of(np.array(numbers, np.int64)).to_bytes(), 2)
    assert packed.all().tolist() == numbers
    assert [packed.select(i) for i in range(len(numbers))] == numbers
    with pytest.raises(IndexError):
        packed.select(len(numbers))


def test_elias_fano_is_small():
    numbers = np.cumsum(np.random.default_rng(0).integers(0, 1000, 100_000))
    assert len(EliasFano.of(numbers).to_bytes()) < 1.6 * len(numbers)


def test_token_files_hold_what_the_library_encodes(spark):
    texts = ODD + [None] + random_texts(200)
    docs = table(spark, texts).unionByName(table(spark, texts[:3])).repartition(3)
    tokenizer = Tokenizer.from_file(BYTE_JSON)
    tokenizer.encode_special_tokens = True
    rows = token_files.encode_and_read(docs, BYTE_JSON).orderBy("start").collect()
    assert len(rows) == len(texts) + 3
    start = 0
    for row in rows:
        ids = tokenizer.encode(texts[row.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_token_files_without_keys_and_without_rows(spark):
    docs = spark.createDataFrame([(None, "b"), (4, "a"), (None, "a")], "doc_id long, text string")
    rows = token_files.encode_and_read(docs, BYTE_JSON).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 4]
    assert token_files.encode_and_read(docs.limit(0), BYTE_JSON).count() == 0


def test_files_are_bounded_by_ids(spark):
    texts = ["a b c d " * 50, "one", "two", "x y " * 500, "", None, "end " * 60]
    folder = scratch_path(spark, "test-tokens-ids")
    files = token_files.write_encoded(table(spark, texts), folder, BYTE_JSON, 0, ids_per_file=300).collect()
    assert sum(f.n_docs for f in files) == len(texts)
    assert all(f.n_tokens <= 300 or f.n_docs == 1 for f in files) and 3 <= len(files) < len(texts)


def test_many_files_and_single_documents(spark):
    texts = random_texts(100)
    folder = scratch_path(spark, "test-tokens")
    files = token_files.write_encoded(table(spark, texts), folder, BYTE_JSON, 0, docs_per_file=7).collect()
    assert sum(f.n_docs for f in files) == 100 and max(f.n_docs for f in files) <= 7
    codec, _ = token_files._byte_words(BYTE_JSON)
    for f in files:
        with open(f"{folder.removeprefix('file://')}/{f.file}", "rb") as content:
            file = token_files.TokenFile(content.read())
        for n in range(len(file)):
            key, ids = file.document(n)
            assert ids.tolist() == codec.encode([texts[key]])[0].tolist() + [0]


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_scan_stitches_documents_over_blocks(spark, block):
    texts = ["", "one", *random_texts(20), None, "last " * 50]
    folder = scratch_path(spark, "test-flat")
    order = token_files.write_flat(table(spark, texts).repartition(2), folder, BYTE_JSON, 50256).collect()
    found = token_files.scan_flat(spark, folder, 50256, 2, block).collect()
    lengths = {(r.file, r.place): r.n_tokens for r in found}
    tokenizer = Tokenizer.from_file(BYTE_JSON)
    assert len(found) == len(texts)
    for r in order:
        assert lengths[r.file, r.place] == len(tokenizer.encode(texts[r.doc_id] or "").ids)


def test_scan_counts_an_open_document(spark):
    folder = scratch_path(spark, "test-open")
    token_files._store(folder, "flat-1", [np.array([9, 9, 1, 9], "<u2").tobytes()])
    token_files._store(folder, "flat-2", [np.array([9, 9, 9], "<u2").tobytes()])
    rows = token_files.scan_flat(spark, folder, 1, 2, 2).orderBy("file", "place").collect()
    assert [(r.start, r.n_tokens) for r in rows] == [(0, 2), (3, 1), (0, 3)]


def test_count_tokens_of_nothing(spark):
    assert token_files.count_tokens(table(spark, []), BYTE_JSON, 50256).count() == 0


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(WORD_JSON)
    by_doc, by_sequence, total = {}, {}, 0
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for key, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        got = sorted(by_doc[key], key=lambda r: r.piece)
        want = [(n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048])) for n, s in enumerate(range(0, len(ids), 2048))]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == want
    for members in by_sequence.values():
        members.sort(key=lambda r: r.offset)
        assert [m.offset for m in members] == np.cumsum([0, *(m.length for m in members)])[:-1].tolist()
        assert sum(m.length for m in members) <= 2048
    return len(by_sequence), -(-total // 2048)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choices(["the", "Of", "tion!", "ünd"], k=rng.randint(0, 1500))) for i in range(300)}
    texts |= {300: None, 301: "", 302: "a " * 7000}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, length string")
    found, least = check_packing(packing.pack_documents(docs, WORD_JSON).collect(), texts)
    assert found <= 1.02 * least + 1
    assert packing.pack_documents(docs.limit(0), WORD_JSON).count() == 0


def test_packing_takes_repeated_rows_and_missing_keys(spark):
    docs = spark.createDataFrame([(None, "a b")] * 3 + [(1, "c")] * 2, "doc_id long, text string")
    rows = packing.pack_documents(docs, WORD_JSON).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 2)] * 2 + [(True, 3)] * 3
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5


def bins_are_valid(bins, sizes, capacity):
    assert sorted(p for b in bins for p in b) == list(range(len(sizes)))
    assert all(sum(sizes[p] for p in b) <= capacity for b in bins)


def test_genetic_steps_keep_every_piece_once():
    rng = np.random.default_rng(0)
    sizes = sorted(rng.integers(200, 600, 120).tolist(), reverse=True)
    start = packing.Bins(sizes, 1000).best_fit(list(range(len(sizes))))
    other = packing.mutate(start, sizes, 1000, rng)
    child = packing.crossover(start, other, sizes, 1000, rng)
    for bins in (start, other, child):
        bins_are_valid(bins, sizes, 1000)


def test_evolution_never_loses_to_its_start():
    sizes = [60, 60, 60, 40, 40, 40, 50, 50, 35, 35, 30, 30, 30, 40] * 6
    greedy = packing.Bins(sizes, 100).best_fit(list(range(len(sizes))))
    bad = [[p] for p in range(len(sizes))]
    best = packing.evolve(sizes, [bad, greedy], 100, 10, seed=1)
    bins_are_valid(best, sizes, 100)
    assert len(best) <= len(greedy)


def triplets(bins, capacity, seed):
    """Sizes of which always three fill a bin, which best fit seldom finds."""
    rng = random.Random(seed)
    sizes = []
    for _ in range(bins):
        a = rng.randint(capacity * 38 // 100, capacity * 49 // 100)
        b = rng.randint(capacity // 4, (capacity - a) // 2)
        sizes += [a, b, capacity - a - b]
    return sorted(sizes, reverse=True)


@pytest.mark.parametrize("seed", range(4))
def test_evolution_beats_best_fit(seed):
    sizes = triplets(40, 1000, seed)
    greedy = packing.Bins(sizes, 1000).best_fit(list(range(len(sizes))))
    best = packing.evolve(sizes, [], 1000, packing.GENERATIONS, seed)
    bins_are_valid(best, sizes, 1000)
    assert 40 <= len(best) < len(greedy)
    assert packing.evolve(sizes, [], 1000, 0, seed) == greedy


def test_islands_beat_best_fit(spark):
    sizes = triplets(40, 1000, 9)
    greedy = packing.Bins(sizes, 1000).best_fit(list(range(len(sizes))))
    rows = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "doc_id long, piece int, length long")
    found = packing.pack(checkpointed(rows, "test-pieces"), 1000).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(found) < len(greedy) and max(r.n for r in found) <= 1000


def test_swaps_fill_bins():
    sizes = [70, 60, 40, 30]
    assert sorted(map(sorted, packing.swap_in([[1, 3]], [0, 2], sizes, 100))) == [[0, 3], [1, 2]]


def test_pieces_longer_than_a_sequence_are_refused(spark):
    parts = spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long")
    with pytest.raises(Exception, match="longer than 8"):
        packing.pack(parts, capacity=8).collect()
