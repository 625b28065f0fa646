"""Jaccard join, components and spot signatures against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import components, jaccard, shingles, spotsigs
from gaugeworks.llm.order import id_range


def word_sets(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(texts, width, percent):
    sets = [word_sets(t, width) for t in texts]
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    return sets, roots(len(texts), links)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 or not texts:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 12, 18, 20, 21, 22, 25, 40, 90, 300]))))
        else:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
            texts.append(" ".join(words) or "x")
    return texts


def test_shingles_are_those_of_the_words():
    rng = random.Random(3)
    parts = ["a", "B", "b", "é", " ", "\n", "\t", "\x1f", "\xa0", "longer", "ß "]
    texts = ["", " ", "One", "one two"] + ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)]
    for width in (1, 3, 5):
        hashes, sizes = shingles.shingle_sets(texts, width)
        names = {}
        for own, text in zip(np.split(hashes, np.cumsum(sizes)[:-1]), texts):
            want = word_sets(text, width)
            assert len(own) == len(want) and (np.diff(own.astype(object)) > 0).all()
            for h in own.tolist():
                names.setdefault(h, set()).add(text)
        by_set = collections.defaultdict(set)
        for own, text in zip(np.split(hashes, np.cumsum(sizes)[:-1]), texts):
            by_set[tuple(own.tolist())].add(word_sets(text, width))
        assert all(len(s) == 1 for s in by_set.values())
    assert shingles.shingle_sets([], 3)[0].size == 0


def test_light_sets_share_a_key_when_they_are_alike():
    rng = np.random.default_rng(0)
    universe = shingles.mixed(np.arange(1, 400, dtype=np.uint64))
    for percent in (80, 90):
        for _ in range(400):
            a = rng.choice(universe, rng.integers(1, jaccard.MAX_LIGHT + 1), replace=False)
            keep = a[rng.random(len(a)) > 0.08]
            b = np.unique(np.concatenate((keep, rng.choice(universe, rng.integers(0, 3)))))[: jaccard.MAX_LIGHT]
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= percent * (len(a) + len(b) - common):
                keys = [set(jaccard.subset_keys(x, percent, jaccard.MAX_LIGHT)) for x in (a, b)]
                assert keys[0] & keys[1]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 85)])
def test_components_equal_brute_force(spark, seed, width, percent):
    texts = corpus(seed) + [None, "", " \t", "W1 w2", "w1 W2"]
    docs = spark.createDataFrame([(i, t, 5, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int, node string")
    found = {r.doc_id: r for r in jaccard.similar_components(docs, width, percent).collect()}
    sets, want = brute(texts, width, percent)
    assert len(set(want)) < len(want)
    for i in range(len(texts)):
        assert (found[i].n_shingles, found[i].component_id) == (len(sets[i]), want[i])


@pytest.mark.parametrize("boundary", [0, 10, 19])
def test_any_boundary_gives_the_same_components(spark, monkeypatch, boundary):
    monkeypatch.setattr(jaccard, "light_boundary", lambda nodes: boundary)
    texts = corpus(7, 120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.similar_components(docs).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, 3, 90)[1]


def long_corpus(seed):
    """Texts of up to some thousand words, whose copies differ by a little more or less than a tenth."""
    rng = random.Random(seed)
    texts = []
    for n in (450, 700, 1100, 2600):
        base = [f"v{rng.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(base))
        for share in (0.005, 0.015, 0.017, 0.019, 0.03, 0.2):
            words = list(base)
            for _ in range(int(n * share)):
                words[rng.randrange(len(words))] = f"u{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        texts.append(" ".join(base[: int(n * 0.92)]))
    return texts


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_long_texts_equal_brute_force(spark, width, percent):
    texts = long_corpus(width)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.similar_components(docs, width, percent).collect()}
    want = brute(texts, width, percent)[1]
    assert [found[i] for i in range(len(texts))] == want and 4 < len(set(want)) < len(texts)


def test_sketches_never_differ_by_more_than_the_sets(spark):
    rng = np.random.default_rng(1)
    universe = shingles.mixed(np.arange(1, 60_000, dtype=np.uint64))
    sets = [rng.choice(universe, n, replace=False) for n in (0, 1, 500, 513, 2000, 9000)]
    sets += [np.concatenate((s[: int(len(s) * 0.8)], rng.choice(universe, 7))) for s in sets]
    sets = [np.unique(s) for s in sets]
    sizes = np.array([len(s) for s in sets])
    column = jaccard.sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes).to_pylist()
    assert all(64 * len(c) >= n for c, n in zip(column, sizes)) and len({len(c) for c in column}) > 3
    rows = spark.createDataFrame([(i, int(n), c) for i, (n, c) in enumerate(zip(sizes, column))], "node int, size int, sketch array<long>")
    pairs = rows.alias("x").join(rows.alias("y"), F.col("x.node") < F.col("y.node"))
    for percent in (50, 80, 90):
        kept = pairs.where(jaccard._unrefuted("x", "y", percent, True)).select("x.node", "y.node").collect()
        alike = {
            (i, j)
            for j in range(len(sets))
            for i in range(j)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))
        }
        assert alike <= {tuple(r) for r in kept}
        large = [(a, b) for a, b in kept if percent >= 80 and min(sizes[a], sizes[b]) > 100 and 100 * min(sizes[a], sizes[b]) >= percent * max(sizes[a], sizes[b])]
        assert all(len(np.intersect1d(sets[a], sets[b])) * 100 >= (percent - 25) * len(np.union1d(sets[a], sets[b])) for a, b in large)


def test_repeated_rows_missing_keys_and_nothing(spark):
    long = " ".join(f"x{i}" for i in range(50))
    rows = [(5, long), (5, long), (None, long), (9, long + " y"), (None, "alone"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.similar_components(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id) == [(5, 5), (5, 5), (7, 7), (9, 5)]
    assert sorted(str(r.component_id) for r in found if r.doc_id is None) == ["5", "None"]
    assert jaccard.similar_components(docs.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    texts = corpus(5, 80)
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(0, texts[0], "en"), (500, None, "de"), (501, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = jaccard.keep_one(docs, 3, 90)
    want = brute(texts, 3, 90)[1]
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) + [500, 501]


def test_missing_and_repeated_ids_lose_no_group(spark):
    words = {name: " ".join(f"{name}{i}" for i in range(60)) for name in "abcde"}
    a, b, c, d, e = words.values()
    # 5 has two texts, one of them not the lowest of its group; a NULL links with 9, another with nothing
    rows = [(5, a), (7, a + " x"), (5, b), (3, b + " x"), (9, c), (None, c + " x"), (None, d), (None, None)]
    # of one doc_id's like texts one stays, also where only white space differs
    rows += [(11, e), (11, e + " x"), (11, e.replace(" ", "  ")), (12, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in jaccard.keep_one(docs, 3, 90).collect()]
    assert sorted((k, t) for k, t in kept if k in (3, 5, 7, 9)) == [(3, b + " x"), (5, a), (9, c)]
    assert sorted((str(t) for k, t in kept if k is None)) == sorted([str(None), d])
    assert [k for k, _ in kept if k in (11, 12)] == [11]


def test_groups_without_ids_keep_one(spark):
    a, b = (" ".join(f"{name}{i}" for i in range(60)) for name in "ab")
    rows = [(None, a), (None, a), (None, a + " x"), (None, b), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.text for r in jaccard.keep_one(docs, 3, 90).collect())
    assert kept[:2] == ["", ""] and len(kept) == 4 and kept[3] == b and kept[2] in (a, a + " x")


def test_connected_components(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    extra = [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    links = spark.createDataFrame(chain + star + extra + chain[:5], "a long, b long")
    found = {r.node: r.component for r in components.connected(links).collect()}
    want = roots(400, chain + star + extra)
    ends = {x for a, b in chain + star + extra if a != b for x in (a, b)}
    assert found == {x: want[x] for x in ends}
    assert components.connected(links.limit(0)).count() == 0


def signature_set(text):
    words = re.findall(r"[^\W_]+", text.lower())
    anchors, found = set(spotsigs.ANCHORS), set()
    for i, word in enumerate(words):
        if word in anchors:
            content = [w for w in words[i + 1 :] if w not in anchors][:2]
            if len(content) == 2:
                found.add((word, *content))
    return found or ({tuple(words)} if words else set())


def alike(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def anchored(rng, n):
    return " ".join(rng.choices(["the", "of", "und", "La", "cat,", "dog", "Haus", "über", "x1", "the the"], k=n))


def test_edits_are_compared_as_by_hand(spark):
    rng = random.Random(8)
    texts = [anchored(rng, rng.randint(0, 80)) for _ in range(60)] + [None, "", "no anchor here", "de " * 3000 + "a b c", "ключ 😀 the мир и"]
    docs = spark.createDataFrame([(3 * i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, sigs string")
    found = spotsigs.compare_with_edits(docs, range_rows=7).orderBy("doc_id").collect()
    texts = [t or "" for t in texts]
    prints = {}
    assert len(found) == len(texts)
    for i, (text, row) in enumerate(zip(texts, found)):
        following = texts[(i + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own = signature_set(text)
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == pytest.approx(alike(own, signature_set(edited)))
        assert row.near_next == pytest.approx(alike(own, signature_set(following)))
        for key, sigs in ((row.fingerprint, own), (row.edited_fingerprint, signature_set(edited))):
            assert prints.setdefault(key, sigs) == sigs
    assert len(prints) == len({frozenset(s) for s in prints.values()})


def test_edits_of_few_and_repeated_rows(spark):
    one = spark.createDataFrame([(None, "the cat dog")], "doc_id long, text string")
    row = spotsigs.compare_with_edits(one).first()
    assert row.near_next == 1.0 and row.n_chars == 11
    twice = spotsigs.compare_with_edits(one.unionByName(one)).collect()
    assert len(twice) == 2 and {r.near_next for r in twice} == {1.0}
    assert spotsigs.compare_with_edits(one.limit(0)).count() == 0


def test_likeness_is_pruned_by_length(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4], [1])], "a array<long>, b array<long>")
    exact, pruned = rows.select(spotsigs.likeness(F.col("a"), F.col("b")), spotsigs.likeness(F.col("a"), F.col("b"), 0.5)).first()
    assert exact == 0.25 and pruned is None


def test_near_duplicate_classes(spark):
    rng = random.Random(9)
    base = [anchored(rng, 60) + f" the k{i} v{i}" for i in range(25)]
    texts = base + [t + " the end now" for t in base[:10]] + base[:3] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in spotsigs.near_duplicate_classes(docs).collect()}
    sets = [signature_set(t or "") for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and alike(sets[i], sets[j]) >= 0.8]
    assert [found[i] for i in range(len(texts))] == roots(len(texts), links)


def test_anchors_before_anchors_open_signatures(spark):
    rows = spark.createDataFrame([("of the cat sat",), ("the of dog on the mat the",), ("the of",)], "text string")
    found = [len(r[0]) for r in rows.select(spotsigs.signatures(F.col("text"))).collect()]
    assert found == [2, 2, 1]  # the last text is one signature as a whole


def test_a_far_id_leaves_ranges_even(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id").unionByName(spark.createDataFrame([(2**61,), (-(2**62),)], "doc_id long"))
    sizes = [r["count"] for r in docs.groupBy(id_range(docs, 100).alias("r")).count().collect()]
    assert len(sizes) >= 150 and max(sizes) <= 400


def test_ranges_beyond_the_quantiles_ascend(spark):
    docs = spark.range(0, 60_000, 3).withColumnRenamed("id", "doc_id")
    rows = docs.select("doc_id", id_range(docs, 4).alias("r")).orderBy("doc_id").collect()
    assert [r.r for r in rows] == sorted(r.r for r in rows) and len({r.r for r in rows}) > 4_000


def test_repeated_ids_share_a_range(spark):
    docs = spark.createDataFrame([(7,)] * 50 + [(8,)] * 3, "doc_id long")
    rows = {tuple(r) for r in docs.select("doc_id", id_range(docs, 2)).collect()}
    assert len(rows) == 2 and sorted(rows)[0][1] <= sorted(rows)[1][1]


def test_id_ranges_ascend(spark):
    ids = [None, -(2**62), 5, 6, 7, 2**62]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = docs.select("doc_id", id_range(docs, 2).alias("r")).orderBy("doc_id").collect()
    assert [r.r for r in rows] == sorted(r.r for r in rows) and rows[0].r == -1
