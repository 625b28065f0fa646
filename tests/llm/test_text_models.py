"""Language identification, quality rules and the language model against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from gaugeworks.llm import language, neural_lm, quality

LANGS = {"aa": ["lom", "tir", "the", "ba", "sen"], "bb": ["über", "gau", "ich", "zen", "kno"], "cc": ["ção", "lhe", "mos", "qui"]}


def sentence(lang, n, rng):
    return " ".join("".join(rng.choices(LANGS[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return [(lang, sentence(lang, rng.randint(3, 120), rng)) for _ in range(60) for lang in LANGS]


def longest_phrases(text, train):
    """Phrases of the greedy cut, by search in the training text."""
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in train:
            size += 1
        # the letter that cannot continue a phrase begins the next one
        at += max(size - 1, 1)
        count += 1
    return count


def test_phrases_are_longest_matches(texts):
    train = {k: language.letters_only(" ".join(t for lang, t in texts[:90] if lang == k)) for k in LANGS}
    parser = language.Parser(language.Model(tuple(train), tuple(train.values())))
    some = [t for _, t in texts[90:]] + ["", "12 34", "xyzq" * 700, "Ä ß 99"]
    phrases, sizes, has_letter = parser.phrases(some)
    assert has_letter.tolist() == [bool(re.search(r"[^\W\d_]", t)) for t in some]
    for n, text in enumerate(some):
        symbols, _ = parser.symbols([text])
        spelt = "".join(map(chr, symbols))
        for k, lang in enumerate(train):
            known = "".join(map(chr, parser.symbols([train[lang]])[0]))
            want = sum(longest_phrases(spelt[a : a + 1024], known) for a in range(0, len(spelt), 1024))
            assert phrases[k, n] == want


def test_languages_are_told_apart(spark, texts):
    rows = [(i, t, lang, "clash") for i, (lang, t) in enumerate(texts)]
    rows += [(900, None, "aa", ""), (901, "  1 2", None, ""), (None, "lomtir the", None, ""), (0, texts[0][1], "aa", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    held = language.held_out()
    model = language.fit(docs.where(~held))
    assert set(model.languages) == set(LANGS)
    found = docs.select("doc_id", "lang", held.alias("held"), language.predict(docs.text, model).alias("of")).collect()
    right = [r.of.lang_pred == r.lang for r in found if r.held and r.lang and r.doc_id != 900]
    assert len(right) > 20 and np.mean(right) > 0.97
    by_id = {r.doc_id: r.of for r in found}
    assert by_id[900].lang_pred == by_id[901].lang_pred == "und" and by_id[901].score == 0
    assert all(0 <= r.of.score <= 1 for r in found)
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2


def test_packed_steps_are_those_of_the_automaton():
    rng = random.Random(8)
    for letters, n in ((2, 60), (30, 3000), (4000, 5000), (1, 1), (1, 0)):
        steps = language.suffix_automaton([rng.randrange(letters) for _ in range(n)])
        place, owner, target = language.packed(steps)
        assert (owner >= 0).sum() == sum(map(len, steps))
        for state, step in enumerate(steps):
            for symbol, after in step.items():
                assert owner[place[state] + symbol] == state and target[place[state] + symbol] == after


def test_shares_are_equal_and_whole():
    for sizes in ([], [3], [0, 9, 9], [50, 1, 50, 7], [2, 2]):
        for letters in (0, 4, 30, 200):
            got = [len(t) for t in language.equal_shares(["x" * n for n in sizes], letters)]
            assert sum(got) <= letters and all(a <= b for a, b in zip(got, sizes))
            assert sum(got) == min(letters, sum(sizes)) or letters - sum(got) < len(sizes)
            cut = [a for a, b in zip(got, sizes) if a < b]
            assert not cut or max(got) - min(cut) <= 1


def test_every_language_and_letter_is_learned(spark):
    """80 languages of letters of their own, and two that share 3,000 letters but not their order."""
    rng = random.Random(9)
    own = {f"l{k:02}": [chr(0x4E00 + 40 * k + i) for i in range(40)] for k in range(80)}
    rows = [(f"l{k:02}", "".join(rng.choices(own[f"l{k:02}"], k=30))) for k in range(80) for _ in range(3)]
    wide = [chr(0xAC00 + i) for i in range(3000)]
    pairs = {lang: rng.sample(wide, 3000) for lang in ("ma", "mb")}
    for lang, order in pairs.items():
        for _ in range(30):
            at = rng.randrange(2900)
            rows.append((lang, "".join(order[at : at + 100])))
    rows.append(("long", "q" * 700_000))
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert set(model.languages) == {lang for lang, _ in rows} and model.languages[:2] == ("ma", "mb")
    assert all(len(text) <= language.TRAIN_LETTERS for text in model.texts)
    found = docs.select("lang", language.predict(docs.text, model).alias("of")).collect()
    assert all(r.of.lang_pred == r.lang for r in found)
    assert language.keep_known(docs, model).count() == len(rows)


def test_equal_costs_go_to_the_language_with_more_rows(spark):
    rows = [("b", "abab"), ("a", "abab"), ("b", "baba"), ("a", "baba"), ("c", "abab"), ("c", "baba"), ("c", "abab")]
    docs = spark.createDataFrame([(None, t, lang) for lang, t in rows], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ("c", "a", "b")
    assert {r.o.lang_pred for r in docs.select(language.predict(docs.text, model).alias("o")).collect()} == {"c"}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == () and docs.select(language.predict(docs.text, model).alias("o")).first().o.lang_pred == "und"
    assert docs.limit(0).select(language.predict(docs.text, model)).count() == 0


def count_words(text):
    """The counts of the contract, by definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside)


def test_counts_follow_their_definition():
    rng = random.Random(5)
    parts = ["a", "b", "é|", "a b a b", "\n", " ", "\x1f", "\x85", "x\n", "#<", "日本"]
    for text in ["", "a a a a", "a b", "\n\n"] + ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(500)]:
        assert quality.count_text(text)[:5] == count_words(text)
    assert quality.count_text(None)[:5] == (0, 0, 0, 0, 0)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(6)
    rows = []
    for i in range(400):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 500)}" for _ in range(rng.randint(60, 200))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "%%%" if bad else w for w in words), int(not bad)))
    return rows


def test_rules_are_learned_and_applied(spark, labelled):
    rows = [(i, t) for i, t, _ in labelled] + [(900, None), (901, "short"), (None, labelled[1][1]), (1, labelled[1][1])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in labelled] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    assert rules
    found = quality.judge(docs, rules, "doc_id").collect()
    truth = {i: bool(q) for i, _, q in labelled}
    assert all(r.kept == truth.get(r.doc_id, r.doc_id is None) for r in found)
    assert {r.doc_id for r in found if r.base_failed} == {900, 901}
    kept = quality.keep_good(docs, rules)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)


def test_without_labels_only_the_base_rule_decides(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, labels) == []
    assert quality.judge(docs, [], "doc_id").where("kept").count() == len(labelled)
    assert quality.judge(docs.limit(0), [], "doc_id").count() == 0


def test_rules_need_precision():
    rng = np.random.default_rng(0)
    columns = {"a": rng.random(300), "b": rng.random(300)}
    assert quality.learn(columns, rng.random(300) < 0.3, np.arange(300) % 3 == 0) == []
    bad = (columns["a"] > 0.7) & (columns["b"] <= 0.5)
    rules = quality.learn(columns, bad, np.arange(300) % 3 == 0)
    held = quality._covered(rules[0], columns, 300)
    assert len(rules[0]) == 2 and (held == bad).mean() > 0.97


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b""]


@pytest.fixture(scope="module")
def corpus(texts):
    return [(i, t) for i, (_, t) in enumerate(texts * 3)] + [(5000, None), (5001, ""), (None, "lom tir"), (3, texts[3][1])]


def test_base_scores_and_model_scores(spark, corpus):
    docs = spark.createDataFrame([(*r, 1.5) for r in corpus], "doc_id long, text string, score double")
    rows = neural_lm.train_and_score(docs).collect()
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    counts = collections.Counter(w for k, t in corpus if not held(k) for w in tokens(t))
    total = sum(counts.values())
    texts_of = dict(corpus)
    assert len(rows) == len(corpus)
    for r in rows:
        words = tokens(texts_of[r.doc_id])
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert r.held_out == held(r.doc_id) and r.base_score == pytest.approx(base)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 for r in rows)


def test_model_probabilities_sum_to_one(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    counts = neural_lm.word_counts(docs)
    classes = neural_lm.find_classes(counts)
    weights = neural_lm.train(docs, classes, seed_docs=100)
    n = len(classes.mass)
    before = np.random.default_rng(0).integers(0, neural_lm.BUCKETS, (neural_lm.CONTEXT, 1)).repeat(n, 1)
    assert (10 ** neural_lm.class_log10(weights, before, np.arange(n))).sum() == pytest.approx(1, abs=1e-4)
    inside = collections.Counter()
    for r in counts.collect():
        word = bytes(r.word)
        inside[classes.of(word)] += 1 if word == b"" or word in classes.words else (r.c + 0.5) / classes.mass[classes.of(word)]
    for number, share in inside.items():
        unseen = 0 if 0 < number < 2 + neural_lm.WORD_CLASSES else 0.5 / classes.mass[number]
        assert share + unseen == pytest.approx(1)


def test_few_rows_in_many_partitions_are_learned_from(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(40)
    out = [r for r in neural_lm.train_and_score(docs).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_every_training_row_teaches_in_every_round(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('w', id % 7, ' x') AS text").repartition(4)
    classes = neural_lm.find_classes(neural_lm.word_counts(docs))
    learned, average = [], neural_lm.averaged
    monkeypatch.setattr(neural_lm, "averaged", lambda rows: (learned.append(sum(r.n for r in rows)), average(rows))[1])
    neural_lm.train(docs, classes, seed_docs=100)
    # 3 tokens a row; 4 parts in 6 rounds
    assert len(learned) == len(neural_lm.RATES) and sum(learned[:4]) == 1200
    learned.clear()
    neural_lm.train(docs, classes)
    assert learned == [neural_lm.FEW_PASSES * 1200, 1200]


def test_classes_grow_with_the_vocabulary(spark, corpus):
    small = neural_lm.find_classes(neural_lm.word_counts(spark.createDataFrame(corpus, "doc_id long, text string")))
    assert len(small.mass) >= 2 + 126 + 128 and neural_lm.WIDTH >= 16 and neural_lm.NOISE >= 32
    many = spark.range(600_000).selectExpr("id AS doc_id", "concat('w', id, ' w', id % 5000) AS text")
    grown = neural_lm.find_classes(neural_lm.word_counts(many))
    assert grown.first_suffix > small.first_suffix and grown.buckets > small.buckets
    assert len(grown.words) == grown.first_suffix - 1 and len(grown.mass) > len(small.mass)
    assert grown.mass.sum() == pytest.approx(1_800_000 + 0.5 * 600_000, rel=1e-3)


def test_words_are_encoded_as_their_classes(spark, corpus):
    content = ["lom tir. sen!!! ba?!?!?!?!. !!!!!!!! ... x a, lom,,,,,,,, !!a!! \"q\"", "", "!", "TIR tir"]
    classes = neural_lm.find_classes(neural_lm.word_counts(spark.createDataFrame([(1, " ".join(content))], "doc_id long, text string")))
    dropped = neural_lm.Classes({b"": 1}, classes.suffixes | {neural_lm.suffix(w): n for n, w in enumerate(tokens(content[0])[:-1], 130)}, classes.mass, 0, 0, 128, 4096)
    for known in (classes, dropped):
        found, _, nth = neural_lm.Encoder(known)(content)
        words = [tokens(t) for t in content]
        assert found.tolist() == [known.of(w) for text in words for w in text]
        assert nth.tolist() == [i for text in words for i in range(len(text))]


def test_language_model_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neural_lm.train_and_score(docs).count() == 0
    only_held = next(k for k in range(50) if zlib.crc32(str(k).encode()) % 5 == 1)
    rows = neural_lm.train_and_score(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).collect()
    assert rows[0].train_tokens == 0 and rows[0].n_known == 0 and math.isfinite(rows[0].score)
