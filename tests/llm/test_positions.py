"""The positional index against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from gaugeworks.llm import positions

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def windows(items, width):
    out = {}
    for item, text in items:
        w = cut(text)
        for s in range(max(len(w) - width, 0) + 1 if w else 0):
            out.setdefault(tuple(w[s : s + width]), set()).add(item)
    return out


def exact(docs, items, width):
    """n_words, n_hit, items of every document, by comparing every window at every place."""
    wins = windows(items, width)
    out = []
    for _, text in docs:
        w = cut(text)
        hit, found = set(), set()
        for win, owners in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= {str(o) for o in owners if o is not None}
        out.append((len(w), len(hit), sorted(found)))
    return out


def near(docs, items, width, slop):
    """(document, window, start, spread) from each place of a window's rarest word."""
    often = Counter(w for _, text in docs for w in cut(text))
    out = set()
    for win in windows(items, width):
        if any(not often[w] for w in win):
            continue
        anchor = min(range(len(win)), key=lambda i: (often[win[i]], i))
        for d, (_, text) in enumerate(docs):
            w = cut(text)
            for p in [i for i, x in enumerate(w) if x == win[anchor]]:
                start = p - anchor
                apart = []
                for i, x in enumerate(win):
                    at = [abs(j - start - i) for j in range(max(0, start + i - slop), min(len(w), start + i + slop + 1)) if w[j] == x]
                    apart.append(min(at, default=slop + 1))
                if max(apart) <= slop:
                    out.add((d, win, start, max(apart)))
    return out


def corpus(seed, n_docs=60, n_items=12, vocabulary=14):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)] + ["the", "é", "日本", "The", "x9"]
    items = [(i, " ".join(rng.choices(names, k=rng.choice([1, 2, 4, 5, 9, 14])))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        w = rng.choices(names, k=rng.choice([0, 1, 3, 30, 80]))
        for _ in range(rng.randint(0, 2)):
            planted = rng.choice(items)[1].split()
            if rng.random() < 0.4 and len(planted) > 2:
                planted.insert(rng.randrange(len(planted)), "between")
            w[(at := rng.randrange(len(w) + 1)) : at] = planted
        docs.append((i, rng.choice([" ", ", ", "\n", "-"]).join(w)))
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize(("seed", "width", "slop"), [(1, 4, 2), (2, 3, 0), (3, 10, 1)])
def test_equals_brute_force(spark, seed, width, slop):
    docs, items = corpus(seed)
    d, b = frames(spark, docs, items)
    found = {r.doc_id: r for r in positions.decontaminate(d, b, width, slop).collect()}
    assert len(found) == len(docs)
    by_phrase = windows(items, width)
    close = {}
    for i, win, _, _ in near(docs, items, width, slop):
        close.setdefault(i, set()).update(by_phrase[win])
    for i, (n_words, n_hit, ids) in enumerate(exact(docs, items, width)):
        r = found[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, len(ids), n_hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r.n_near_items == len(close.get(i, ()))


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_matches_are_those_of_the_rarest_word(spark, slop):
    docs, items = corpus(5, 40, 8)
    d, b = frames(spark, docs, items)
    wins, _ = positions.windows_of(b, 4)
    terms = {r.window: tuple(r.terms) for r in wins.collect()}
    found = positions.matches(positions.index(d, wins), wins, slop).collect()
    assert {(r.doc_id, terms[r.window], r.start, r.spread) for r in found} == near(docs, items, 4, slop)
    assert len(found) == len({(r.row, r.window, r.start) for r in found})
    assert any(r.spread > 0 for r in found) == (slop > 0)


def test_missing_repeated_empty_and_clashing(spark):
    docs = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (4, " -!"), (5, "B C"), (6, "c b")]
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], "doc_id long, text string, place int, term string, row int")
    items = [(None, "b c"), (7, "b c"), (7, "a b"), (10, "b c"), (8, None), (9, "..."), (11, "zz b")]
    b = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, window int, doc_id string")
    found = positions.decontaminate(d, b).collect()
    rows = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.n_near_items) for r in found)
    assert rows == [(0, 4, 3, 2, 2)] * 2 + [(1, 4, 3, 2, 2)] * 2 + [(2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0), (5, 2, 2, 2, 2), (6, 2, 0, 0, 2)]
    sha = hashlib.sha256(b"10,7").hexdigest()
    assert {r.items_sha256 for r in found if r.n_hit} == {sha}
    no_docs, no_items = frames(spark, [], [])
    assert positions.decontaminate(no_docs, b).collect() == []
    clean = positions.decontaminate(d, no_items).collect()
    assert len(clean) == len(docs) and not any(r.contaminated for r in clean)
    # an item without id is hit and listed nowhere
    only = positions.decontaminate(d, b.where("item_id IS NULL")).collect()
    assert sum(r.contaminated for r in only) == 5 and {r.n_items for r in only} == {0}


def test_very_long_text_and_frequent_words(spark):
    text = "the " * 60_000 + "the cat sat on the mat " + "the " * 60_000
    d, b = frames(spark, [(1, text), (2, "x" * 500_000)], [(1, "the cat sat on the mat"), (2, "the the the")])
    found = {r.doc_id: r for r in positions.decontaminate(d, b, 3, 1).collect()}
    assert (found[1].n_words, found[1].n_hit, found[1].n_items) == (120_006, 120_006, 2)
    assert (found[2].n_words, found[2].n_hit) == (1, 0)


def test_no_python_and_no_loops_over_pairs(spark):
    docs, items = corpus(6)
    d, b = frames(spark, docs, items)
    found = positions.decontaminate(d, b, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|NestedLoop|Cartesian", plan)
