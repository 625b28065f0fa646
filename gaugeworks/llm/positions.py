"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

The index stores a posting (row, place, term) for every document word that a benchmark item
holds. A window is a run of consecutive item words. Its lists are taken from the rarest term on:
each posting of the rarest one, adjusted by the term's place in the window, proposes a start; the
list of the next rarest term must agree, and only starts that both propose meet the lists of the
other terms. Places agree within ``slop``: a match whose terms all stand exactly where the window
has them is an exact phrase, the others are proximity matches.

No list is gathered: postings meet by row, term and a block of neighbouring places, so neither a
frequent term nor a long document is a group. Only the rarest term's list is joined by term
alone, one row a posting and window. Equal windows, of one or of several items, are looked up once.

NULL and empty texts have no words; such items have no window, such documents no hit. Items of
fewer words than a window are one window, however few. Items of equal id are one item; an item
without item_id is hit like others but counted and listed nowhere. Repeated document rows and NULL
doc_ids are rows like others. Very long texts are one row while they are cut into words, postings
after that. Empty tables: without items nothing is hit, without documents there is no row. Other
columns than doc_id, item_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import checkpointed

WINDOW = 10
SLOP = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, with A-Z lowered."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def windows_of(items: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Stored tables (window, terms) of the distinct windows and (window, item_id) of their items."""
    last = F.greatest(F.size("words") - width, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda s: F.array_join(F.slice("words", s + 1, width), " "))
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    each = cut.where(F.size("words") > 0).select("item_id", F.explode(runs).alias("phrase")).distinct()
    each = checkpointed(each, "positions-phrases")
    phrases = each.select("phrase").distinct().withColumn("window", F.monotonically_increasing_id())
    phrases = checkpointed(phrases, "positions-windows")
    windows = phrases.select("window", F.split("phrase", " ").alias("terms"))
    return windows, phrases.join(each, "phrase").select("window", "item_id")


def index(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The stored index: a row for each posting, and one with place NULL for each document.

    Columns: row (unique number of the document's row), doc_id, n_words, place, term.
    """
    vocabulary = checkpointed(windows.select(F.explode("terms").alias("term")).distinct(), "positions-terms")
    cut = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        words(F.col("text")).alias("words"),
    )
    # the last of the exploded rows stands for the document: no vocabulary has an empty word
    each = cut.select(
        "row", "doc_id", F.size("words").alias("n_words"), F.posexplode(F.concat("words", F.array(F.lit("")))).alias("place", "term")
    )
    known = vocabulary.withColumn("known", F.lit(True))
    posted = each.join(known, "term", "left").where("known OR place = n_words")
    posting = F.col("known").isNotNull()
    return checkpointed(
        posted.select(
            "row", "doc_id", "n_words", F.when(posting, F.col("place")).alias("place"), F.when(posting, F.col("term")).alias("term")
        ),
        "positions-index",
    )


def _ranked(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, size, place, term, nth): the windows' terms from the rarest on, where all occur.

    Of equally frequent terms the one that stands first in the window comes first.
    """
    often = postings.groupBy("term").agg(F.count("*").alias("n"))
    terms = windows.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "term"))
    found = terms.join(often, "term")
    by_window = found.groupBy("window", "size").agg(F.array_sort(F.collect_list(F.struct("n", "place", "term"))).alias("all"))
    whole = by_window.where(F.size("all") == F.col("size"))  # a window's terms are few
    each = whole.select("window", "size", F.posexplode("all").alias("nth", "t"))
    return checkpointed(each.select("window", "size", "nth", "t.place", "t.term"), "positions-ranked")


def _near(expected: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """``expected`` (row, term, at, ...) with ``apart``, the distance to a posting within ``slop`` of ``at``."""
    block = 2 * slop + 1
    blocks = F.array_distinct(F.array(F.floor((F.col("at") - slop) / block), F.floor((F.col("at") + slop) / block)))
    wanted = expected.withColumn("block", F.explode(blocks)).alias("e")
    there = postings.select("row", "term", "place", F.floor(F.col("place") / block).alias("block")).alias("p")
    same = [F.col(f"e.{c}") == F.col(f"p.{c}") for c in ("row", "term", "block")]
    apart = F.abs(F.col("p.place") - F.col("e.at"))
    met = wanted.join(there, same[0] & same[1] & same[2] & (apart <= slop))
    return met.select(*(f"e.{c}" for c in expected.columns), apart.alias("apart"))


def matches(indexed: DataFrame, windows: DataFrame, slop: int = SLOP) -> DataFrame:
    """Stored (row, doc_id, window, start, size, spread): where a window's terms stand near their places.

    A match starts where the rarest term puts it; spread is the largest distance, at most ``slop``,
    of a term from its place. Spread 0 is an exact phrase.
    """
    postings = indexed.where("place IS NOT NULL")
    ranked = _ranked(postings, windows)
    first = ranked.where("nth = 0").select("window", "size", F.col("place").alias("offset"), "term")
    second = ranked.where("nth = 1").select("window", "place", "term")
    start = F.col("place") - F.col("offset")
    proposed = postings.join(first, "term").select("row", "n_words", "window", "size", start.alias("start"))
    # an exact phrase lies inside the text, a proximity match may be cut by ``slop`` words
    proposed = proposed.where((F.col("start") >= -slop) & (F.col("start") + F.col("size") <= F.col("n_words") + slop))
    proposed = checkpointed(proposed.drop("n_words"), "positions-proposed")

    agreed = proposed.join(second, "window").withColumn("at", F.col("start") + F.col("place")).drop("place")
    listed = postings.join(second.select("term").distinct(), "term", "left_semi")
    both = _near(agreed, listed, slop).select("row", "window", "size", "start").distinct()
    both = checkpointed(both.unionByName(proposed.where("size = 1")), "positions-agreed")

    # a stored table, so that Spark knows how few rows these are when it plans the join
    rows = checkpointed(both.select("row").distinct(), "positions-rows")
    others = ranked.where("nth > 0").select("window", "place", "term")
    wanted = both.join(others, "window").withColumn("at", F.col("start") + F.col("place"))
    kept = _near(wanted, postings.join(rows, "row", "left_semi"), slop)
    closest = kept.groupBy("row", "window", "size", "start", "place").agg(F.min("apart").alias("apart"))
    spread = closest.groupBy("row", "window", "size", "start").agg(
        F.count("*").alias("n"), F.max("apart").alias("spread")
    )
    found = spread.where("n = size - 1").drop("n").unionByName(both.where("size = 1").withColumn("spread", F.lit(0)))
    documents = indexed.where("place IS NULL").select("row", "doc_id")
    found = found.join(documents, "row").select("row", "doc_id", "window", "start", "size", F.col("spread").cast("int"))
    return checkpointed(found, "positions-matches")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    n_hit are the words inside an exact occurrence of a window, n_items the items with such a window,
    items_sha256 the digest of their ids, sorted as strings and joined by commas; n_near_items the
    items with a window whose words stand within ``slop`` of their places, exact ones included.
    """
    windows, owners = windows_of(items, width)
    indexed = index(docs, windows)
    found = matches(indexed, windows, slop)
    exact = found.where("spread = 0")
    places = exact.select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("place"))
    hits = places.distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    # the items of a document are part of its result row
    phrase = F.when(F.col("spread") == 0, F.col("item_id"))
    met = found.groupBy("row", "window").agg(F.min("spread").alias("spread")).join(owners, "window")
    by_item = met.where("item_id IS NOT NULL").groupBy("row", "item_id").agg(F.min("spread").alias("spread"))
    listed = by_item.groupBy("row").agg(
        F.array_sort(F.collect_list(phrase)).alias("ids"), F.count("*").alias("n_near_items")
    )
    documents = indexed.where("place IS NULL").select("row", "doc_id", "n_words")
    joined = documents.join(hits, "row", "left").join(listed, "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"),
    )
