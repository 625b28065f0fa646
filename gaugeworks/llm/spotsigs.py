"""Spot signatures: what stands after common words, as a fingerprint of a text.

Every common word (an anchor) opens a signature: the anchor and the next content words, common
words between them left out; the last anchors of a text, which too few content words follow, open none. A text's fingerprint is the set of its signatures. Sets are compared by
Jaccard likeness; as sets of lengths a <= b are never more alike than a / b, sets are partitioned
by length and only neighbouring partitions compared.

Only DataFrame functions are used. NULL texts count as empty. A text without a signature has one
made of all its words; without words its set is empty, which is like other empty sets (1.0) and
unlike all others (0.0). Documents with equal ids follow each other by text; NULL doc_ids come
first; an only document is its own next one. An empty table gives an empty one; further columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.jaccard import joined_lists, node_components, verified
from gaugeworks.llm.order import id_range
from gaugeworks.session import checkpointed

# fixed values: frequent function words of English, German, French and Spanish
ANCHORS = (
    "the of and to in a is that it for on was as with be by at or "
    "der die und den das ist nicht ein eine zu von mit sich auf als "
    "de la le et les des un une que est en du dans pour qui "
    "el los y del se las por con para su no al es"
).split()
CHAIN = 2
RANGE_ROWS = 512


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words that looks at each letter once."""
    letters: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        letters.setdefault(word[:1], []).append(word[1:])
    parts = [c + (_any_of(rest) if any(rest) else "") for c, rest in letters.items() if c]
    return "(?:" + "|".join(parts) + ")" + ("?" if "" in letters else "")


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted hashes of the spot signatures of a text."""
    stop = _any_of(anchors) + " "
    word = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    spaced = F.concat(F.lit(" "), F.trim(word), F.lit(" "))
    # a run of common words is read once, with what follows it: its anchors share the content words;
    # possessive loops neither recurse nor go back, however long a run is
    content = "[^ ]++" + f"(?: (?:{stop})*+[^ ]++)" * (chain - 1)
    runs = F.regexp_extract_all(spaced, F.lit(f" (?=((?:{stop})++(?:{content})?))(?:{stop})++"), F.lit(1))
    parted = F.transform(runs, lambda r: F.struct(r.alias("run"), F.regexp_replace(r, f"^(?:{stop})++", "").alias("after")))
    followed = F.filter(parted, lambda p: p["after"] != "")
    spelled = F.transform(
        followed,
        lambda p: F.struct(
            F.array_distinct(F.split(F.substring(p["run"], F.lit(1), F.length(p["run"]) - F.length(p["after"]) - 1), " ")).alias("anchors"),
            F.regexp_replace(p["after"], f"(?<= )(?:{stop})++", "").alias("content"),
        ),
    )
    found = F.flatten(F.transform(spelled, lambda p: F.transform(p["anchors"], lambda a: F.xxhash64(F.concat_ws(" ", a, p["content"])))))
    whole = F.when(spaced == "  ", F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(spaced)))
    return F.array_sort(F.array_distinct(F.when(F.size(found) > 0, found).otherwise(whole)))


def fingerprint(sigs: Column) -> Column:
    """One string for a set of signatures, equal for equal sets."""
    return F.sha2(sigs.cast("string").cast("binary"), 256)


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; NULL, without looking inside, where the lengths forbid ``at_least``."""
    less, more = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    exact = F.when(more == 0, 1.0).when(less == 0, 0.0).otherwise(common / (less + more - common))
    return exact if at_least <= 0 else F.when(less >= at_least * more, exact)


def length_part(sigs: Column, at_least: float) -> Column:
    """Number of the length partition: sets alike to ``at_least`` are in the same or the next one."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1)).cast("double")) / -math.log(at_least)).cast("int")


def compare_with_edits(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprint every text and its edited text, in which the next document's start replaces the end.

    Documents meet their next one inside a range of ids; only the first document of each range
    is sent to the range before it.
    """
    ranged = docs.select(
        id_range(docs, range_rows).alias("part"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")
    ).repartition("part")
    order = Window.partitionBy("part").orderBy("doc_id", "text")
    own = ranged.withColumn("sigs", signatures(F.col("text")))
    inside = own.select(
        "*",
        F.lead(F.struct("text", "sigs")).over(order).alias("following"),
    )
    # one row a range from here on
    first = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    parts = first.select("part")
    lowest = Window.orderBy("part")
    before = parts.select(
        F.coalesce(
            F.lag("part").over(lowest),
            F.max("part").over(lowest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("before"),
        "part",
    )
    heads = before.join(first, "part").select(
        F.col("before").alias("part"),
        F.struct(F.col("first.text").alias("text"), signatures(F.col("first.text")).alias("sigs")).alias("head"),
    )
    paired = inside.join(heads, "part").select(
        "doc_id", "text", "sigs", F.coalesce("following", "head").alias("next"), F.char_length("text").cast("long").alias("n_chars")
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = paired.withColumn(
        "edited",
        F.concat(
            F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
            F.substring("next.text", F.lit(1), half),
        ),
    ).withColumn("edited_sigs", signatures(F.col("edited")))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next.sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
    )


def near_duplicate_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, class_id) of every document; a class is joined by likeness of ``percent`` or more.

    The rarest signatures of two alike sets must meet, inside a length partition or the next one.
    The class number is its lowest doc_id. Sets that are equal are compared once.
    """
    described = checkpointed(
        docs.select(F.col("doc_id").cast("long"), signatures(F.col("text")).alias("hashes")), "spotsigs"
    ).withColumn("digest", F.when(F.size("hashes") > 0, fingerprint(F.col("hashes"))))
    nodes = checkpointed(
        described.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.first("hashes").alias("hashes"))
        .withColumn("node", F.monotonically_increasing_id()),
        "spotsigs-nodes",
    )
    each = nodes.select("node", F.size("hashes").alias("size"), length_part(F.col("hashes"), percent / 100).alias("part"), F.explode("hashes").alias("hash"))
    often = each.groupBy("hash").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("node").orderBy("n", "hash")
    ranked = each.join(often, "hash").withColumn("place", F.row_number().over(ordered) - 1)
    prefix = ranked.where(F.col("place") < F.col("size") - F.ceil(percent * F.col("size") / 100) + 1)
    lists = prefix.select(
        "node", "size", "place", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "hash"
    ).select("node", "size", "place", F.xxhash64("part", "hash").alias("key"))
    met = checkpointed(joined_lists(lists), "spotsigs-lists")
    sets = nodes.select("node", "hashes")
    sized = nodes.select("node", F.size("hashes").alias("size"))
    joined = node_components(met, sized, lambda pairs: verified(pairs, sets, percent), percent)
    own = nodes.join(joined, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("component"))
    numbers = own.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    classes = own.join(numbers, "component").select("digest", "class_id")
    return described.join(classes, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
