"""Semi-structured documents held as VARIANT: counts, leaves and verdicts as column expressions.

Nothing here shuffles: each expression looks at the document of its row. Counts and verdicts need
no paths, so they scan the compact JSON text once. Leaves need paths, so they walk: a fold over
the depth whose accumulator holds the nodes of the current depth, each step replacing them by
their children. A document deeper than the usual depth is walked on, for as many steps as its
text has brackets, which no nesting can exceed. Where the leaves become rows anyway, the walk
takes a step of rows for each level instead.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import occurrences

USUAL_DEPTH = 12

# A string and a zero as JSON writes them.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
JSON_ZERO = r"-?0(?:\.0+)?(?:[eE][+-]?\d+)?"

_NODES = "array<struct<name:string,value:variant>>"
_LEVEL = "array<array<struct<name:string,value:variant>>>"


def as_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>")


def as_list(node: Column) -> Column:
    return F.try_variant_get(node, "$", "array<variant>")


def _empty(ddl: str) -> Column:
    return F.array().cast(ddl)


def _start(doc: Column) -> Column:
    root = F.struct(F.lit(None).cast("string").alias("name"), doc.alias("value"))
    return F.array(root).cast(_NODES)


def _fold(state: Column, step: Callable[[Column], Column], result: str, doc: Column, max_depth: int | None) -> Column:
    def finish(acc: Column) -> Column:
        too_deep = F.raise_error(F.lit(f"document is deeper than {max_depth} levels"))
        return F.when(F.size(acc["nodes"]) == 0, acc[result]).otherwise(too_deep)

    def advance(acc: Column, _: Column) -> Column:
        return F.when(F.size(acc["nodes"]) == 0, acc).otherwise(step(acc))

    # one step per level, one to see the last nodes and one to run out of them
    if max_depth is not None:
        return F.aggregate(F.sequence(F.lit(1), F.lit(max_depth + 2)), state, advance, finish)
    usual = F.aggregate(F.sequence(F.lit(1), F.lit(USUAL_DEPTH + 2)), state, advance)
    text = F.to_json(doc)
    brackets = F.length(text) - F.length(F.translate(text, "[{", ""))

    def go_on(acc: Column) -> Column:
        rest = F.aggregate(F.sequence(F.lit(1), brackets + 2), acc, advance, lambda a: a[result])
        return F.when(F.size(acc["nodes"]) == 0, acc[result]).otherwise(rest)

    # the transform of one element evaluates the usual walk once
    return F.transform(F.array(usual), go_on)[0]


def count_key(doc: Column, key: str) -> Column:
    """How many objects of the document, at any depth, have ``key``.

    In compact JSON, a quote without a backslash before it opens or closes a string, and after a
    closing one comes punctuation. So the key in quotes with a colon behind is an object key,
    unless a backslash precedes it: then it is the end of a longer key that holds a quote.
    """
    token = json.dumps(key, ensure_ascii=False) + ":"
    compact = F.to_json(doc)
    return occurrences(compact, token) - occurrences(compact, "\\" + token)


def _members(node: Column, named: Callable[[Column], Column]) -> Column:
    return F.transform(
        F.map_entries(as_object(node["value"])),
        lambda e: F.struct(named(e["key"]).alias("name"), e["value"].alias("value")),
    )


def leaves(
    doc: Column, max_depth: int | None = None, keep: Callable[[Column], Column] | None = None
) -> Column:
    """``array<struct(path, value)>`` of the scalars; list positions are not part of a path.

    ``below`` keeps the children of each node, NULL for a scalar, so that a node is taken apart
    once only. With ``max_depth`` a deeper document is an error. ``keep`` tells of a node (name,
    value) whether to look below it.
    """

    def children(node: Column) -> Column:
        items = F.transform(
            as_list(node["value"]), lambda x: F.struct(node["name"].alias("name"), x.alias("value"))
        )
        found = F.coalesce(_members(node, lambda name: F.concat_ws(".", node["name"], name)), items)
        return found if keep is None else F.filter(found, keep)

    def step(acc: Column) -> Column:
        nodes = F.flatten(F.array_compact(acc["below"]))
        scalars = F.zip_with(acc["nodes"], acc["below"], lambda n, b: F.when(b.isNull(), n))
        return F.struct(
            nodes.alias("nodes"),
            F.transform(nodes, children).alias("below"),
            F.concat(acc["found"], F.array_compact(scalars)).alias("found"),
        )

    start = _start(doc)
    state = F.struct(
        start.alias("nodes"),
        F.transform(start, children).cast(_LEVEL).alias("below"),
        _empty(_NODES).alias("found"),
    )
    found = _fold(state, step, "found", doc, max_depth)
    pathed = F.transform(found, lambda n: F.struct(n["name"].alias("path"), n["value"].alias("value")))
    return F.when(doc.isNotNull(), pathed)


def walked_leaves(
    rows: DataFrame, doc: str, keep: Sequence[str] = (), until: Callable[[Column], Column] | None = None, levels: int = 5
) -> DataFrame:
    """``keep, path, value``: a row for each scalar of the documents in column ``doc``.

    The same leaves as :func:`leaves`, but each level is a step of rows: a node is exploded into its
    children, a scalar stays. So a node is taken apart once and nothing holds all nodes of a
    document. ``until`` tells of a path whether its scalars are wanted; others are dropped when they
    are met. What is deeper than ``levels`` is walked by the fold.
    """
    path, value, child = F.col("_path"), F.col("_value"), F.col("_child")
    root = [F.lit(None).cast("string").alias("_path"), F.col(doc).alias("_value")]
    nodes = rows.where(F.col(doc).isNotNull()).select(*keep, *root)
    for _ in range(levels + 1):
        below = rows.sparkSession.tvf.variant_explode_outer(value.outer()).toDF("_pos", "_key", "_child")
        nodes = nodes.lateralJoin(below)
        if until is not None:
            nodes = nodes.where(F.col("_pos").isNotNull() | until(path))
        name = F.when(F.col("_key").isNull(), path).otherwise(F.concat_ws(".", path, "_key"))
        nodes = nodes.select(*keep, name.alias("_path"), F.coalesce(child, value).alias("_value"))
    deeper = F.transform(
        leaves(value), lambda n: F.struct(F.concat_ws(".", path, n["path"]).alias("path"), n["value"].alias("value"))
    )
    if until is not None:
        deeper = F.filter(deeper, lambda n: until(n["path"]))
    # an empty object or list is left as it was and has no leaves
    inner = as_object(value).isNotNull() | as_list(value).isNotNull()
    own = F.array(F.struct(path.alias("path"), value.alias("value")))
    if until is not None:
        own = F.when(until(path), own)
    found = nodes.select(*keep, F.explode(F.when(inner, deeper).otherwise(own)).alias("_leaf"))
    return found.select(*keep, F.col("_leaf.path").alias("path"), F.col("_leaf.value").alias("value"))


def type_name(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_false(value: Column, zero_is_false: bool = True) -> Column:
    """A boolean false leaf, or (by default) a numeric zero."""
    kind = type_name(value)
    false_flag = (kind == "BOOLEAN") & ~F.try_variant_get(value, "$", "boolean")
    if not zero_is_false:
        return F.coalesce(false_flag, F.lit(False))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    zero = number & (F.try_variant_get(value, "$", "double") == 0)
    return F.coalesce(false_flag | zero, F.lit(False))


def policy_verdict(output: Column, zero_is_false: bool = True) -> Column:
    """``Success`` unless a leaf of the policy output is false; no leaves is ``Success``.

    With its strings emptied, the compact JSON text holds a bare word or number only as a leaf.
    """
    bare = F.regexp_replace(F.to_json(output), JSON_STRING, '""')
    leaf = rf"false|{JSON_ZERO}" if zero_is_false else "false"
    violated = bare.rlike(rf"(?:^|[:\[,])(?:{leaf})(?:$|[,\]}}])")
    return F.when(violated, F.lit("Failure")).when(output.isNotNull(), F.lit("Success"))


def policy_error(verdict: Column, complete_output: Column) -> Column:
    """The error text that goes with a verdict, holding the complete output on failure.

    The texts are fixed values.
    """
    return F.when(
        verdict == "Failure",
        F.concat(
            F.lit("Rule violation found. OPA complete output logged here: "),
            F.to_json(complete_output),
        ),
    ).otherwise(F.lit("No error"))


def config_value(config: Column, key: str, type_: str, default: Column) -> Column:
    """One setting of a JSON run configuration, with its default."""
    return F.coalesce(F.try_variant_get(config, f"$.{key}", type_), default)
