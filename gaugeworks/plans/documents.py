"""Plan documents as VARIANT: their resources, references and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import variants
from gaugeworks.session import checkpointed

# Fixed value: the key below which a resource lists what it refers to.
REFERENCES = "references"
# Where each section of a plan keeps its resources, and where a resource keeps its attributes.
SECTIONS = {
    "configuration": ("$.configuration.root_module.resources", ["expressions"]),
    "planned_values": ("$.planned_values.root_module.resources", ["values"]),
    "resource_changes": ("$.resource_changes", ["change", "after"]),
}
_HEAD = ["address", "mode", "type", "name"]


def parse(rows: DataFrame, json: str = "json", doc: str = "doc") -> DataFrame:
    """Rows with the plan text replaced by the parsed document."""
    return rows.select(*[c for c in rows.columns if c != json], F.parse_json(json).alias(doc))


def resource_array(doc: Column, section: str = "configuration") -> Column:
    """The resources of a section as an array of structs with typed head fields."""
    path, attributes = SECTIONS[section]
    nested = "variant"
    for name in reversed(attributes[1:]):
        nested = f"struct<{name}:{nested}>"
    head = ",".join(f"{name}:string" for name in _HEAD)
    # one typed read of the whole list, cheaper than a path per field
    typed = f"array<struct<{head},{attributes[0]}:{nested},depends_on:array<string>>>"

    def resource(r: Column) -> Column:
        value = r
        for name in attributes:
            value = value[name]
        return F.struct(*[r[name].alias(name) for name in _HEAD], value.alias("attributes"), r["depends_on"].alias("depends_on"))

    return F.transform(F.try_variant_get(doc, path, typed), resource)


def resource_types(doc: Column) -> Column:
    """Types of all configured resources, data resources included, in plan order."""
    return F.try_variant_get(doc, SECTIONS["configuration"][0], "array<struct<type:string>>")["type"]


def type_list(types: Column) -> Column:
    """The types as one text, repeats kept."""
    return F.array_join(types, ", ")


def interconnections(doc: Column) -> Column:
    """Number of reference lists below the configured resources, at any depth."""
    resources = F.try_variant_get(doc, SECTIONS["configuration"][0], "variant")
    return variants.count_key(resources, REFERENCES)


def plan_resources(
    plans: DataFrame, section: str | Sequence[str] = "configuration", key: str = "plan_id"
) -> DataFrame:
    """One row per resource of a section, or of several, with its position; a plan is read once."""
    if isinstance(section, str):
        rows = plans.select(key, F.lit(section).alias("section"), resource_array(F.col("doc"), section).alias("_all"))
    else:
        lists = [F.struct(F.lit(s).alias("section"), resource_array(F.col("doc"), s).alias("_all")) for s in section]
        rows = plans.select(key, F.inline(F.array(*lists)))
    # the inner form would have Spark test the list for rows first, building and parsing each plan again for it
    found = rows.select(key, "section", F.posexplode_outer("_all").alias("pos", "r"))
    return found.where(F.col("pos").isNotNull()).select(key, "section", "pos", "r.*")


def plan_edges(resources: DataFrame, key: str = "plan_id", keep: Sequence[str] = ()) -> DataFrame:
    """One row per reference: which attribute of which resource refers to what.

    ``keep`` names further columns of the referring resource to carry along.
    """
    named = lambda path: (path == REFERENCES) | path.endswith(f".{REFERENCES}")
    found = variants.walked_leaves(resources, "attributes", [key, "address", *keep], until=named)
    return found.select(
        key,
        F.col("address").alias("src_address"),
        *keep,
        F.regexp_replace("path", rf"\.?{REFERENCES}$", "").alias("attribute_path"),
        F.try_variant_get(F.col("value"), "$", "string").alias("dst_ref"),
    )


def referring_resources(
    resources: DataFrame, source_type: str, target_type: str, key: str = "plan_id"
) -> DataFrame:
    """Resources of one type that refer to the address of a resource of another in the same plan.

    Only the attributes of the first type are searched for references; a plan with very many
    resources spreads over the join by address. The resources of both types are stored, so that
    the plans are read once for the two sides.
    """
    searched = F.when(F.col("type") == source_type, F.col("attributes")).alias("attributes")
    both = resources.filter(F.col("type").isin(source_type, target_type))
    both = checkpointed(both.select(key, "pos", "address", "type", "name", searched), "referring")
    sources = both.filter(F.col("type") == source_type)
    targets = both.filter(F.col("type") == target_type).select(key, F.col("address").alias("dst_ref"))
    hits = plan_edges(sources, key, ["pos", "name"]).join(targets, [key, "dst_ref"], "left_semi")
    return hits.select(key, "pos", F.col("src_address").alias("address"), "name").distinct()


def out_degrees(edges: DataFrame, key: str = "plan_id") -> DataFrame:
    """References per referring resource."""
    return edges.groupBy(key, "src_address").agg(F.count("*").alias("n_references"))
