"""Plan documents, their references and policy checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.catalog import views as V
from gaugeworks.catalog.registry import query
from gaugeworks.functions import variants
from gaugeworks.plans import checks, documents

_RES = V.with_sql(V.RESOURCES_SQL)


@query(
    "n01_key_count",
    _RES
    + """SELECT plan_id, CAST(sum((parent IS NOT NULL)::INT + (source IS NOT NULL)::INT) AS BIGINT) AS n_references
         FROM resources GROUP BY plan_id""",
)
def n01(spark, sf):
    return V.plans(spark, sf).select("plan_id", documents.interconnections(F.col("doc")).alias("n_references"))


@query("n02_leaf_paths", V.with_sql(V.POLICY_LEAVES_SQL) + "SELECT * FROM policy_leaves")
def n02(spark, sf):
    found = variants.walked_leaves(V.policy_outputs(spark, sf), "doc", ["plan_id"])
    return found.select(
        "plan_id",
        "path",
        F.variant_get("value", "$", "string").alias("value"),
        variants.type_name(F.col("value")).alias("type"),
    )


@query("n03_resource_types", _RES + "SELECT plan_id, CAST(pos AS INTEGER) AS pos, type FROM resources")
def n03(spark, sf):
    types = F.posexplode(documents.resource_types(F.col("doc"))).alias("pos", "type")
    return V.plans(spark, sf).select("plan_id", types)


@query(
    "n04_resource_list",
    _RES + "SELECT plan_id, string_agg(type, ', ' ORDER BY pos) AS resources FROM resources GROUP BY plan_id",
)
def n04(spark, sf):
    types = documents.resource_types(F.col("doc"))
    return V.plans(spark, sf).select("plan_id", documents.type_list(types).alias("resources"))


_VERDICT_SQL = """CASE WHEN bool_or(value = 'false' OR (type = 'BIGINT' AND value = '0')) THEN 'Failure'
                       ELSE 'Success' END"""


@query(
    "n05_policy_verdict",
    V.with_sql(V.POLICY_LEAVES_SQL)
    + f"""SELECT plan_id, {_VERDICT_SQL} AS verdict,
            CASE WHEN bool_or(value = 'false') THEN 'Failure' ELSE 'Success' END AS strict_verdict
          FROM policy_leaves GROUP BY plan_id""",
)
def n05(spark, sf):
    doc = F.col("doc")
    return V.policy_outputs(spark, sf).select(
        "plan_id",
        variants.policy_verdict(doc).alias("verdict"),
        variants.policy_verdict(doc, zero_is_false=False).alias("strict_verdict"),
    )


@query(
    "n06_policy_error",
    V.with_sql(V.POLICY_LEAVES_SQL)
    + f"""SELECT plan_id, CASE WHEN verdict = 'Failure' THEN 'Rule violation found. OPA complete output logged here: '
            ELSE 'No error' END AS message, CASE WHEN verdict = 'Failure' THEN label END AS logged_label
          FROM (SELECT plan_id, {_VERDICT_SQL} AS verdict, max(value) FILTER (path = 'pkg.label') AS label
                FROM policy_leaves GROUP BY plan_id)""",
)
def n06(spark, sf):
    doc = F.col("doc")
    error = variants.policy_error(variants.policy_verdict(doc), doc)
    rows = V.policy_outputs(spark, sf).select("plan_id", error.alias("error"))
    logged = F.try_parse_json(F.regexp_extract("error", r"(\{.*)$", 1))
    return rows.select(
        "plan_id",
        F.regexp_extract("error", r"^([^{]*)", 1).alias("message"),
        F.try_variant_get(logged, "$.pkg.label", "string").alias("logged_label"),
    )


_EDGES_SQL = """
edges AS (
  SELECT plan_id, address AS src_address, 'parent_id' AS attribute_path, unnest([parent || '.id', parent]) AS dst_ref
  FROM resources WHERE parent IS NOT NULL
  UNION ALL
  SELECT plan_id, address, 'ingress.source', unnest([source || '.id', source]) FROM resources WHERE source IS NOT NULL)"""


@query("n07_plan_edges", V.with_sql(V.RESOURCES_SQL, _EDGES_SQL) + "SELECT * FROM edges")
def n07(spark, sf):
    return documents.plan_edges(documents.plan_resources(V.plans(spark, sf)))


@query(
    "n07_out_degrees",
    V.with_sql(V.RESOURCES_SQL, _EDGES_SQL)
    + "SELECT plan_id, src_address, count(*) AS n_references FROM edges GROUP BY plan_id, src_address",
)
def n07_degrees(spark, sf):
    return documents.out_degrees(documents.plan_edges(documents.plan_resources(V.plans(spark, sf))))


@query(
    "n08_config_defaults",
    """SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, CAST(20 AS INTEGER) AS samples
       FROM events""",
)
def n08(spark, sf):
    config = F.parse_json("props")
    return V.table(spark, sf, "events").select(
        "event_id",
        variants.config_value(config, "k", "int", F.lit(0)).alias("k"),
        variants.config_value(config, "samples", "int", F.lit(20)).alias("samples"),
    )


@query(
    "j04_reference_join",
    V.with_sql(V.RESOURCES_SQL, _EDGES_SQL)
    + """SELECT DISTINCT s.plan_id, s.address, s.name FROM resources s
         JOIN edges e ON e.plan_id = s.plan_id AND e.src_address = s.address
         JOIN resources t ON t.plan_id = e.plan_id AND t.address = e.dst_ref
         WHERE s.type = 'aws_subnet' AND t.type = 'aws_vpc'""",
)
def j04(spark, sf):
    resources = documents.plan_resources(V.plans(spark, sf))
    return documents.referring_resources(resources, "aws_subnet", "aws_vpc").drop("pos")


# -- checks ----------------------------------------------------------------------------------

_C = checks.Section()
_PLANNED = checks.Section("planned_values")
_CHANGES = checks.Section("resource_changes")
_MANAGED = _C.has_mode("managed")


def _holds(**conditions: str) -> str:
    """SQL that a rule holds for a plan if some of its resources meets the condition."""
    columns = ", ".join(f"coalesce(bool_or({sql}), false) AS {name}" for name, sql in conditions.items())
    return _RES + f"SELECT plan_id, {columns} FROM resources GROUP BY plan_id"


def _rules(name: str, sql: str, section: str = "configuration", **rules: checks.Rule) -> None:
    query(name, sql)(lambda spark, sf: checks.evaluate(V.plans(spark, sf), rules, section))


_rules("p01_has_type", _holds(vpc="type = 'aws_vpc'"), vpc=checks.body(_C.has_type("aws_vpc")))
_rules(
    "p02_defined",
    _holds(cidr="cidr_block IS NOT NULL", enabled="enabled", empty="true", no_such="false"),
    cidr=checks.body(_C.defined("cidr_block")),
    enabled=checks.body(_C.defined("enabled.constant_value")),
    empty=checks.body(_C.defined("computed")),
    no_such=checks.body(_C.defined("no_such")),
)
_rules("p03_undefined", _holds(no_cidr="cidr_block IS NULL"), no_cidr=checks.body(_C.undefined("cidr_block")))
_rules(
    "p04_constant",
    _holds(
        text="engine_version = '1.2.0'",
        number="size = 7",
        flag="enabled",
        other_type="false",
        differs="size <> 7",
        missing="cidr_block <> '10.0.0.0/16'",
    ),
    text=checks.body(_C.equals("engine_version", "1.2.0")),
    number=checks.body(_C.equals("size", 7)),
    flag=checks.body(_C.equals("enabled", True)),
    other_type=checks.body(_C.equals("size", "7")),
    differs=checks.body(_C.differs("size", 7)),
    missing=checks.body(_C.differs("cidr_block", "10.0.0.0/16")),
)
_rules(
    "p05_not_null",
    _holds(size="true", cidr="cidr_block IS NOT NULL"),
    size=checks.body(_C.not_null("size")),
    cidr=checks.body(_C.not_null("cidr_block")),
)
_rules(
    "p06_is_boolean",
    _holds(enabled="true", size="false"),
    enabled=checks.body(_C.is_boolean("enabled")),
    size=checks.body(_C.is_boolean("size")),
)
_rules("p07_in_range", _holds(small="size BETWEEN 0 AND 32"), small=checks.body(_C.in_range("size", 0, 32)))
_rules(
    "p08_cidr",
    _holds(v4="CAST(split_part(cidr_block, '.', 2) AS INTEGER) <= 255", v6="false"),
    v4=checks.body(_C.is_cidr("cidr_block", 4)),
    v6=checks.body(_C.is_cidr("cidr_block", 6)),
)
_rules(
    "p09_one_of",
    _holds(known="engine_version IN ('1.1.0', '1.3.0')"),
    known=checks.body(_C.one_of("engine_version", ["1.1.0", "1.3.0"])),
)
_rules(
    "p10_referenced_attribute",
    _RES
    + """SELECT plan_id, coalesce(bool_or(type = 'aws_subnet' AND EXISTS (
           SELECT 1 FROM resources t WHERE t.plan_id = s.plan_id AND t.address = s.parent AND t.type = 'aws_vpc'
             AND t.enabled)), false) AS in_enabled_vpc FROM resources s GROUP BY plan_id""",
    in_enabled_vpc=checks.body(
        _C.has_type("aws_subnet"), _C.refers_to("parent_id", "aws_vpc", _C.equals("enabled", True))
    ),
)
_rules(
    "p11_conflicting",
    _holds(alone="cidr_block IS NOT NULL AND parent IS NULL"),
    alone=checks.body(_C.without("cidr_block", "parent_id")),
)
_rules(
    "p12_version_text",
    _holds(below="engine_version < '1.2'", at_least="engine_version >= '1.2.0'"),
    below=checks.body(_C.text_below("engine_version", "1.2")),
    at_least=checks.body(_C.text_at_least("engine_version", "1.2.0")),
)
_rules(
    "p13_absent_branch",
    _holds(ok="cidr_block IS NULL OR CAST(split_part(cidr_block, '.', 2) AS INTEGER) <= 255"),
    ok=checks.either(checks.body(_C.undefined("cidr_block")), checks.body(_C.is_cidr("cidr_block", 4))),
)
_rules(
    "p14_rule",
    _holds(
        rule="(type = 'aws_vpc' AND enabled AND size < 20) OR (type = 'aws_lb' AND mode = 'managed')"
    ),
    rule=checks.either(
        checks.body(_C.has_type("aws_vpc"), _C.equals("enabled", True), _C.in_range("size", 0, 19)),
        checks.body(_C.has_type("aws_lb"), _MANAGED),
    ),
)
_rules(
    "p15_count",
    _RES
    + """SELECT plan_id, count(*) FILTER (mode = 'managed' AND parent IS NOT NULL) >= 2 AS two_children
         FROM resources GROUP BY plan_id""",
    two_children=checks.at_least(2, _MANAGED, _C.defined("parent_id")),
)
_rules(
    "p16_composition",
    _RES
    + """SELECT plan_id, bool_or(type = 'aws_vpc') AND bool_or(type = 'aws_subnet') AS network
         FROM resources GROUP BY plan_id""",
    network=checks.every(checks.body(_C.has_type("aws_vpc")), checks.body(_C.has_type("aws_subnet"))),
)
_rules(
    "p17_planned_values",
    _holds(on="enabled AND size > 10"),
    "planned_values",
    on=checks.body(_PLANNED.equals("enabled", True), _PLANNED.in_range("size", 11, 1000)),
)
_rules(
    "p17_resource_changes",
    _holds(on="enabled AND type = 'aws_instance'"),
    "resource_changes",
    on=checks.body(_CHANGES.has_type("aws_instance"), _CHANGES.equals("enabled", True)),
)


@query(
    "p17_section_rows",
    _RES
    + "".join(
        f"""{union} SELECT plan_id, '{section}' AS section, CAST(pos AS INTEGER) AS pos, address, mode, type, name,
              size, enabled FROM resources"""
        for union, section in (("", "planned_values"), (" UNION ALL", "resource_changes"))
    ),
)
def p17_rows(spark, sf):
    attributes = F.col("attributes")
    return documents.plan_resources(V.plans(spark, sf), ["planned_values", "resource_changes"]).select(
        "plan_id", "section", "pos", "address", "mode", "type", "name",
        F.variant_get(attributes, "$.size", "bigint").alias("size"),
        F.variant_get(attributes, "$.enabled", "boolean").alias("enabled"),
    )


_rules(
    "p18_nested_block",
    _holds(https="source IS NOT NULL", referenced="source IS NOT NULL"),
    https=checks.body(_C.equals("ingress[0].port", 443)),
    referenced=checks.body(_C.defined("ingress[0].source.references")),
)
