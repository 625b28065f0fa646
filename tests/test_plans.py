import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import variants
from gaugeworks.plans import checks, documents


def resource(type_, name, mode="managed", **expressions):
    return {"address": f"{type_}.{name}", "mode": mode, "type": type_, "name": name, "expressions": expressions}


def const(value):
    return {"constant_value": value}


def refs(*names):
    return {"references": list(names)}


POOL = [
    resource("aws_region", "now", "data"),
    resource("aws_ipam", "main", operating_regions=[{"region_name": refs("data.aws_region.now.name", "data.aws_region.now")}]),
    resource("aws_ipam_pool", "main", ipam_scope_id=refs("aws_ipam.main.id", "aws_ipam.main"), locale=refs("data.aws_region.now")),
    resource("aws_ipam_cidr", "main", cidr=const("172.2.0.0/16"), pool_id=refs("aws_ipam_pool.main.id", "aws_ipam_pool.main")),
    resource("aws_vpc", "main", pool_id=refs("aws_ipam_pool.main"), netmask=const(28), on=const(True), off=const(False), none=const(None), zero=const(0), any={}),
]


def plan(resources):
    return {"configuration": {"root_module": {"resources": resources}}}


@pytest.fixture(scope="module")
def plans(spark):
    docs = [("pool", plan(POOL)), ("empty", plan([])), ("two", plan([resource("aws_vpc", "a"), resource("aws_vpc", "b")]))]
    rows = [(k, json.dumps(d)) for k, d in docs]
    return documents.parse(spark.createDataFrame(rows, "plan_id string, json string"))


def test_counts_and_types(plans):
    rows = plans.select(
        "plan_id",
        documents.interconnections(F.col("doc")).alias("n"),
        documents.type_list(documents.resource_types(F.col("doc"))).alias("types"),
    ).collect()
    got = {r["plan_id"]: (r["n"], r["types"]) for r in rows}
    assert got["pool"] == (5, "aws_region, aws_ipam, aws_ipam_pool, aws_ipam_cidr, aws_vpc")
    assert got["empty"] == (0, "") and got["two"] == (0, "aws_vpc, aws_vpc")


def test_edges_and_reference_join(plans):
    resources = documents.plan_resources(plans)
    edges = {tuple(r)[1:] for r in documents.plan_edges(resources).collect()}
    assert ("aws_ipam.main", "operating_regions.region_name", "data.aws_region.now") in edges
    assert len(edges) == 8
    found = documents.referring_resources(resources, "aws_vpc", "aws_ipam_pool").collect()
    assert [(r["plan_id"], r["address"]) for r in found] == [("pool", "aws_vpc.main")]


def test_walks_agree_with_plain_python(spark):
    docs = [
        {"a": 1, "b": {"c": [True, False, 0, None, "x", {}, [[1, [2]]]], "d": []}, "references": {"references": []}},
        {"references": [{"x": {"references": ["a"]}}], "y": [{"references": 1}, {"references": None}]},
        {'a"references': 1, 'x': 'say "references": {"references":1}', "y\\\\": {"references": "\\\\"}, "referencesx": [{"xreferences": 1}]},
        {"references": {"é": '"references":'}, "k": '\\"references\\":'},
        [], {}, True, 0, "s", [[[[{"k": {"k": {"k": 1.5}}}]]]],
    ]

    def count(node, key):
        if isinstance(node, list):
            return sum(count(x, key) for x in node)
        if isinstance(node, dict):
            return (key in node) + sum(count(x, key) for x in node.values())
        return 0

    def leaves(node, path=()):
        if isinstance(node, list):
            return [leaf for x in node for leaf in leaves(x, path)]
        if isinstance(node, dict):
            return [leaf for k, x in node.items() for leaf in leaves(x, (*path, k))]
        return [(".".join(path), json.dumps(node))]

    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, json string")
    got = rows.withColumn("v", F.parse_json("json")).select(
        "i",
        variants.count_key(F.col("v"), "references").alias("n"),
        F.transform(
            variants.leaves(F.col("v")),
            lambda x: F.struct(F.coalesce(x["path"], F.lit("")), F.coalesce(F.to_json(x["value"]), F.lit("null"))),
        ).alias("leaves"),
    )
    for row in got.collect():
        assert row["n"] == count(docs[row["i"]], "references")
        assert sorted(tuple(x) for x in row["leaves"]) == sorted(leaves(docs[row["i"]]))


def test_depth_limit_raises(spark):
    deep = "[" * 12 + "1" + "]" * 12
    rows = spark.createDataFrame([(deep,)], "json string").select(F.parse_json("json").alias("v"))
    assert rows.select(F.size(variants.leaves(F.col("v"), 13))).first()[0] == 1
    with pytest.raises(Exception, match="deeper than"):
        rows.select(variants.leaves(F.col("v"), 5)).collect()


def test_verdict(spark):
    cases = [('{"a":true,"b":[true]}', "Success"), ('{"a":{"b":[true,false]}}', "Failure"), ('{"a":0}', "Failure"), ('{"a":0.0}', "Failure"), ("{}", "Success"), ('{"a":"false","b":null}', "Success"),
        ('{"a":[[false]]}', "Failure"), ("false", "Failure"), ("0", "Failure"), ('"0"', "Success"), ('{"false":10,"b":[100,0.5,1e0]}', "Success"),
        ('{"a":"x,false,0]","b":"\\\\\\",false"}', "Success"), ('{"a":-0.0}', "Failure"), ('{"a":0e5}', "Failure"), ("[true,null,0]", "Failure")]
    rows = spark.createDataFrame(cases, "json string, want string").withColumn("v", F.parse_json("json"))
    assert rows.filter(variants.policy_verdict(F.col("v")) != F.col("want")).count() == 0
    zero = rows.filter("json = '{\"a\":0}'").select(variants.policy_verdict(F.col("v"), False)).first()[0]
    assert zero == "Success"


def holds(plans, **rules):
    rows = checks.evaluate(plans, rules).collect()
    return {r["plan_id"]: {k: r[k] for k in rules} for r in rows}


def test_checks(plans):
    c = checks.Section()
    vpc = c.has_type("aws_vpc")
    got = holds(
        plans,
        vpc=checks.body(vpc),
        two=checks.at_least(2, vpc),
        data=checks.body(c.has_mode("data")),
        empty_object=checks.body(vpc, c.defined("any")),
        false_value=checks.body(c.defined("off.constant_value")),
        json_null=checks.body(c.not_null("none")),
        null_defined=checks.body(c.defined("none")),
        zero=checks.body(c.equals("zero", 0)),
        zero_text=checks.body(c.equals("zero", "0")),
        zero_flag=checks.body(c.equals("zero", False)),
        off=checks.body(c.equals("off", False)),
        in_range=checks.body(c.in_range("netmask", 0, 32)),
        boolean=checks.body(c.is_boolean("off")),
        cidr=checks.body(c.is_cidr("cidr")),
        pool=checks.body(vpc, c.refers_to("pool_id", "aws_ipam_pool")),
        scope=checks.body(vpc, c.refers_to("pool_id", "aws_ipam")),
        nested=checks.body(c.defined("operating_regions[0].region_name.references")),
        differs=checks.body(c.differs("netmask", 29)),
    )
    true = {k for k, v in got["pool"].items() if v}
    assert true == {
        "vpc", "data", "empty_object", "null_defined", "zero", "off", "in_range", "boolean", "cidr", "pool", "nested", "differs",
    }
    assert not any(got["empty"].values())
    assert {k for k, v in got["two"].items() if v} == {"vpc", "two"}


@pytest.mark.parametrize("version", [4, 6])
def test_cidr(spark, version):
    import ipaddress

    texts = [
        "10.0.0.0/16", "256.0.0.0/8", "1.2.3/8", "1.2.3.4/33", "1.2.3.4", "01.2.3.4/8", "::/0", "fe80::/10", "2001:db8::1/128",
        "2001:db8::1/129", "1:2:3:4:5:6:7:8/64", "1:2:3:4:5:6:7/64", "1::2::3/64", ":1:2:3:4:5:6:7:8/64", "12345::/16", "g::/16", ":::/1", "1:2:3:4:5:6:7::/64",
        "::1:2:3:4:5:6:7/64", "1:2:3:4:5:6:7:8::/64",
    ]

    def valid(text):
        try:
            return "/" in text and ipaddress.ip_interface(text).version == version
        except ValueError:
            return False

    shape = {4: checks.ipv4_cidr, 6: checks.ipv6_cidr}[version]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", shape(F.col("t")).alias("ok"))
    assert {r["t"]: r["ok"] for r in rows.collect()} == {t: valid(t) for t in texts}


def test_conditions_never_shuffle(plans):
    c = checks.Section()
    rule = checks.body(c.has_type("aws_vpc"), c.refers_to("pool_id", "aws_ipam_pool"))
    plan = checks.evaluate(plans, {"x": rule})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_checks_are_typed(spark):
    text = json.dumps({"configuration": {"root_module": {"resources": [
        {"address": "a", "type": "t", "mode": "managed", "expressions": {
            "text": {"constant_value": "5"}, "flag": {"constant_value": True}, "number": {"constant_value": 443}, "off": False,
        }}]}}})
    plans = spark.createDataFrame([("p", text)], "plan_id string, json string").select("plan_id", F.parse_json("json").alias("doc"))
    c = checks.Section()
    got = holds(
        plans,
        there=checks.body(c.defined("text")),
        text_in_range=checks.body(c.in_range("text", 0, 32)),
        flag_in_range=checks.body(c.in_range("flag", 0, 32)),
        number_in_range=checks.body(c.in_range("number", 0, 500)),
        number_one_of=checks.body(c.one_of("number", ["443"])),
        text_one_of=checks.body(c.one_of("text", ["5"])),
        number_below=checks.body(c.text_below("number", "5")),
        text_below=checks.body(c.text_below("text", "6")),
        number_at_least=checks.body(c.text_at_least("number", "1")),
        off_undefined=checks.body(c.undefined("off")),
        off_defined=checks.body(c.defined("off")),
        text_undefined=checks.body(c.undefined("text")),
    )["p"]
    assert {k for k, v in got.items() if v} == {"there", "number_in_range", "text_one_of", "text_below", "off_undefined"}


def test_deep_documents_are_walked_to_the_end(spark):
    deep = '{"a":' * 60 + "[1,2]" + "}" * 60
    rows = spark.createDataFrame([(deep,), ('{"b":[[[3]]]}',)], "json string").select(F.parse_json("json").alias("v"))
    got = sorted(tuple((x.path, x.value) for x in r[0]) for r in rows.select(F.transform(variants.leaves(F.col("v")), lambda x: F.struct(x["path"].alias("path"), F.to_json(x["value"]).alias("value")))).collect())
    assert got == [((".".join("a" * 60), "1"), (".".join("a" * 60), "2")), (("b", "3"),)]


def _deep(levels):
    doc = {"references": ["end"], "x": 1}
    for i in range(levels):
        doc = [doc, i] if i % 3 == 0 else {f"k{i}": doc, "references": [[f"r{i}"], {"n": True}], "other": None}
    return doc


@pytest.mark.parametrize("levels", [0, 2, 5, 9, 30])
def test_leaves_by_steps_of_rows_equal_the_fold(spark, levels):
    docs = [json.dumps(_deep(levels)), "[]", "{}", "7", '"references"', "null", None]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, json string").select("id", F.parse_json("json").alias("doc"))
    whole = rows.select("id", F.explode(variants.leaves(F.col("doc"))).alias("n")).select("id", "n.path", F.to_json("n.value").alias("v"))
    stepped = variants.walked_leaves(rows, "doc", ["id"]).select("id", "path", F.to_json("value").alias("v"))
    key = lambda r: (r[0], r[1] or "", r[2] or "")
    want = sorted(map(tuple, whole.collect()), key=key)
    assert sorted(map(tuple, stepped.collect()), key=key) == want
    named = variants.walked_leaves(rows, "doc", ["id"], until=lambda p: p.rlike("references$"))
    found = sorted(((r["id"], r["path"], r["v"]) for r in named.select("id", "path", F.to_json("value").alias("v")).collect()), key=key)
    assert found == [r for r in want if (r[1] or "").endswith("references")]
