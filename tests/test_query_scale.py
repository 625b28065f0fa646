"""Queries on small tables of their own: what is read, written and grouped does not exceed the job."""

import glob

import pytest

from gaugeworks.catalog import plan_queries, source_queries
from gaugeworks.operators import reshape
from gaugeworks.session import shared_dir


@pytest.fixture
def tables(spark, tmp_path):
    spark.range(40).selectExpr(
        "id AS o_orderkey", "id * 7 AS o_custkey", "if(id % 2 = 0, 'F', 'O') AS o_orderstatus", "id * 9000.0D AS o_totalprice"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(60).selectExpr(
        "id div 3 AS l_orderkey", "cast(id % 3 + 1 AS int) AS l_linenumber", "id AS l_partkey", "id % 5 AS l_suppkey",
        "if(id % 4 = 0, 'A', 'N') AS l_returnflag", "if(id % 2 = 0, 'F', 'O') AS l_linestatus",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_sections_of_a_plan_are_read_in_one_scan(spark, tables):
    rows = plan_queries.p17_rows(spark, tables)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = {(r.plan_id, r.section, r.pos): r for r in rows.collect()}
    assert len(found) == 2 * sum(1 + k % 5 for k in range(40))
    for section in ("planned_values", "resource_changes"):
        r = found[9, section, 2]
        assert (r.name, r.mode, r.size, r.enabled) == ("r3", "data", 9, False)


def test_written_plans_are_compressed(spark, tables):
    before = set(glob.glob(f"{shared_dir(spark)}/gaugeworks/plans-*/part-*"))
    rows = source_queries.s05(spark, tables).collect()
    written = set(glob.glob(f"{shared_dir(spark)}/gaugeworks/plans-*/part-*")) - before
    assert written and all(name.endswith(".txt.gz") for name in written)
    assert sorted((r.plan_id, r.pos) for r in rows) == [(k, i) for k in range(40) for i in range(1 + k % 5)]


def test_the_number_of_samples_is_read_without_grouping(spark, tables, monkeypatch):
    plans, width = [], reshape.sample_width

    def seen(samples):
        plans.append(samples._jdf.queryExecution().executedPlan().toString())
        return width(samples)

    monkeypatch.setattr(reshape, "sample_width", seen)
    rows = source_queries.s02_wide(spark, tables).collect()
    assert len(plans) == 1 and "Aggregate" not in plans[0]
    assert len(rows) == 60 and {r.sample_idx for r in rows} == {0, 1, 2}


def test_a_plan_is_parsed_once_for_its_resources(spark, tables):
    plan = plan_queries.n07(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_both_sides_of_a_reference_come_from_stored_resources(spark, tables):
    rows = plan_queries.j04(spark, tables)
    assert "parseJson" not in rows._jdf.queryExecution().optimizedPlan().toString()
    keys = {(r.plan_id, r.name) for r in rows.collect()}
    types = lambda k, i: (k * 7 + i) % 12
    first, second = (plan_queries.V.PLAN_TYPES.index(t) for t in ("aws_subnet", "aws_vpc"))
    want = set()
    for k in range(40):
        for i in range(2, 2 + k % 5):
            refers = {i - 1} | ({1} if i % 2 == 0 else set())
            if types(k, i) == first and any(types(k, j) == second for j in refers):
                want.add((k, f"r{i}"))
    assert keys == want and want
