"""Every registered query agrees with its SQL, and no plan leaves the JVM or multiplies rows."""

import re

import pytest

from sondeo.plans import catalogue
from tests.agreement import compare, connect

catalogue.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    query = catalogue.QUERIES[name]
    if name not in catalogue.SQL:
        assert query(spark, SF).count() > 0
        return
    problem, _ = compare(spark, duck, query, catalogue.SQL[name], SF)
    assert problem is None


@pytest.mark.parametrize("name", ["pareto_part_value", "data_quality_lineitem", "topk_others_brand", "fx_conversion", "grid_body", "parse_locale_numbers"])
def test_plan(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"EvalPython|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_scan_reads_only_what_it_needs(spark):
    plan = catalogue.QUERIES["pareto_event_type"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"event_type:string,value:double"}
