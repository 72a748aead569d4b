"""Plans stay distributed: no Cartesian products, columns pruned, filters pushed to the scan."""

import os
import re

import pytest

from graphloom.plans import queries_graph, queries_text, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

#: The join of two one-row aggregates, by design.
ONE_ROW_JOINS = {"file_page_local_total"}


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_product_of_tables(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    if name not in ONE_ROW_JOINS:
        assert "BroadcastNestedLoopJoin" not in text


def test_pruning_and_pushdown(spark):
    text = plan(registry.QUERIES["export_page"](spark, SF))
    assert "GreaterThan(o_orderkey,1000)" in text and "TakeOrderedAndProject" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>", text)
    text = plan(registry.QUERIES["route_by_length"](spark, SF))
    assert "ReadSchema: struct<text:string>" in text
