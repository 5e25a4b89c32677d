"""Every query that has SQL gives the rows that DuckDB gives."""

import pytest
from harness import difference

from voxtable.plans import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert difference(spark, QUERIES[name], ORACLES[name], DATA) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).limit(1).count() == 1


def test_harness_sees_a_difference(spark):
    sql = ORACLES["A16_type_counts"].replace("count(*) AS n", "count(*) + 1 AS n")
    assert difference(spark, QUERIES["A16_type_counts"], sql, DATA)


@pytest.mark.parametrize("name", ["J1_max_overlap_assign", "J11_event_semi", "J13_next_event", "J15_segment_text", "J3_chunk_frame_mean", "P7_time_neighbours", "W15_switch_zones"])
def test_range_joins_are_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_what_they_need(spark):
    plan = QUERIES["A16_type_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
    assert "IsNotNull(value)" in plan
