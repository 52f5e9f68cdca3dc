"""Star queries: the DataFrame plan against its SQL text in DuckDB (sf0.001)."""

import pytest

from shapecast.operators.star import StarSpec, star_query, star_sql
from shapecast.plans.compare import compare

SPECS = [StarSpec(0, True, False, False, 0, 450), StarSpec(3, True, True, False, 100, 900),
         StarSpec(2, True, False, True, 0, 150), StarSpec(1, False, False, True, 0, 20),
         StarSpec(0, True, True, True, 1000, 900)]


@pytest.mark.parametrize("spec", SPECS)
def test_star_plan_matches_its_sql(spark, sf_small, spec):
    r = compare(spark, "star", lambda s, d: star_query(s, d, spec), star_sql(spec), sf_small)
    assert r["status"] == "match", r


def test_dimension_joins_are_size_checked_not_forced(spark, sf_small):
    plan = star_query(spark, sf_small, StarSpec(3, True))._jdf.queryExecution().toString()
    assert "ResolvedHint" not in plan   # no broadcast hint on data-sized dimensions


def test_fact_scan_reads_only_the_columns_it_needs(spark, sf_small):
    df = star_query(spark, sf_small, StarSpec(1, True, literal=20))
    text = df._jdf.queryExecution().executedPlan().toString()
    fact = [line for line in text.split("\n") if "l_extendedprice" in line and "ReadSchema" in line]
    assert fact, text
    schema = fact[0].split("ReadSchema: ")[1]
    assert "l_shipdate" not in schema and "l_returnflag" not in schema
    assert "l_orderkey" in schema and "l_partkey" in schema
