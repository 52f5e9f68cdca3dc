"""Registered queries against their DuckDB twins on the smallest data."""

import pytest

from shapecast.plans.compare import compare
from shapecast.plans.registry import load_all

FAST = ["X03_tables", "X07_where_clauses", "X14_table_sizes", "X14b_table_sizes_by_join",
        "W05_position_in_batch", "C02_calibrated_runtime", "J06_checkpoint_interval_lookup_small_blocks",
        "A06_prior_from_earlier_batches", "P08_feature_vector", "K02_sla_verdicts",
        "K03_model_versions", "A11_calibration_deciles_latest", "S15_queue_cut_in_batches_of_40",
        "U06_upsert_batch_twice", "T03_streamed_target_and_prior", "P03_blanking_after_the_fact_changes_no_feature"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, sf_small, name):
    builder, sql = load_all()[name]
    r = compare(spark, name, builder, sql, sf_small)
    assert r["status"] == "match", r


def test_every_oracle_names_a_query():
    import __spark_entry__ as entry
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 100


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns[:3] == ["template_id", "template_label", "queries"]
    assert df.count() > 0
