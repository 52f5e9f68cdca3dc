"""Pre-run features and priors from earlier batches only."""

import math

from pyspark.sql import functions as F

from spec_text import SPEC_TEXT
from shapecast import schemas as SC
from shapecast.operators import features as fe


def prior_rows(spark, rows):
    df = spark.createDataFrame(rows, "QUERY_ID string, QUERY_TAG string, "
                                     "QUERY_PARAMETERIZED_HASH string, TARGET_MS double")
    return {r["QUERY_ID"]: r for r in fe.attach_history(df).collect()}


def test_a_prior_never_comes_from_the_batch_it_is_in(spark):
    got = prior_rows(spark, [(f"q{i}", tag, "same", 10.0) for i, tag in
                             enumerate(["batch_01", "batch_01", "batch_02", "batch_02"])])
    assert [got[f"q{i}"]["HAS_PRIOR"] for i in range(4)] == [0, 0, 1, 1]
    assert [got[f"q{i}"]["PRIOR_EXECUTION_MS"] for i in range(4)] == [None, None, 10.0, 10.0]


def test_a_prior_is_the_mean_of_the_batches_before_it(spark):
    got = prior_rows(spark, [("a1", "batch_01", "a", 10.0), ("a2", "batch_02", "a", 30.0),
                             ("a3", "batch_03", "a", 99.0), ("b3", "batch_03", "b", 99.0)])
    assert got["a3"]["PRIOR_EXECUTION_MS"] == 20.0
    assert got["b3"]["HAS_PRIOR"] == 0


def test_null_hashes_are_one_shape(spark):
    got = prior_rows(spark, [("n1", "batch_01", None, 4.0), ("n2", "batch_02", None, 8.0)])
    assert got["n2"]["PRIOR_EXECUTION_MS"] == 4.0


def test_a_zero_prior_counts_as_none(spark):
    queue = spark.createDataFrame([("q1", "h0"), ("q2", "h9"), ("q3", "hx")],
                                  "QUERY_ID string, QUERY_PARAMETERIZED_HASH string")
    index = spark.createDataFrame([("h0", 0.0), ("h9", 999.0)],
                                  "QUERY_PARAMETERIZED_HASH string, PRIOR_EXECUTION_MS double")
    got = {r["QUERY_ID"]: r["HAS_PRIOR"] for r in fe.attach_prior(queue, index).collect()}
    assert got == {"q1": 0, "q2": 1, "q3": 0}


def featurise_one(spark, catalogue, text, size, prior=None):
    df = spark.createDataFrame([("q", text, size, prior, 1 if prior else 0)],
                               "QUERY_ID string, QUERY_TEXT string, WAREHOUSE_SIZE string, "
                               "PRIOR_EXECUTION_MS double, HAS_PRIOR int")
    return fe.featurise(df, catalogue).first()


def test_the_vector_is_in_contract_order(spark, catalogue):
    r = featurise_one(spark, catalogue, SPEC_TEXT.format(literal=450), "Small")
    assert r.__fields__[1:] == fe.FEATURES
    assert r["log_table_rows"] == math.log10(5_055_000)
    assert r["warehouse_threads"] == 2.0 and r["predicate_literal"] == 450.0
    assert r["log_limit_rows"] == math.log10(101) and r["has_prior"] == 0.0
    assert all(not math.isnan(r[f]) for f in fe.FEATURES)


def test_prior_enters_as_log(spark, catalogue):
    r = featurise_one(spark, catalogue, SPEC_TEXT.format(literal=900), "Small", 999.0)
    assert r["has_prior"] == 1.0 and abs(r["log_prior_ms"] - 3.0) < 1e-12


def test_no_limit_reads_as_zero(spark, catalogue):
    r = featurise_one(spark, catalogue, "select a from fact_event_s", "Medium")
    assert r["log_limit_rows"] == 0.0


def test_the_projection_drops_every_after_the_fact_column(spark):
    cols = SC.QUERY_HISTORY_COLUMNS + fe.HISTORY_COLUMNS
    df = spark.createDataFrame([], ", ".join(f"{c} string" for c in cols))
    visible = fe.project(df).columns
    assert set(visible) == set(fe.SOURCE_COLUMNS + fe.HISTORY_COLUMNS)
    assert not set(visible) & set(SC.AFTER_THE_FACT_COLUMNS)


def test_deleting_the_measurements_does_not_move_a_single_feature(spark, catalogue):
    hist = SC.conform(spark.createDataFrame(
        [("q1", SPEC_TEXT.format(literal=20), "Small", 123.0, 55),
         ("q2", "select a from fact_event_x where b > 7", "Medium", 9.0, 2)],
        "QUERY_ID string, QUERY_TEXT string, WAREHOUSE_SIZE string, EXECUTION_TIME double, "
        "ROWS_PRODUCED bigint"), SC.QUERY_HISTORY_SCHEMA)
    plain = fe.featurise(hist, catalogue)
    blind = fe.featurise(SC.blank_after_the_fact(hist), catalogue)
    assert plain.exceptAll(blind).count() == 0 and blind.exceptAll(plain).count() == 0


def test_the_column_sets_partition_query_history():
    pre, post = set(SC.PRE_RUN_COLUMNS), set(SC.AFTER_THE_FACT_COLUMNS)
    assert len(SC.QUERY_HISTORY_COLUMNS) == 75 and len(SC.TABLES_COLUMNS) == 30
    assert not pre & post and pre | post == set(SC.QUERY_HISTORY_COLUMNS)
    for c in ("EXECUTION_TIME", "BYTES_SCANNED", "ROWS_PRODUCED", "END_TIME"):
        assert c in post
    assert set(fe.SOURCE_COLUMNS + fe.HISTORY_SOURCE_COLUMNS) <= pre


def test_texts_are_parsed_once(spark, catalogue):
    df = spark.createDataFrame([("q1", "select 1 from FACT_EVENT_S limit 5", "Small")], "QUERY_ID string, QUERY_TEXT string, WAREHOUSE_SIZE string")
    out = fe.featurise(df, catalogue)
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert out.first()["n_tables"] == 1.0 and out.columns == ["QUERY_ID", *fe.FEATURES]
