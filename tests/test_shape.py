"""Statement shape read from the text."""

from pyspark.sql import functions as F

from spec_text import SPEC_TEXT
from shapecast.functions import shape as S
from shapecast.operators import shape as op


def parse(spark, *texts):
    df = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)],
                               "query_id string, query_text string")
    return [r.asDict() for r in op.with_shape(df).orderBy("query_id").collect()]


def test_a_catalogue_query_parses_to_the_shape_it_was_built_from(spark):
    r = parse(spark, SPEC_TEXT.format(literal=450))[0]
    assert r["tables"] == ["FACT_EVENT_L", "DIM_CUSTOMER_WL", "DIM_PRODUCT_WL"]
    assert (r["n_tables"], r["n_joins"]) == (3, 2)
    assert (r["has_group_by"], r["has_order_by"], r["has_window"]) == (1, 1, 1)
    assert r["limit_rows"] == 100
    assert r["n_predicates"] == 1
    assert r["predicate_literal"] == 450.0


def test_cte_names_are_not_tables(spark):
    r = parse(spark, SPEC_TEXT.format(literal=450))[0]
    assert "FILTERED" not in r["tables"] and "RANKED" not in r["tables"]


def test_no_predicate_and_no_limit_read_as_zero(spark):
    r = parse(spark, "select count(*) from fact_event_s")[0]
    assert (r["n_predicates"], r["predicate_literal"], r["limit_rows"], r["n_joins"]) == (0, 0.0, 0, 0)


def test_two_predicates_are_counted(spark):
    r = parse(spark, "select a from fact_event_s where quantity > 5 and amount < 900 limit 10")[0]
    assert (r["n_predicates"], r["predicate_literal"], r["limit_rows"]) == (2, 900.0, 10)


def test_comments_do_not_become_structure(spark):
    r = parse(spark, "-- group by nothing\nselect a from fact_event_s /* order by x */")[0]
    assert r["has_group_by"] == 0 and r["has_order_by"] == 0


def test_nested_where_gives_its_own_clause(spark):
    df = spark.createDataFrame([("select a from t where x in (select y from u where z between 1"
                                 " and 7 group by y) and w <= 3.5 order by a",)], "t string")
    clauses = df.select(S.where_clauses(S.clean(F.col("t"))).alias("w")).first()["w"]
    assert clauses[1].strip() == "z between 1 and 7"
    r = parse(spark, df.first()["t"])[0]
    assert r["n_predicates"] == 5 and r["predicate_literal"] == 3.5


def test_null_text_reads_as_empty(spark):
    r = parse(spark, None)[0]
    assert r["tables"] == [] and r["n_tables"] == 0


def test_shape_adds_table_sizes_and_warehouse(spark, catalogue):
    df = spark.createDataFrame([("q", SPEC_TEXT.format(literal=450), "Small")],
                               "query_id string, query_text string, warehouse_size string")
    r = op.with_table_sizes(op.with_shape(df), catalogue) \
        .withColumn("warehouse_threads", op.warehouse_threads()).first()
    assert r["warehouse_threads"] == 2
    assert r["table_rows"] == 5_000_000 + 50_000 + 5_000
    assert r["table_bytes"] > 0 and r["tables_known"] == 3


def test_a_name_listed_twice_keeps_its_last_row_and_blanks_are_zero(spark):
    cat = spark.createDataFrame([("T", "10", "1", "2020-01-01"), ("t", "20", "2", "2021-01-01"), ("U", " ", None, "2020-01-01"),
                                 ("V", "x", "7", "2020-01-01")],
                                "TABLE_NAME string, ROW_COUNT string, BYTES string, LAST_ALTERED string")
    df = spark.createDataFrame([("q", "select 1 from t join u on a = b join v on c = d"), ("p", None)], "query_id string, query_text string")
    got = {r["query_id"]: r for r in op.with_table_sizes(op.with_shape(df), cat).collect()}
    assert (got["q"]["table_rows"], got["q"]["table_bytes"], got["q"]["tables_known"]) == (20, 9, 3)
    assert (got["p"]["table_rows"], got["p"]["tables_known"]) == (0, 0)


def test_a_huge_limit_does_not_fail(spark):
    assert parse(spark, "select a from t limit 99999999999999999999")[0]["limit_rows"] == 2**63 - 1


def test_an_unknown_table_and_warehouse_contribute_nothing(spark, catalogue):
    df = spark.createDataFrame([("q", "select count(*) from not_in_the_catalogue", "Jumbo")],
                               "query_id string, query_text string, warehouse_size string")
    r = op.shape(df, catalogue).first()
    assert (r["table_rows"], r["tables_known"], r["warehouse_threads"]) == (0, 0, 0)


def test_parameterized_hash_ignores_literals_not_case(spark):
    texts = [SPEC_TEXT.format(literal=lit) for lit in (20, 900)] + [SPEC_TEXT.upper()]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hs = [r[0] for r in df.select(S.parameterized_hash(F.col("t"))).collect()]
    assert hs[0] == hs[1] != hs[2]
    q = df.select(S.query_hash(F.col("t"))).collect()
    assert q[0][0] != q[1][0] and len(q[0][0]) == 32


def test_unknown_warehouse_is_rejected_for_pre_run_rows(spark):
    import pytest
    df = spark.createDataFrame([("select 1", "Jumbo")], "query_text string, warehouse_size string")
    with pytest.raises(Exception):
        op.pre_run(df).collect()
