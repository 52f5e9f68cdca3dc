"""Library pieces without a registered query: CSV round trip of multi-line text
(S1, S6), failures of a store."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shapecast import schemas as SC
from shapecast.sources import history_io as IO


def test_multiline_text_round_trips_through_csv(spark):
    rows = [("q1", "select a\nfrom t\nwhere b = 'x, \"y\"'", None)]
    df = SC.conform(spark.createDataFrame(rows, "QUERY_ID string, QUERY_TEXT string, "
                                                "QUERY_TAG string"), SC.QUERY_HISTORY_SCHEMA)
    path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "h")
    IO.write_csv(df, path, SC.QUERY_HISTORY_COLUMNS)
    back = IO.read_history_csv(spark, path).first()
    assert back["QUERY_TEXT"] == rows[0][1] and back["QUERY_TAG"] is None
    assert IO.read_history_csv(spark, path + "_missing").count() == 0


def test_a_failing_store_is_not_a_missing_file(spark):
    with pytest.raises(Exception):
        IO.read_history_csv(spark, "nosuchscheme://host/path").count()
    with pytest.raises(Exception):
        IO.read_parquet_or_none(spark, "nosuchscheme://host/path")
    assert IO.read_parquet_or_none(spark, "/tmp/none-such-folder-here") is None


def _fitted(spark, catalogue, n=40):
    from pyspark.sql import functions as F

    from shapecast.operators import features as fe
    from shapecast.operators import model as MO
    rows = spark.range(n).select(
        F.concat(F.lit("q"), "id").alias("QUERY_ID"),
        F.concat(F.lit("select count(*) from fact_event_"), F.when(F.col("id") % 2 == 0, "s").otherwise("l"),
                 F.lit(" where a < "), F.col("id")).alias("QUERY_TEXT"),
        F.lit("Small").alias("WAREHOUSE_SIZE"), (F.col("id") % 2 * 90 + 10).cast("double").alias("TARGET_MS"))
    feats = fe.featurise(rows, catalogue).join(rows.select("QUERY_ID", "TARGET_MS"), "QUERY_ID")
    return feats.withColumn("in_holdout", (F.substring("QUERY_ID", -1, 1) == "7").cast("int")), MO


def test_one_statement_is_scored_before_it_runs(spark, catalogue):
    feats, MO = _fitted(spark, catalogue)
    model = MO.pipeline(MO.new_gbt()).fit(MO.labelled(feats))
    small = MO.predict_text(model, catalogue, "select count(*) from fact_event_s where a < 5", "Small")
    large = MO.predict_text(model, catalogue, "select count(*) from fact_event_l where a < 5", "Small")
    assert 0 < small < 30 < large
    with pytest.raises(Exception):
        MO.predict_text(model, catalogue, "select 1", "Jumbo")


def test_too_few_rows_are_refused(spark, catalogue):
    feats, MO = _fitted(spark, catalogue, 11)
    with pytest.raises(ValueError, match="too few"):
        MO.fit_and_score(feats, MO.new_linear)


def test_fits_have_tasks_by_rows_not_by_shuffle_partitions(spark):
    from shapecast.operators import model as MO
    from shapecast.operators.features import FEATURES
    vector = [(F.col("id") % (k + 2)).cast("double").alias(f) for k, f in enumerate(FEATURES)]
    rows = spark.range(3000).select(F.concat(F.lit("q"), "id").alias("QUERY_ID"), *vector)
    dealt = MO.dealt(rows.repartition(40), 3000)
    assert dealt.rdd.getNumPartitions() == 2 and dealt.count() == 3000
    # one key and one vector many times, or none: nothing is lost
    assert MO.dealt(rows.withColumn("QUERY_ID", F.lit(None).cast("string")), 3000).count() == 3000


def test_a_written_csv_has_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IO, "CSV_ROWS", 100)
    IO.write_csv(spark.range(250).coalesce(1).select("id", F.lit("a\nb").alias("t")), f"{tmp_path}/rows")
    assert len([f for f in os.listdir(f"{tmp_path}/rows") if f.endswith(".csv")]) == 3
    back = spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/rows")
    assert back.count() == 250 and back.select("t").distinct().collect()[0][0] == "a\nb"
