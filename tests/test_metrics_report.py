"""Metrics, split, gate, deciles, digest, SLA verdicts, versions, checks."""

import pytest
from pyspark.sql import functions as F

from shapecast.operators import metrics as M
from shapecast.operators import model as MO
from shapecast.operators import report as R


def scored(spark, pairs):
    return spark.createDataFrame([(f"q{i}", a, p) for i, (a, p) in enumerate(pairs)],
                                 "query_id string, actual_ms double, predicted_ms double")


def test_mape_and_r2(spark):
    s = scored(spark, [(a, a * 1.1) for a in (10.0, 20.0, 40.0)])
    assert s.agg(M.mape()).first()[0] == pytest.approx(10.0)
    flat = scored(spark, [(10.0, 20.0), (20.0, 20.0), (40.0, 20.0)])
    assert M.r_squared(scored(spark, [(5.0, 5.0)] * 3)).first()[0] == 0.0
    assert M.r_squared(flat).first()[0] < 0.5


@pytest.mark.parametrize("mape,r2,ok", [(10, .95, True), (20, .95, False), (10, .5, False),
                                        (15, .90, True)])
def test_gate(spark, mape, r2, ok):
    assert spark.range(1).select(M.passes_gate(F.lit(float(mape)), F.lit(r2))).first()[0] is ok


def test_split_latest_batch_or_tail(spark):
    two = spark.createDataFrame([(i, "batch_01" if i < 5 else "batch_02") for i in range(8)],
                                "seq long, QUERY_TAG string")
    got = {r["seq"]: r["in_holdout"] for r in MO.split(two).collect()}
    assert [got[i] for i in range(8)] == [0] * 5 + [1] * 3
    one = spark.createDataFrame([(i, "batch_01") for i in range(10)], "seq long, QUERY_TAG string")
    got = {r["seq"]: r["in_holdout"] for r in MO.split(one).collect()}
    assert [got[i] for i in range(10)] == [0] * 7 + [1] * 3


def test_deciles_cover_every_row(spark):
    s = scored(spark, [(float(i + 1), float(i % 7 + 1)) for i in range(40)])
    t = M.calibration_table(s).orderBy("decile").collect()
    assert sum(r["queries"] for r in t) == 40 and t[0]["decile"] == 1 and len(t) == 10
    s3 = scored(spark, [(float(i + 1), float(i + 1)) for i in range(23)])
    sizes = [r["queries"] for r in M.calibration_table(s3).orderBy("decile").collect()]
    assert sizes == [5, 5, 5, 4, 4]


def test_bootstrap_interval_brackets_the_mape(spark):
    s = scored(spark, [(100.0, 100.0 + (i % 9) * 3) for i in range(50)])
    m = s.agg(M.mape()).first()[0]
    lo, hi = M.bootstrap_mape_ci(s, draws=300).first()
    assert lo < m < hi


def test_digest_ignores_row_order(spark):
    rows = [(f"q{i}", float(i) * 1.5) for i in range(30)]
    a = spark.createDataFrame(rows, "QUERY_ID string, EXECUTION_TIME double")
    b = spark.createDataFrame(rows[::-1], "QUERY_ID string, EXECUTION_TIME double").repartition(3)
    assert M.training_digest(a).first()[0] == M.training_digest(b).first()[0]
    c = spark.createDataFrame(rows[1:], "QUERY_ID string, EXECUTION_TIME double")
    assert M.training_digest(a).first()[0] != M.training_digest(c).first()[0]


def test_sla_verdicts(spark):
    detail = spark.createDataFrame(
        [(t, t, f"q{i}", a, p, 1.0) for i, (t, a, p) in enumerate(
            [("t1", 900.0, 800.0), ("t2", 900.0, 100.0), ("t3", 50.0, 500.0), ("t4", 50.0, 60.0)])]
        + [(None, None, "qn", 1.0, 1.0, 1.0)],
        "template_id string, template_label string, query_id string, actual_ms double, "
        "predicted_ms double, abs_pct_error double")
    got = {r["template_id"]: r["sla_verdict"] for r in R.sla_table(detail).collect()}
    assert got == {"t1": "breach_called", "t2": "missed_breach", "t3": "false_alarm",
                   "t4": "inside_sla"}


def test_model_versions_learning_curve(spark):
    hist = spark.createDataFrame(
        [(1, "v1-a", "t", 1, 10, 5, 12.0, 1.0, 2.0, .9, 3.0, 4.0, 30.0, False),
         (2, "v2-b", "t", 2, 20, 5, 9.0, 1.0, 2.0, .95, 3.0, 4.0, 21.0, True)],
        "model_sequence int, model_version string, trained_at string, batches_measured int, "
        "n_train_rows int, n_holdout_rows int, holdout_mape_pct double, mape_ci_low_pct double, "
        "mape_ci_high_pct double, holdout_r2 double, holdout_mae_ms double, cv_mape_pct double, "
        "baseline_mape_pct double, passes_gate boolean")
    rows = R.model_versions(hist).orderBy("model_sequence").collect()
    assert rows[0]["mape_change"] is None and rows[1]["mape_change"] == -3.0
    assert rows[1]["mape_gain_over_baseline"] == 12.0
    assert [r["gate_status"] for r in rows] == ["fail", "pass"]
    assert R.model_versions(hist).columns == R.VERSION_COLUMNS


def _detail(spark, rows):
    return spark.createDataFrame(rows, "model_version string, query_id string, predicted_ms double, "
                                       "prediction_scope string")


def test_checks_pass_and_fail(spark):
    measured = spark.createDataFrame([("q1",), ("q2",)], "QUERY_ID string")
    versions = spark.createDataFrame([("pass",)], "gate_status string")
    good = _detail(spark, [("v1", "q1", 5.0, "holdout"), ("v1", "q2", 7.0, "cross_validated")])
    assert all(r["ok"] for r in R.checks(measured, good, versions).collect())
    missing = _detail(spark, [("v1", "q1", 5.0, "holdout")])
    bad = {r["check"]: r["ok"] for r in R.checks(measured, missing, versions).collect()}
    assert bad[R.CHECKS[0]] is False
    negative = _detail(spark, [("v1", "q1", -1.0, "holdout"), ("v1", "q2", 7.0, "holdout")])
    bad = {r["check"]: r["ok"] for r in R.checks(measured, negative, versions).collect()}
    assert bad[R.CHECKS[1]] is False
    with pytest.raises(Exception):
        R.fail_on_checks(R.checks(measured, negative, versions)).collect()
