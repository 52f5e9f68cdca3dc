"""Drift interpolation and calibration."""

import pytest

from shapecast.operators import calibrate as cal


def interp(spark, checkpoints, positions, block=1 << 20):
    ck = spark.createDataFrame([("b", i, p, s) for i, (p, s) in enumerate(checkpoints)],
                               "query_tag string, ord int, pos bigint, seconds double")
    rows = spark.createDataFrame([("b", p) for p in positions], "query_tag string, pos bigint")
    out = cal.interpolate(rows, ck, order="ord", block=block)
    got = {r["pos"]: r["calibration_seconds"] for r in out.collect()}
    return [got[p] for p in positions]


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_straight_line_between_readings(spark, block):
    assert interp(spark, [(0, .10), (10, .20)], [0, 5, 10], block) == pytest.approx([.10, .15, .20])


@pytest.mark.parametrize("block", [1 << 20, 2])
def test_past_the_last_reading_and_a_repeated_position(spark, block):
    assert interp(spark, [(0, .1), (10, .3)], [40], block) == pytest.approx([.3])
    assert interp(spark, [(0, .1), (0, .1), (4, .2)], [0], block) == pytest.approx([.1])


def test_repeated_positions_take_last_on_the_left_first_on_the_right(spark):
    cps = [(0, .1), (4, .2), (4, .5), (8, .3)]
    assert interp(spark, cps, [6, 4], 3) == pytest.approx([.4, .2])


def test_calibrate_divides_out_the_drift(spark):
    rows = spark.createDataFrame([("b", 0, 400.0), ("b", 1, 800.0)],
                                 "query_tag string, pos bigint, execution_ms double")
    ck = spark.createDataFrame([("b", 0, .1), ("b", 1, .2)],
                               "query_tag string, pos bigint, seconds double")
    out = {r["pos"]: r for r in cal.calibrate(rows, ck, 0.1).collect()}
    assert out[0]["calibrated_execution_ms"] == 400.0
    assert out[1]["calibrated_execution_ms"] == 400.0
    assert out[1]["machine_factor"] == 2.0 and out[1]["calibration_ms"] == 200.0


def test_baseline_of_the_first_batch_scales_later_batches(spark):
    rows = spark.createDataFrame([("b2", 0, 200.0)], "query_tag string, pos bigint, execution_ms double")
    ck = spark.createDataFrame([("b2", 0, .2), ("b2", 1, .2)],
                               "query_tag string, pos bigint, seconds double")
    r = cal.calibrate(rows, ck, 0.1).first()
    assert r["machine_factor"] == 2.0 and r["calibrated_execution_ms"] == 100.0
    base = cal.baseline_reading(spark.createDataFrame(
        [("b1", 0, .1), ("b1", 10, .3), ("b2", 0, .5)], "query_tag string, pos bigint, seconds double"))
    assert base.first()[0] == .1


def test_schedule_every_tenth_and_the_end(spark):
    log = spark.createDataFrame([("b", p) for p in range(23)], "query_tag string, pos bigint")
    got = sorted(r["pos"] for r in cal.checkpoint_schedule(log).collect())
    assert got == [0, 10, 20, 23]
