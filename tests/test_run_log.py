"""The run log (K12, O7) and intake in name order with late files."""

from pyspark.sql import functions as F

from shapecast.operators import report as R
from shapecast.streaming import queue as SQ

VERSION = ("trained_at string, model_version string, holdout_mape_pct double, mape_ci_low_pct double, mape_ci_high_pct double, "
           "holdout_r2 double, gate_status string")


def entry(spark, batch, queries=40, model=True, passed=6, failed=0):
    measured = spark.createDataFrame([(batch, queries, 5, 120)], "batch string, queries long, reps int, predictions long")
    rows = [(batch, "v3-0123abcd", 12.352, 9.424, 15.68, 0.9752, "pass")] if model else []
    return R.run_log_entries(measured, spark.createDataFrame(rows, VERSION), F.lit(passed), F.lit(failed))


def test_texts_of_a_run(spark):
    r = entry(spark, "batch_03").first()
    assert r["measure"] == "batch_03 · 40 queries measured (5 reps median)"
    assert r["train"] == "model v3-0123abcd · holdout MAPE 12.4% [9.4, 15.7] · R² 0.98 · PASS"
    assert r["publish"] == "120 predictions · checks PASS=6" and (r["passed"], r["failed"]) == (6, 0)
    r = entry(spark, "batch_04", queries=0, model=False, passed=0).first()
    assert (r["measure"], r["train"], r["publish"]) == ("every batch is already measured", "no model", "nothing to publish yet")


def test_the_last_twelve_runs_stay(spark):
    log = None
    for i in range(15):
        log = spark.createDataFrame(R.append_run_log(log, entry(spark, f"batch_{i:02d}")).collect(), R.RUN_LOG)
    assert sorted(r["at"] for r in log.collect()) == [f"batch_{i:02d}" for i in range(3, 15)]
    again = R.append_run_log(log, entry(spark, "batch_14", queries=7))
    assert again.count() == 12 and "· 7 queries" in again.filter("at = 'batch_14'").first()["measure"]


def test_files_are_taken_in_name_order_and_late_ones_repair_later_batches(spark, tmp_path):
    rows = [(100 * b + i, f"q{b}_{i}", f"batch_{b:02d}", f"t{i % 3}", "Small", f"select c from part where c < {i % 3}", 20.0 + 3 * i + b, i)
            for b in (1, 2, 3) for i in range(12)]
    log = spark.createDataFrame(rows, SQ.INTAKE_SCHEMA.fieldNames()).select(
        *[F.col(f.name).cast(f.dataType) for f in ([SQ.INTAKE_SCHEMA[n] for n in ("seq", "query_id", "query_tag", "template_id", "warehouse_size", "query_text", "execution_ms", "pos")])])
    tables = []
    for order in ((1, 2, 3), (3, 1, 2)):
        root = str(tmp_path / f"run{order[0]}")
        for b in order:             # files older by their age come later by their name
            SQ.write_intake(log.filter(F.col("query_tag") == f"batch_{b:02d}"), f"{root}/intake")
            if order[0] == 3:
                assert SQ.run_next(spark, f"{root}/intake", root).startswith(f"query_tag=batch_{b:02d}/")
        if order[0] == 1:
            names = SQ.run_in_name_order(spark, f"{root}/intake", root)
            assert names == sorted(names) and len(names) == 3
        assert SQ.run_next(spark, f"{root}/intake", root) is None
        got = spark.read.parquet(SQ.folders(root)["history"]).select("query_id", "TARGET_MS", "machine_factor", "HAS_PRIOR", "PRIOR_EXECUTION_MS")
        tables.append(sorted(map(tuple, got.collect())))
    assert tables[0] == tables[1] and len(tables[0]) == 36
    assert sum(r[3] for r in tables[0]) == 24
