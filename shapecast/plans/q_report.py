"""Registered model and report queries over the whole log: versions over batch
prefixes (M1, M4, M6, M8, M9, A7-A10, A20), the latest model's detail, SLA
verdicts and checks (K1-K4..K9, K11, K13, A11, A13, A14, A17, A18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import report as R
from ..operators import versions as V
from ..operators.features import FEATURES
from ..operators.ordinal import sorted_position
from . import evaluate as E
from .oracle import FEATURE_CTES, LABEL_CTES, SHAPE_CTES, TRAIN_CTES, VERSION_CTES, q
from .q_calibrate import BRACKET_CTES
from .registry import register
from ..session import stage

CHAIN = (SHAPE_CTES, BRACKET_CTES, TRAIN_CTES, FEATURE_CTES, LABEL_CTES, VERSION_CTES)


def qq(*parts: str) -> str:
    return q(*CHAIN, *parts)


def _versions(spark, sf_dir):
    # One row per version; the pass behind it runs once per application.
    return E.versions(spark, sf_dir)


def detail(spark, sf_dir):
    """The detail table, built once per application."""
    def build():
        preds, feats = E.latest_predictions(spark, sf_dir)
        return R.prediction_detail(E.shape_rows(feats), preds)
    return stage(spark, ("detail", sf_dir), build)


@register("M01_holdout_split_by_version", qq("""
select b, query_id as QUERY_ID, in_holdout from vrows"""))
def m01(spark, sf_dir):
    return E.version_rows(E.numbered(spark, sf_dir)).select(
        F.col("b").cast("bigint").alias("b"), "QUERY_ID", "in_holdout")


@register("M04_out_of_fold_predictions", qq("""
select b, query_id as QUERY_ID, round(predicted_ms, 3) as predicted_ms
from vscored where in_holdout = 0"""))
def m04(spark, sf_dir):
    s = E.scored_versions(E.numbered(spark, sf_dir), E.models(spark, sf_dir)).filter(F.col("in_holdout") == 0)
    return s.select(F.col("b").cast("bigint").alias("b"), "QUERY_ID",
                    F.round("predicted_ms", 3).alias("predicted_ms"))


@register("M08_metrics_by_version", qq("""
select b as model_sequence, model_version, trained_at, b as batches_measured, n_train_rows,
  n_holdout_rows, holdout_mape_pct, mape_ci_low_pct, mape_ci_high_pct, holdout_r2,
  holdout_mae_ms, cv_mape_pct, baseline_mape_pct, passes_gate from vmetrics"""))
def m08(spark, sf_dir):
    return _versions(spark, sf_dir).withColumn(
        "model_sequence", F.col("model_sequence").cast("bigint")).withColumn(
        "batches_measured", F.col("batches_measured").cast("bigint"))


@register("M08_newest_version_metrics", qq("""
select b as model_sequence, model_version, trained_at, b as batches_measured, n_train_rows,
  n_holdout_rows, holdout_mape_pct, mape_ci_low_pct, mape_ci_high_pct, holdout_r2,
  holdout_mae_ms, cv_mape_pct, baseline_mape_pct, passes_gate from vmetrics
where b = (select max(b) from vmetrics)"""))
def m08n(spark, sf_dir):
    """The production path: only the newest version (every batch), each row
    scored once - O(rows), the versions table grows by one row per run."""
    return E.versions(spark, sf_dir, latest_only=True).withColumn(
        "model_sequence", F.col("model_sequence").cast("bigint")).withColumn(
        "batches_measured", F.col("batches_measured").cast("bigint"))


@register("M06_gate_by_version", qq("""
select model_version, passes_gate from vmetrics"""))
def m06(spark, sf_dir):
    return _versions(spark, sf_dir).select("model_version", "passes_gate")


@register("A07_holdout_mape_by_version", qq("""
select model_version, holdout_mape_pct from vmetrics"""))
def a07(spark, sf_dir):
    return _versions(spark, sf_dir).select("model_version", "holdout_mape_pct")


@register("A08_holdout_r2_by_version", qq("""
select model_version, holdout_r2 from vmetrics"""))
def a08(spark, sf_dir):
    return _versions(spark, sf_dir).select("model_version", "holdout_r2")


@register("A09_holdout_mae_by_version", qq("""
select model_version, holdout_mae_ms from vmetrics"""))
def a09(spark, sf_dir):
    return _versions(spark, sf_dir).select("model_version", "holdout_mae_ms")


@register("A10_bootstrap_mape_ci_by_version", qq("""
select b, round(lo, 3) as mape_ci_low_pct, round(hi, 3) as mape_ci_high_pct from ci"""))
def a10(spark, sf_dir):
    return _versions(spark, sf_dir).select(
        F.col("model_sequence").cast("bigint").alias("b"), "mape_ci_low_pct", "mape_ci_high_pct")


@register("A20_training_digest_by_version", qq("""
select b, model_version from dig"""))
def a20(spark, sf_dir):
    return V.names(E.state(spark, sf_dir)).select(
        F.col("b").cast("bigint").alias("b"), "model_version")


@register("M09_latest_predictions", qq("""
select model_version, query_id, in_holdout, round(actual_ms, 3) as actual_ms,
  round(predicted_ms, 3) as predicted_ms,
  round(abs(predicted_ms - actual_ms) / actual_ms * 100.0, 3) as abs_pct_error from latest"""))
def m09(spark, sf_dir):
    preds, _ = E.latest_predictions(spark, sf_dir)
    return preds


@register("K01_prediction_detail", qq("select * from detail"))
def k01(spark, sf_dir):
    return R.worst_first(detail(spark, sf_dir))


@register("O04_detail_worst_first_top20", qq("""
select query_id, abs_pct_error from detail order by abs_pct_error desc, query_id limit 20"""))
def o04(spark, sf_dir):
    return R.worst_first(detail(spark, sf_dir)).select("query_id", "abs_pct_error").limit(20)


@register("O04_detail_worst_first", qq("""
select query_id, abs_pct_error,
  row_number() over (order by abs_pct_error desc, query_id) as place from detail"""))
def o04_whole(spark, sf_dir):
    """The whole detail table in its order: the place of each row from a range sort."""
    return sorted_position(detail(spark, sf_dir).select("query_id", "abs_pct_error"), [],
                           [F.desc("abs_pct_error"), F.col("query_id").asc()], "place")


@register("K02_sla_verdicts", qq("select * from sla_out"))
def k02(spark, sf_dir):
    return R.sla_table(detail(spark, sf_dir))


@register("O05_sla_worst_first_top10", qq("""
select template_id, worst_actual_ms from sla_out order by worst_actual_ms desc, template_id
limit 10"""))
def o05(spark, sf_dir):
    return R.sla_table(detail(spark, sf_dir)).select("template_id", "worst_actual_ms").limit(10)


@register("O05_sla_worst_first", qq("""
select template_id, worst_actual_ms,
  row_number() over (order by worst_actual_ms desc, template_id) as place from sla_out"""))
def o05_whole(spark, sf_dir):
    return sorted_position(R.sla_table(detail(spark, sf_dir)).select("template_id", "worst_actual_ms"),
                           [], [F.desc("worst_actual_ms"), F.col("template_id").asc()], "place")


@register("A17_verdict_counts", qq("""
select count(*) filter (where sla_verdict = 'breach_called') as sla_breaches_called,
  count(*) filter (where sla_verdict = 'missed_breach') as sla_missed_breaches,
  count(*) filter (where sla_verdict = 'false_alarm') as sla_false_alarms,
  count(*) filter (where sla_verdict = 'inside_sla') as sla_inside from sla_out"""))
def a17(spark, sf_dir):
    s = R.sla_table(detail(spark, sf_dir))
    v = F.col("sla_verdict")
    return s.agg(F.count_if(v == "breach_called").alias("sla_breaches_called"),
                 F.count_if(v == "missed_breach").alias("sla_missed_breaches"),
                 F.count_if(v == "false_alarm").alias("sla_false_alarms"),
                 F.count_if(v == "inside_sla").alias("sla_inside"))


K03_SQL = qq("""
select cast(row_number() over (order by b) as integer) as model_sequence, model_version, trained_at,
  cast(b as integer) as batches_measured, n_train_rows, n_holdout_rows, holdout_mape_pct,
  mape_ci_low_pct, mape_ci_high_pct, holdout_r2, holdout_mae_ms, cv_mape_pct, baseline_mape_pct,
  round(baseline_mape_pct - holdout_mape_pct, 3) as mape_gain_over_baseline,
  round(holdout_mape_pct - lag(holdout_mape_pct) over (order by b), 3) as mape_change,
  case when passes_gate then 'pass' else 'fail' end as gate_status
from vmetrics""")


@register("K03_model_versions", K03_SQL)
def k03(spark, sf_dir):
    return R.model_versions(_versions(spark, sf_dir))


@register("K13_learning_curve", qq("""
select cast(b as integer) as model_sequence, baseline_mape_pct, holdout_mape_pct,
  15.0 as gate_mape_pct from vmetrics"""))
def k13(spark, sf_dir):
    return _versions(spark, sf_dir).select("model_sequence", "baseline_mape_pct",
                                           "holdout_mape_pct",
                                           F.lit(M.GATE_MAPE_PCT).alias("gate_mape_pct"))


@register("K04_run_checks", qq("""
select * from (values
  ('every measured query has a prediction', (select count(*) from
    (select query_id from qlog) m full join (select distinct query_id from detail) d
    on m.query_id = d.query_id where m.query_id is null or d.query_id is null) = 0),
  ('no prediction is zero or negative', (select count(*) from detail where predicted_ms <= 0) = 0),
  ('one prediction per query', (select count(*) - count(distinct query_id) from detail) = 0),
  ('every prediction is out of sample', (select count(*) from detail d join latest l on d.query_id = l.query_id
    where d.prediction_scope <> case when l.in_holdout = 1 then 'holdout' else 'cross_validated' end) = 0),
  ('one published model at a time', (select count(distinct model_version) from detail) <= 1),
  ('every model version is gated', (select count(*) from vmetrics) > 0)) as t(check_name, ok)"""))
def k04(spark, sf_dir):
    versions = R.model_versions(_versions(spark, sf_dir))
    return R.checks(E.feature_rows(spark, sf_dir), detail(spark, sf_dir), versions).select(F.col("check").alias("check_name"), "ok")


@register("A11_calibration_deciles_latest", qq("""
h as (select query_id, actual_ms, predicted_ms from latest where in_holdout = 1),
k as (select least(10, greatest(1, cast(floor(count(*) / 4) as bigint))) as k from h),
d as (select h.*, ntile((select k from k)) over (order by predicted_ms, query_id) as decile from h)""", """
select cast(decile as integer) as decile, cast(count(*) as integer) as queries,
  round(avg(predicted_ms), 2) as predicted_ms, round(avg(actual_ms), 2) as actual_ms,
  round(avg(abs(predicted_ms - actual_ms) / actual_ms) * 100.0, 2) as abs_pct_error
from d group by decile"""))
def a11(spark, sf_dir):
    hold = E.scored_latest(spark, sf_dir).filter(F.col("in_holdout") == 1).select(
        F.col("QUERY_ID").alias("query_id"), "actual_ms", "predicted_ms")
    return M.calibration_table(hold)


@register("A13_runtime_profile", qq("""
select min(target_ms) as runtime_min_ms, max(target_ms) as runtime_max_ms,
  round(median(target_ms), 6) as runtime_median_ms, min(machine_factor) as machine_factor_min,
  max(machine_factor) as machine_factor_max, median(5) as reps_median,
  round(avg(cast(has_prior_int as double)), 4) as seen_before_share from feat"""))
def a13(spark, sf_dir):
    return (M.runtime_profile(E.feature_rows(spark, sf_dir))
            .withColumn("reps_median", F.col("reps_median").cast("double"))
            .withColumn("runtime_median_ms", F.round("runtime_median_ms", 6)))


@register("A18_fastest_slowest", qq("""
select coalesce(round(min(target_ms), 2), 0.0) as runtime_fastest_ms,
  coalesce(round(max(target_ms), 2), 0.0) as runtime_slowest_ms from trp"""))
def a18(spark, sf_dir):
    rows = E.feature_rows(spark, sf_dir)
    return rows.agg(F.coalesce(F.round(F.min("TARGET_MS"), 2), F.lit(0.0)).alias("runtime_fastest_ms"),
                    F.coalesce(F.round(F.max("TARGET_MS"), 2), F.lit(0.0)).alias("runtime_slowest_ms"))


@register("A12_feature_envelope", qq(" union all ".join(
    f"select '{f}' as feature, round(min({f}), 6) as min, round(max({f}), 6) as max from feat"
    for f in FEATURES)))
def a12(spark, sf_dir):
    return M.feature_envelope(E.feature_rows(spark, sf_dir), FEATURES)
