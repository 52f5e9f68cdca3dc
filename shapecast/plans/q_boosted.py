"""Registered queries of the published model: boosted trees on the 13 features
(M3, M4, M9-M12, K1-K4, K11, K13, A11, A17). Trees have no SQL twin; what has to
hold whatever the trees are - rows and scopes, base scores, the first split of
every model, the baseline - is compared with SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import template_label
from ..operators import boosting as B
from ..operators import features as fe
from ..operators import metrics as M
from ..operators import report as R
from ..operators import versions as V
from ..operators.features import FEATURES
from ..operators.forecast import forecast
from ..operators.importance import permutation_importance
from ..operators.ordinal import rank_value
from ..session import stage, state_dir
from . import evaluate as E
from . import history as H
from . import qlog as Q
from .oracle import FEATURE_NAMES, _fitted
from .q_report import _versions, qq
from .q_report import detail as one_feature_detail
from .registry import register

#: Rows of every model: version b without a fold (folds 0-4), all its training rows (-1), every row of the newest (-2).
_FITS = """
fits as (select b, fold from (select unnest(range(1, (select nb from meta) + 1)) as b) v cross join (select unnest([0, 1, 2, 3, 4, -1]) as fold) f),
member as (select f.b, f.fold, v.query_id, v.y from fits f join vrows v on v.b = f.b and v.in_holdout = 0 and v.fold <> f.fold
  union all select (select nb from meta), -2, query_id, y from vrows where b = (select nb from meta))"""


@register("M03_boosted_base_scores", qq(_FITS, """
select cast(b as integer) as b, cast(fold as integer) as fold, round(avg(y), 9) as base from member group by b, fold"""))
def base_scores(spark, sf_dir):
    """Where every model starts: the mean log target of exactly its rows."""
    m = E.boosted(spark, sf_dir)
    return spark.createDataFrame([(int(b), int(f), v) for (b, f), v in m.base.items()], "b int, fold int, base double").select(
        "b", "fold", F.round("base", 9).alias("base"))


_VALUES = " union all ".join(f"select {k} as k, '{f}' as feature, query_id, {f} as v from feat" for k, f in enumerate(FEATURES))


@register("M03_boosted_first_split", qq(_FITS, f"""
fv as ({_VALUES}),
dv as (select k, v, row_number() over (partition by k order by v) as r, count(*) over (partition by k) as d
       from (select distinct k, v from fv) s),
cut as (select k, bin, max(v) as cut from (select k, v, case when d <= 64 then r - 1 else (r - 1) * 64 // d end as bin from dv) s group by k, bin),
mean as (select b, fold, avg(y) as my, count(*) as n from member group by b, fold),
per as (select m.b, m.fold, f.k, f.feature, f.v, sum(m.y - mean.my) as g, count(*) as n
  from member m join mean on mean.b = m.b and mean.fold = m.fold join fv f on f.query_id = m.query_id group by all),
lefts as (select p.b, p.fold, p.k, p.feature, c.cut, sum(p.g) as gl, sum(p.n) as nl
  from per p join cut c on c.k = p.k and p.v <= c.cut group by all),
gains as (select l.*, mean.n - nl as nr, gl * gl / nl + gl * gl / (mean.n - nl) as gain
  from lefts l join mean on mean.b = l.b and mean.fold = l.fold where nl >= 4 and mean.n - nl >= 4)""", """
select cast(b as integer) as b, cast(fold as integer) as fold, round(max(gain), 6) as gain from gains group by b, fold"""))
def first_split(spark, sf_dir):
    """The gain of the first split of every model's first tree: the best over all
    features and cuts, from histograms of cells; in SQL from the rows."""
    m = E.boosted(spark, sf_dir)
    return spark.createDataFrame([(int(b), int(f), s.gain) for (b, f), s in m.roots.items() if s], "b int, fold int, gain double").select(
        "b", "fold", F.round("gain", 6).alias("gain"))


@register("M04_M09_boosted_scopes", qq("""
select query_id, model_version, in_holdout, round(actual_ms, 3) as actual_ms, true as scored from latest"""))
def scopes(spark, sf_dir):
    """Every row of the newest version is scored once: holdout rows by the holdout
    fit, the others out of fold."""
    return E.boosted_predictions(spark, sf_dir).select("query_id", "model_version", "in_holdout", "actual_ms",
                                                       (F.col("predicted_ms") > 0).alias("scored"))


@register("M09_boosted_predictions")
def predictions(spark, sf_dir):
    return E.boosted_predictions(spark, sf_dir)


def detail(spark, sf_dir):
    return stage(spark, ("boosted_detail", sf_dir), lambda: R.prediction_detail(
        E.shape_rows(E.feature_rows(spark, sf_dir)), E.boosted_predictions(spark, sf_dir)))


@register("K01_boosted_prediction_detail")
def k01(spark, sf_dir):
    return R.worst_first(detail(spark, sf_dir))


@register("K01_boosted_detail_shapes", qq("""
select model_version, query_id, template_id, template_label, batch_name, warehouse_size, n_tables, n_joins, has_group_by,
  has_order_by, has_window, predicate_literal, table_rows, actual_ms, prediction_scope from detail"""))
def k01_shapes(spark, sf_dir):
    """All but the predicted numbers of the published detail table."""
    return detail(spark, sf_dir).drop("predicted_ms", "error_ms", "abs_pct_error")


@register("K02_boosted_sla_verdicts")
def k02(spark, sf_dir):
    return R.sla_table(detail(spark, sf_dir))


@register("K02_boosted_sla_actuals", qq("""
select template_id, template_label, queries, p50_actual_ms, worst_actual_ms,
  worst_actual_ms > 200.0 as breach from sla_out"""))
def k02_actuals(spark, sf_dir):
    """What the verdicts say of the measured side: breach_called and missed_breach are the breaches."""
    return R.sla_table(detail(spark, sf_dir)).select(
        "template_id", "template_label", "queries", "p50_actual_ms", "worst_actual_ms",
        F.col("sla_verdict").isin("breach_called", "missed_breach").alias("breach"))


@register("K03_boosted_model_versions")
def k03(spark, sf_dir):
    return R.model_versions(E.boosted_versions(spark, sf_dir))


@register("K03_K13_boosted_against_baseline", qq("""
select cast(row_number() over (order by b) as integer) as model_sequence, model_version, trained_at, n_train_rows, n_holdout_rows,
  baseline_mape_pct, 15.0 as gate_mape_pct, true as better_than_baseline from vmetrics"""))
def k13(spark, sf_dir):
    """The learning curve's fixed columns; the trees beat the straight line in every version."""
    v = R.model_versions(E.boosted_versions(spark, sf_dir))
    return v.select("model_sequence", "model_version", "trained_at", "n_train_rows", "n_holdout_rows", "baseline_mape_pct",
                    F.lit(M.GATE_MAPE_PCT).alias("gate_mape_pct"), (F.col("mape_gain_over_baseline") > 0).alias("better_than_baseline"))


@register("K04_boosted_run_checks", qq("""
select unnest(['every measured query has a prediction', 'no prediction is zero or negative', 'one prediction per query',
  'every prediction is out of sample', 'one published model at a time', 'every model version is gated']) as check_name,
  (select count(*) from qlog) = (select count(*) from latest) as ok"""))
def k04(spark, sf_dir):
    versions = R.model_versions(E.boosted_versions(spark, sf_dir))
    return R.checks(E.feature_rows(spark, sf_dir), detail(spark, sf_dir), versions).select(F.col("check").alias("check_name"), "ok")


@register("A11_boosted_calibration_deciles")
def a11(spark, sf_dir):
    hold = E.boosted_predictions(spark, sf_dir).filter("in_holdout = 1").select("query_id", "actual_ms", "predicted_ms")
    return M.calibration_table(hold)


@register("M10_M11_M12_boosted_deployed", qq("""
select query_id as QUERY_ID, true as same from feat"""))
def deployed(spark, sf_dir):
    """The deployed fit saved, loaded and scored on every row equals the fitted one."""
    m, rows = E.boosted(spark, sf_dir), E.numbered(spark, sf_dir)
    path = state_dir(spark, f"boosted-{spark.sparkContext.applicationId}")
    m.save(spark, path)
    b = V.trainable(E.state(spark, sf_dir))[-1]
    before = B.predict(rows, m, b, deployed=True).select("QUERY_ID", F.col("predicted_ms").alias("p"))
    after = B.predict(rows, B.Boosted.load(spark, path), b, deployed=True)
    return after.join(before, "QUERY_ID").select("QUERY_ID", (F.col("p") == F.col("predicted_ms")).alias("same"))


@register("M05_boosted_permutation_importance")
def importance(spark, sf_dir):
    """The trained model's importances on its holdout, 15 permutations without a sort of copies."""
    m, b = E.boosted(spark, sf_dir), V.trainable(E.state(spark, sf_dir))[-1]
    hold = E.numbered(spark, sf_dir).filter((F.col("bn") == b) if b > 1 else F.col("tail"))
    of, edges = (m.base[b, B.HOLDOUT], m.trees[b, B.HOLDOUT]), m.edges
    return permutation_importance(hold, None, boosted=(*of, lambda x: B.to_bins(x, edges))).orderBy(F.desc("importance"), "feature")


_DONORS = """
mine as (select row_number() over (order by query_id) - 1 as p, y, {own}, ({fit}) as fitted, c
  from bx join (select b as cb, c from bcoef) k on k.cb = bx.b where in_holdout = 1 and b = (select max(b) from bx)),
size as (select count(*) as n, greatest(1::ubigint, cast(ceil(length(bin(greatest(count(*) - 1, 1))) / 2.0) as ubigint)) as half from mine),
walk as (
  select p, r, 0 as step, false as done, p::ubigint as x, n, half from mine, size, range(1, 16) t(r)
  union all
  select p, r, step + 1, z < n, z, n, half from (
    select *, (l4 << half) + r4 as z from (
      select *, r3 as l4, xor(l3, {f3}) as r4 from (
        select *, r2 as l3, xor(l2, {f2}) as r3 from (
          select *, r1 as l2, xor(l1, {f1}) as r2 from (
            select *, r0 as l1, xor(l0, {f0}) as r1 from (
              select *, x >> half as l0, x & ((1::ubigint << half) - 1) as r0 from walk where not done) w0) w1) w2) w3) w4) w5),
paired as (select m.p, w.r, m.y, m.fitted, m.c, w.x as donor from walk w join mine m on m.p = w.p where w.done)"""


def _round(i: int, r: str) -> str:
    x = f"(({r} + (r::ubigint * 2654435769::ubigint + {i * 0x7F4A7C15 % 2**32}::ubigint) % 4294967296::ubigint) % 4294967296::ubigint)"
    a = f"(({x} * 2654435761::ubigint) % 4294967296::ubigint)"
    b = f"((xor({a}, {a} >> 15) * 2246822519::ubigint) % 4294967296::ubigint)"
    return f"(xor({b}, {b} >> 13) & ((1::ubigint << half) - 1))"


_OWN = ", ".join(FEATURE_NAMES)
_IMPORTANCE = " union all ".join(
    f"select '{f}' as feature, round(avg(abs(fitted + c[{i + 2}] * (o.{f} - m.{f}) - y)) - avg(abs(fitted - y)), 4) as importance "
    f"from (select paired.*, mine.{f} from paired join mine on mine.p = paired.p) m join (select p as op, {f} from mine) o on o.op = m.donor"
    for i, f in enumerate(FEATURE_NAMES))


@register("M05_least_squares_permutation_importance", qq(_DONORS.format(
    own=_OWN, fit=_fitted(FEATURE_NAMES), **{f"f{i}": _round(i, f"r{i}") for i in range(4)}), _IMPORTANCE))
def importance_linear(spark, sf_dir):
    """The baseline's importances: the same permutations, with an SQL twin."""
    b = V.trainable(E.state(spark, sf_dir))[-1]
    base = V.Linear(E.models(spark, sf_dir).filter((F.col("b") == b) & (F.col("fold") == -1)).collect())
    hold = E.numbered(spark, sf_dir).filter((F.col("bn") == b) if b > 1 else F.col("tail"))
    return permutation_importance(hold, lambda x: base.log_ms(b, -1, x))


@register("M16_grid_72_points")
def grid(spark, sf_dir):
    """All 72 points by their out-of-fold error on the batches before the newest;
    every point is grown to its last round."""
    found = B.grid_search(E.numbered(spark, sf_dir), V.trainable(E.state(spark, sf_dir))[-1], exact=True)
    rows = [(float(p["rate"]), int(p["rounds"]), int(p["leaves"]), int(p["least_rows"]), float(p["l2"]), round(e, 3)) for p, e in found]
    return spark.createDataFrame(rows, "rate double, rounds int, leaves int, least_rows int, l2 double, cv_mape_pct double")


def metrics_row(spark, sf_dir):
    """M8: the newest training run in one row, all its fields."""
    feats = E.feature_rows(spark, sf_dir)
    latest = E.boosted_versions(spark, sf_dir).orderBy(F.desc("model_sequence")).limit(1)
    facts = feats.agg(
        F.array_sort(F.collect_set("QUERY_TAG")).alias("batches"),
        F.transform(F.array_sort(F.collect_set(F.struct("warehouse_threads", "WAREHOUSE_SIZE"))), lambda s: s["WAREHOUSE_SIZE"])
        .alias("warehouse_sizes"))                                   # batches and sizes: a few
    deciles = a11(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct(
        "decile", "queries", "predicted_ms", "actual_ms", "abs_pct_error"))).alias("calibration"))
    ranked = importance(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        (-F.col("importance")).alias("order"), "feature", "importance"))), lambda s: F.struct(s["feature"], s["importance"])).alias("importances"))
    out = latest.drop("model_sequence")
    for part in (facts, M.runtime_profile(feats), deciles, ranked):
        out = out.crossJoin(F.broadcast(part))      # one-row parts
    return out.withColumns({
        "model_kind": F.lit("histogram boosted trees (log ms)"), "engine": F.lit(f"spark-{spark.version}"),
        "gate_rule": F.lit(M.GATE_RULE), "gate_mape_pct": F.lit(M.GATE_MAPE_PCT), "gate_r2": F.lit(M.GATE_R2),
        "reps_median": F.col("reps_median").cast("int")})


@register("M08_boosted_metrics_row")
def m08(spark, sf_dir):
    return stage(spark, ("boosted_metrics", sf_dir), lambda: metrics_row(spark, sf_dir))


@register("M08_boosted_metrics_fixed_fields", qq("""
select v.model_version, v.trained_at, cast(v.b as integer) as batches_measured, v.n_train_rows, v.n_holdout_rows, v.baseline_mape_pct,
  (select string_agg(query_tag, ',' order by query_tag) from (select distinct query_tag from feat) t) as batches,
  (select string_agg(warehouse_size, ',' order by threads) from (select distinct warehouse_size, threads from spec) s) as warehouse_sizes,
  'holdout MAPE <= 15% and holdout R2 >= 0.90 on log10 ms' as gate_rule, 15.0 as gate_mape_pct, 0.90e0 as gate_r2, 5 as reps_median,
  (select min(target_ms) from feat) as runtime_min_ms, (select max(target_ms) from feat) as runtime_max_ms,
  (select round(median(target_ms), 6) from feat) as runtime_median_ms, (select min(machine_factor) from feat) as machine_factor_min,
  (select max(machine_factor) from feat) as machine_factor_max,
  (select round(avg(cast(has_prior_int as double)), 4) from feat) as seen_before_share, cast(13 as integer) as features,
  cast((select least(10, greatest(1, count(*) // 4)) from latest where in_holdout = 1) as integer) as deciles
from vmetrics v where v.b = (select max(b) from vmetrics)"""))
def m08_fixed(spark, sf_dir):
    """The fields of that row that do not depend on the trees."""
    row = m08(spark, sf_dir)
    return row.select("model_version", "trained_at", "batches_measured", "n_train_rows", "n_holdout_rows", "baseline_mape_pct",
                      F.array_join("batches", ",").alias("batches"), F.array_join("warehouse_sizes", ",").alias("warehouse_sizes"),
                      "gate_rule", "gate_mape_pct", "gate_r2", "reps_median", "runtime_min_ms", "runtime_max_ms",
                      F.round("runtime_median_ms", 6).alias("runtime_median_ms"), "machine_factor_min", "machine_factor_max",
                      "seen_before_share", F.size("importances").alias("features"), F.size("calibration").alias("deciles"))


def _queue(spark, sf_dir):
    """(the newest batch as a queue, past means of the batches before it)."""
    log = Q.qlog(spark, sf_dir, extra=True)
    last = log.agg(F.max("query_tag").alias("__m"))      # one row
    queue = log.crossJoin(F.broadcast(last)).filter(F.col("query_tag") == F.col("__m")).select(
        "query_id", "template_id", template_label().alias("template_label"), "warehouse_size", "query_text")
    past = H.training(spark, sf_dir, with_prior=False).crossJoin(F.broadcast(last)).filter(F.col("QUERY_TAG") < F.col("__m"))
    return queue, fe.history_index(past)


_FORECAST = """
select s.query_id, s.template_id, s.template_label, s.warehouse_size, s.n_tables, s.n_joins, cast(s.table_rows as bigint) as table_rows,
  s.has_group_by, s.has_order_by, s.has_window, s.limit_rows, s.predicate_literal, t.has_prior as seen_before, s.query_text{more}
from labelled s join trp t on t.query_id = s.query_id where s.query_tag = (select max(query_tag) from qlog)"""


@register("M14_forecast_without_model", qq(_FORECAST.format(more="")))
def forecast_plain(spark, sf_dir):
    """The queue before there is a model: shapes and priors, no prediction."""
    queue, index = _queue(spark, sf_dir)
    return forecast(queue, index, Q.qtables(spark, sf_dir))


@register("M14_boosted_forecast", qq(_FORECAST.format(
    more=", (select model_version from vmetrics where b = (select max(b) from vmetrics)) as predicted_by, true as predicted")))
def forecast_scored(spark, sf_dir):
    """The queue scored by the trees that were fitted on the batches before it."""
    queue, index = _queue(spark, sf_dir)
    st = E.state(spark, sf_dir)
    b = V.trainable(st)[-1]
    name = V.names(st).filter(F.col("b") == b).first()["model_version"]
    out = forecast(queue, index, Q.qtables(spark, sf_dir), E.boosted(spark, sf_dir), (b, B.HOLDOUT), name)
    return out.withColumn("predicted", F.col("predicted_ms") > 0).drop("predicted_ms")


@register("K12_O07_run_log", qq("""
select v.trained_at as at, 'measure_batch' as action, 6 as passed, 0 as failed, v.trained_at as batch,
  v.trained_at || ' · ' || cast(n.n as varchar) || ' queries measured (5 reps median)' as measure,
  'model ' || v.model_version || ' · holdout MAPE ' || cast(round(v.holdout_mape_pct, 1) as varchar) || '% ['
    || cast(round(v.mape_ci_low_pct, 1) as varchar) || ', ' || cast(round(v.mape_ci_high_pct, 1) as varchar) || '] · R² '
    || cast(round(v.holdout_r2, 2) as varchar) || ' · ' || case when v.passes_gate then 'PASS' else 'FAIL' end as train,
  cast((select count(*) from qlog q where q.query_tag <= v.trained_at) as varchar) || ' predictions · checks PASS=6' as publish
from vmetrics v join (select query_tag, count(*) as n from qlog group by query_tag) n on n.query_tag = v.trained_at"""))
def run_log(spark, sf_dir):
    """The run log after a run for each batch, the last 12 kept."""
    cal = H.calibration(spark, sf_dir)
    reps = rank_value(cal, ["batch_name"], "reps", lambda n: F.floor(n / 2) + 1, "reps")
    sizes = cal.groupBy("batch_name").agg(F.count(F.lit(1)).alias("queries"))
    upto = W.orderBy("batch_name").rowsBetween(W.unboundedPreceding, 0)      # one row per batch
    measured = sizes.join(reps, "batch_name").select(
        F.col("batch_name").alias("batch"), "queries", "reps", F.sum("queries").over(upto).alias("predictions"))
    versions = R.model_versions(_versions(spark, sf_dir))
    checks = R.checks(E.feature_rows(spark, sf_dir), one_feature_detail(spark, sf_dir), versions).agg(
        F.count_if("ok").alias("p"), F.count_if(~F.col("ok")).alias("f")).first()     # one row
    return R.append_run_log(None, R.run_log_entries(measured, versions, F.lit(checks["p"]), F.lit(checks["f"])))
