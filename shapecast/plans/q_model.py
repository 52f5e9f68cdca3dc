"""Registered Spark ML queries (M2, M3, M5, M7, M10-M16) and the one-feature
OLS coefficients (M2 with a DuckDB twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import linear as L
from ..operators import metrics as M
from ..operators import model as MO
from ..session import stage, state_dir
from . import evaluate as E
from . import qlog as Q
from .oracle import FEATURE_CTES, FEATURE_NAMES, LABEL_CTES, SHAPE_CTES, TRAIN_CTES, VERSION_CTES, _fitted, q
from .q_calibrate import BRACKET_CTES
from .registry import register


def _latest_split(spark, sf_dir):
    """Feature rows with in_holdout for the latest version (M1)."""
    feats = E.feature_rows(spark, sf_dir)
    return MO.split(feats)


def _gbt_fit(spark, sf_dir):
    """(predictions, holdout model, deployed model) for boosted trees, fitted
    once per application."""
    key = ("gbt", sf_dir)
    return stage_models(spark, key, lambda: MO.fit_and_score(_latest_split(spark, sf_dir),
                                                             MO.new_gbt))


_MODELS: dict = {}


def stage_models(spark, key, build):
    full = (spark.sparkContext.applicationId,) + key
    if full not in _MODELS:
        _MODELS[full] = build()
    return _MODELS[full]


@register("M02_ols_one_feature_coefficients", q(SHAPE_CTES, BRACKET_CTES, TRAIN_CTES, FEATURE_CTES, """
select round(regr_slope(ln(target_ms), log_table_rows), 9) as slope,
       round(regr_intercept(ln(target_ms), log_table_rows), 9) as intercept from feat"""))
def m02(spark, sf_dir):
    c = MO.ols_1d_coefficients(E.feature_rows(spark, sf_dir), "log_table_rows")
    return c.select(F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"))


@register("M02_least_squares_by_version", q(SHAPE_CTES, BRACKET_CTES, TRAIN_CTES, FEATURE_CTES, LABEL_CTES, VERSION_CTES, """
select bx.b, bx.query_id as QUERY_ID, round(exp(FITTED), 3) as baseline_ms
from bx join bcoef on bcoef.b = bx.b where in_holdout = 1""".replace("FITTED", _fitted(FEATURE_NAMES))))
def m02_versions(spark, sf_dir):
    """The baseline of every version on its holdout: least squares on the 13
    features from the additive moments of the earlier batches."""
    fits = E.models(spark, sf_dir).filter("fold = -1").select("b", "coef")       # one row a version
    rows = E.numbered(spark, sf_dir).filter((F.col("bn") > 1) | F.col("tail"))
    return rows.join(F.broadcast(fits), rows["bn"] == fits["b"]).select(
        F.col("b").cast("bigint").alias("b"), "QUERY_ID", F.round(F.exp(L.fitted(F.col("coef"), fe.FEATURES)), 3).alias("baseline_ms"))


@register("M02_linear_regression_13_features")
def m02b(spark, sf_dir):
    """OLS on the 13-feature vector (Spark ML), scored out of sample."""
    preds, _, _ = MO.fit_and_score(_latest_split(spark, sf_dir), MO.new_linear)
    return preds


@register("M03_gbt_predictions")
def m03(spark, sf_dir):
    """Boosted trees on log runtime: holdout + out-of-fold predictions (M3, M4, M9)."""
    return _gbt_predictions(spark, sf_dir)


def _gbt_predictions(spark, sf_dir):
    """Every row's score, written: the metrics read it several times."""
    return stage(spark, ("gbt_predictions", sf_dir), lambda: _gbt_fit(spark, sf_dir)[0])


@register("M08_gbt_holdout_metrics")
def m08b(spark, sf_dir):
    preds = _gbt_predictions(spark, sf_dir)
    hold = preds.filter(F.col("in_holdout") == 1)
    train = preds.filter(F.col("in_holdout") == 0)
    r2 = M.r_squared(hold)
    ci = M.bootstrap_mape_ci(hold, key="QUERY_ID")
    h = hold.agg(F.round(M.mape(), 3).alias("holdout_mape_pct"),
                 F.round(M.mae(), 3).alias("holdout_mae_ms"),
                 F.count(F.lit(1)).alias("n_holdout_rows"))
    t = train.agg(F.round(M.mape(), 3).alias("cv_mape_pct"),
                  F.count(F.lit(1)).alias("n_train_rows"))
    return (h.crossJoin(t).crossJoin(r2).crossJoin(ci)
            .withColumn("passes_gate", M.passes_gate(F.col("holdout_mape_pct"), F.col("r2")))
            .withColumn("holdout_r2", F.round("r2", 4)).drop("r2"))


@register("M05_permutation_importance")
def m05(spark, sf_dir):
    """Drop in log-ms MAE per permuted feature, 15 affine permutations each."""
    _, model, _ = _gbt_fit(spark, sf_dir)
    hold = _latest_split(spark, sf_dir).filter(F.col("in_holdout") == 1)
    return MO.permutation_importance(model, hold).orderBy(F.desc("importance"), "feature")


@register("M07_minimum_rows_to_train", q("""
select count(*) >= 12 as can_train, count(*) as rows from qlog"""))
def m07(spark, sf_dir):
    rows = Q.qlog(spark, sf_dir)
    return rows.agg((F.count(F.lit(1)) >= M.MIN_ROWS_TO_TRAIN).alias("can_train"),
                    F.count(F.lit(1)).alias("rows"))


@register("M10_M11_M12_deployed_model_round_trip")
def m11(spark, sf_dir):
    """Refit on every row (M10), save and load (M11), score all rows in ms."""
    _, _, deployed = _gbt_fit(spark, sf_dir)
    path = state_dir(spark, f"model-{spark.sparkContext.applicationId}")
    MO.save_model(deployed, path)
    loaded = MO.load_model(path)
    feats = E.feature_rows(spark, sf_dir)
    return MO.score(loaded, feats).select("QUERY_ID", F.round("predicted_ms", 3)
                                          .alias("predicted_ms"))


@register("M13_M14_queue_forecast")
def m14(spark, sf_dir):
    """The latest batch scored before it runs: pre-run rows (X12), prior from
    the earlier batches (A5/J4), features, deployed model of the earlier
    batches, plus shape columns and seen_before."""
    from ..functions import shape as S
    from ..operators import shape as shape_op
    log = Q.qlog(spark, sf_dir)
    last = log.agg(F.max("query_tag").alias("__m"))
    tagged = log.crossJoin(F.broadcast(last))
    queue = tagged.filter(F.col("query_tag") == F.col("__m"))
    train_rows = E.feature_rows(spark, sf_dir).crossJoin(F.broadcast(last)) \
        .filter(F.col("QUERY_TAG") < F.col("__m")).drop("__m")
    model = MO.fit(train_rows, MO.new_gbt)
    from . import history as H
    hist = H.training(spark, sf_dir, with_prior=False).crossJoin(F.broadcast(last))
    index = fe.history_index(hist.filter(F.col("QUERY_TAG") < F.col("__m")))
    pre = queue.select(F.col("query_id").alias("QUERY_ID"), F.col("query_text").alias("QUERY_TEXT"),
                       shape_op.check_warehouse().alias("WAREHOUSE_SIZE"),
                       S.parameterized_hash(F.col("query_text")).alias("QUERY_PARAMETERIZED_HASH"))
    with_prior = fe.attach_prior(pre, index)
    feats = fe.featurise(with_prior, Q.qtables(spark, sf_dir))
    scored = MO.score(model, feats)
    return scored.join(with_prior.select("QUERY_ID", F.col("HAS_PRIOR").alias("seen_before")),
                       "QUERY_ID").select("QUERY_ID", "seen_before",
                                          F.round("predicted_ms", 2).alias("predicted_ms"),
                                          *fe.FEATURES)


@register("M15_out_of_envelope_latest_batch", q(SHAPE_CTES, BRACKET_CTES, TRAIN_CTES, FEATURE_CTES,
    "env as (select " + ", ".join(
        f"round(min({f}), 6) as {f}_lo, round(max({f}), 6) as {f}_hi" for f in fe.FEATURES)
    + " from feat where query_tag < (select max(query_tag) from qlog))",
    "select query_id as QUERY_ID, " + ", ".join(
        f"({f} < {f}_lo - 1e-5 or {f} > {f}_hi + 1e-5) as {f}_outside" for f in fe.FEATURES)
    + " from feat, env where query_tag = (select max(query_tag) from qlog)"))
def m15(spark, sf_dir):
    """Every feature of every row of the latest batch against the earlier batches."""
    feats = E.feature_rows(spark, sf_dir)
    last = feats.agg(F.max("QUERY_TAG").alias("__m"))
    tagged = feats.crossJoin(F.broadcast(last))
    env = M.feature_envelope(tagged.filter(F.col("QUERY_TAG") < F.col("__m")), fe.FEATURES)
    latest = tagged.filter(F.col("QUERY_TAG") == F.col("__m")).drop("__m")
    flagged = MO.out_of_envelope(latest, env)
    return flagged.select("QUERY_ID", *[F.array_contains("outside", f).alias(f"{f}_outside")
                                        for f in fe.FEATURES])


@register("M16_grid_search_cv_mape")
def m16(spark, sf_dir):
    """A small grid scored by 5-fold MAPE on the training batches only."""
    return MO.grid_search(_latest_split(spark, sf_dir),
                          grid={"max_depth": [2, 3], "step": [0.12, 0.3]})
