"""The model versions of the log: feature rows, the versions' state, predictions
and metrics, each staged once per application (see ``operators/versions``).

The model with an exact SQL twin is ``ols_1d`` on one feature (log of the named
tables' rows); the baseline of every version is least squares on all 13 features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import features as fe
from ..operators import metrics as M
from ..operators import versions as V
from ..session import stage
from . import history as H
from . import qlog as Q

def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features (through the guard) joined back to target and ordinals."""
    return stage(spark, ("features", sf_dir), lambda: _feature_rows(spark, sf_dir))


def _feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.training(spark, sf_dir)
    feats = fe.featurise(rows, Q.qtables(spark, sf_dir), keys=("QUERY_ID", "QUERY_TAG"),
                         passthrough=("table_rows",))
    # (has_prior is already a feature; names resolve case-insensitively)
    extra = rows.select("QUERY_ID", "TARGET_MS", "MACHINE_FACTOR", "REPS",
                        "PRIOR_EXECUTION_MS", "EXECUTION_TIME", "TEMPLATE_ID",
                        "TEMPLATE_LABEL", "WAREHOUSE_SIZE", "seq", "pos")
    return feats.join(extra, "QUERY_ID", "inner")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.numbered(feature_rows(spark, sf_dir))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The additive state of the log's batches."""
    return stage(spark, ("state", sf_dir), lambda: V.state(numbered(spark, sf_dir)))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of every version and fold: (versions x folds) rows."""
    return stage(spark, ("models", sf_dir), lambda: V.models(state(spark, sf_dir)))


def versions(spark: SparkSession, sf_dir: str, latest_only: bool = False) -> DataFrame:
    """M8 of every version (or the newest), one row each."""
    def build():
        return version_metrics(numbered(spark, sf_dir), state(spark, sf_dir), models(spark, sf_dir), latest_only)
    return stage(spark, ("versions", sf_dir, latest_only), build)


def version_metrics(rows: DataFrame, st: DataFrame, fits: DataFrame, latest_only: bool = False) -> DataFrame:
    """M8 from numbered rows, their state and its models: the coefficients (a few
    numbers a version) go to the tasks of one pass over the rows."""
    wanted = V.trainable(st)
    known = fits.collect()
    found = V.report(rows, V.OneFeature(known), V.Linear(known), wanted[-1:] if latest_only else wanted)
    return V.metrics(found, V.names(st))


def boosted(spark: SparkSession, sf_dir: str) -> B.Boosted:
    """The boosted trees of every version and fold, fitted once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BOOSTED:
        wanted = V.trainable(state(spark, sf_dir))
        _BOOSTED[key] = B.fit(numbered(spark, sf_dir), B.model_names(wanted))
    return _BOOSTED[key]


_BOOSTED: dict = {}


def boosted_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 of every version with the trained model, against the 13-feature baseline."""
    def build():
        st = state(spark, sf_dir)
        found = V.report(numbered(spark, sf_dir), boosted(spark, sf_dir), V.Linear(models(spark, sf_dir).collect()), V.trainable(st))
        return V.metrics(found, V.names(st))
    return stage(spark, ("boosted_versions", sf_dir), build)


def boosted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: the newest version's out-of-sample predictions by the trained model."""
    def build():
        st = state(spark, sf_dir)
        b = V.trainable(st)[-1]
        name = V.names(st).filter(F.col("b") == b).select("model_version")      # one row
        return B.predict(numbered(spark, sf_dir), boosted(spark, sf_dir), b).crossJoin(F.broadcast(name)).select(
            "model_version", F.col("QUERY_ID").alias("query_id"), "in_holdout",
            F.round("actual_ms", 3).alias("actual_ms"), F.round("predicted_ms", 3).alias("predicted_ms"),
            F.round(M.ape(), 3).alias("abs_pct_error"))
    return stage(spark, ("boosted_predictions", sf_dir), build)


def version_rows(rows: DataFrame, latest_only: bool = False) -> DataFrame:
    """Per (b, row) with in_holdout: one copy of each numbered row per version
    that contains it (what M1 and M4 list; ``latest_only``: the newest version)."""
    b = F.col("nb") if latest_only else F.explode(F.sequence(F.col("bn"), F.col("nb").cast("int")))
    staged = rows.withColumn("b", b)
    hold = F.when(F.col("b") > 1, F.col("bn") == F.col("b")).otherwise(F.col("tail"))
    return staged.withColumn("in_holdout", hold.cast("int"))


def scored_versions(rows: DataFrame, fits: DataFrame, latest_only: bool = False) -> DataFrame:
    """Per (b, row): actual and predicted ms (out of fold for training rows)."""
    fits = fits.select("b", F.col("fold").alias("__fit"), "slope", "intercept")      # versions x folds: broadcast
    used = F.when(F.col("in_holdout") == 1, F.lit(-1)).otherwise(F.col("fold"))
    s = version_rows(rows, latest_only).withColumn("__fit", used).join(F.broadcast(fits), ["b", "__fit"], "left")
    return s.select("b", "QUERY_ID", "QUERY_TAG", "in_holdout", F.col("TARGET_MS").alias("actual_ms"),
                    F.exp(F.col("intercept") + F.col("slope") * F.col(V.X_FEATURE)).alias("predicted_ms"))


def scored_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, ("scored_latest", sf_dir),
                 lambda: scored_versions(numbered(spark, sf_dir), models(spark, sf_dir), latest_only=True))


def latest_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(predictions of the latest version with its model_version, feature rows)."""
    name = V.names(state(spark, sf_dir)).select("b", "model_version")
    preds = scored_latest(spark, sf_dir).join(F.broadcast(name), "b").select(
        "model_version", F.col("QUERY_ID").alias("query_id"), "in_holdout",
        F.round("actual_ms", 3).alias("actual_ms"), F.round("predicted_ms", 3).alias("predicted_ms"),
        F.round(M.ape(), 3).alias("abs_pct_error"))
    return preds, feature_rows(spark, sf_dir)


def shape_rows(feats: DataFrame) -> DataFrame:
    """Shape columns for the detail table: what the feature stage parsed out of
    each statement's text (the same parse the model saw), with the template,
    batch and size that the stage carries along. No join, no second parse."""
    return feats.select(
        F.col("QUERY_ID").alias("query_id"), F.col("TEMPLATE_ID").alias("template_id"),
        F.col("TEMPLATE_LABEL").alias("template_label"), F.col("QUERY_TAG").alias("batch_name"),
        F.col("WAREHOUSE_SIZE").alias("warehouse_size"), "n_tables", "n_joins", "has_group_by",
        "has_order_by", "has_window", "predicate_literal", "table_rows")
