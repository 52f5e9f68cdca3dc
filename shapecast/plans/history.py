"""The query log in contract layouts: QUERY_HISTORY rows, calibration rows and
training rows (history + calibrated target + prior), all derived from qlog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as SC
from ..functions import shape as S
from ..functions.text import template_label
from ..operators import calibrate as cal
from ..operators import features as fe
from ..session import stage
from . import qlog as Q

REPS = 5


def history(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """qlog as QUERY_HISTORY (75 columns in order) plus ``seq`` and ``pos``."""
    log = log if log is not None else Q.qlog(spark, sf_dir)
    text = F.col("query_text")
    filled = log.select(
        "seq", "pos",
        F.col("query_id").alias("QUERY_ID"), text.alias("QUERY_TEXT"),
        F.lit(SC.DATABASE_NAME).alias("DATABASE_NAME"), F.lit(SC.SCHEMA_NAME).alias("SCHEMA_NAME"),
        F.lit("SELECT").alias("QUERY_TYPE"), F.lit(SC.USER_NAME).alias("USER_NAME"),
        F.lit(SC.ROLE_NAME).alias("ROLE_NAME"), F.lit(SC.WAREHOUSE_NAME).alias("WAREHOUSE_NAME"),
        F.col("warehouse_size").alias("WAREHOUSE_SIZE"),
        F.lit(SC.WAREHOUSE_TYPE).alias("WAREHOUSE_TYPE"), F.lit(1).alias("CLUSTER_NUMBER"),
        F.col("query_tag").alias("QUERY_TAG"), F.lit("SUCCESS").alias("EXECUTION_STATUS"),
        F.col("execution_ms").alias("EXECUTION_TIME"),
        F.lit("FALSE").alias("IS_CLIENT_GENERATED_STATEMENT"), F.lit("ROLE").alias("ROLE_TYPE"),
        S.query_hash(text).alias("QUERY_HASH"), F.lit(SC.HASH_VERSION).alias("QUERY_HASH_VERSION"),
        S.parameterized_hash(text).alias("QUERY_PARAMETERIZED_HASH"),
        F.lit(SC.HASH_VERSION).alias("QUERY_PARAMETERIZED_HASH_VERSION"),
        F.lit("NONE").alias("SECONDARY_ROLE_STATS"), F.lit("PERSON").alias("USER_TYPE"),
        F.lit(SC.DATABASE_NAME).alias("USER_DATABASE_NAME"),
        F.lit(SC.SCHEMA_NAME).alias("USER_SCHEMA_NAME"))
    return SC.conform(filled, _WITH_ORDINALS)


_WITH_ORDINALS = T.StructType(list(SC.QUERY_HISTORY_SCHEMA.fields)
                              + [T.StructField("seq", T.LongType()),
                                 T.StructField("pos", T.LongType())])


def calibration(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """The calibration table (12 columns): repetitions summarised (A4 law:
    rep r took execution_ms * (1 + 0.01 r)), drift divided out (C1-C3)."""
    log = log if log is not None else Q.qlog(spark, sf_dir, extra=True)
    checkpoints = Q.qcal(spark, sf_dir, log)
    e = F.col("execution_ms")
    staged = log.select(
        "query_id", F.col("query_tag").alias("batch_name"), "query_tag", "pos", "template_id",
        template_label().alias("template_label"), "warehouse_size",
        F.lit(REPS).alias("reps"), e,
        F.round(e * F.lit(1.01), 3).alias("min_execution_ms"),
        F.round(e * F.lit(1.0 + 0.01 * REPS), 3).alias("max_execution_ms"))
    out = cal.calibrate(staged, checkpoints)
    return out.select(*[f.name for f in SC.CALIBRATION_SCHEMA.fields])


# The history columns later stages read (the stage table keeps only these;
# ``history`` gives the whole 75-column layout).
TRAINING_HISTORY_COLUMNS = ["QUERY_ID", "QUERY_TEXT", "WAREHOUSE_SIZE", "QUERY_TAG",
                            "QUERY_HASH", "QUERY_PARAMETERIZED_HASH", "EXECUTION_TIME",
                            "ROWS_PRODUCED", "BYTES_SCANNED", "seq", "pos"]


def training(spark: SparkSession, sf_dir: str, with_prior: bool = True) -> DataFrame:
    """History + TARGET_MS, MACHINE_FACTOR, REPS, TEMPLATE_ID, TEMPLATE_LABEL
    (+ HAS_PRIOR, PRIOR_EXECUTION_MS from earlier batches)."""
    def build():
        log = Q.qlog(spark, sf_dir, extra=True)
        hist = history(spark, sf_dir, log).select(*TRAINING_HISTORY_COLUMNS)
        rows = fe.training_rows(hist, calibration(spark, sf_dir, log))
        return fe.attach_history(rows)
    rows = stage(spark, ("training", sf_dir), build)
    return rows if with_prior else rows.drop(*fe.HISTORY_COLUMNS)
