"""Published tables and run checks.

``prediction_detail``  one row per scored query with the shape it came from
``sla_table``          one row per template: would the breach have been called
``model_versions``     one row per training run: the learning curve
``checks``             what the run asserts about what it wrote (K4-K9)
``summary``            one row of headline numbers (K11)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordinal import exact_percentiles

SLA_MS = 200.0

# ---- fixed values: published column orders ------------------------------------
DETAIL_COLUMNS = ["model_version", "query_id", "template_id", "template_label", "batch_name",
                  "warehouse_size", "n_tables", "n_joins", "has_group_by", "has_order_by",
                  "has_window", "predicate_literal", "table_rows", "actual_ms",
                  "predicted_ms", "error_ms", "abs_pct_error", "prediction_scope"]
SLA_COLUMNS = ["template_id", "template_label", "queries", "p50_actual_ms",
               "p50_predicted_ms", "worst_actual_ms", "worst_predicted_ms",
               "mean_abs_pct_error", "sla_verdict", "sla_ms"]
VERSION_COLUMNS = ["model_sequence", "model_version", "trained_at", "batches_measured",
                   "n_train_rows", "n_holdout_rows", "holdout_mape_pct", "mape_ci_low_pct",
                   "mape_ci_high_pct", "holdout_r2", "holdout_mae_ms", "cv_mape_pct",
                   "baseline_mape_pct", "mape_gain_over_baseline", "mape_change",
                   "gate_status"]
SHAPE_NUMERIC = ["n_tables", "n_joins", "has_group_by", "has_order_by", "has_window",
                 "predicate_literal", "table_rows"]
CHECKS = ["every measured query has a prediction", "no prediction is zero or negative",
          "one prediction per query", "every prediction is out of sample",
          "one published model at a time", "every model version is gated"]
# ---------------------------------------------------------------------------------


def prediction_detail(shapes: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions (model_version, query_id, actual_ms, predicted_ms,
    abs_pct_error, in_holdout) inner-joined to the shape rows (query_id,
    template_id, template_label, batch_name, warehouse_size, shape numbers);
    predictions without a shape are dropped. Unordered: ``worst_first`` sorts it
    where it is published."""
    s = shapes.select("query_id", "template_id", "template_label", "batch_name",
                      "warehouse_size",
                      *[F.col(c).cast("double").alias(c) for c in SHAPE_NUMERIC])
    joined = predictions.join(s, "query_id", "inner")
    return (joined.select(
        "model_version", "query_id", "template_id", "template_label", "batch_name",
        "warehouse_size", *SHAPE_NUMERIC, "actual_ms", "predicted_ms",
        F.round(F.col("predicted_ms") - F.col("actual_ms"), 3).alias("error_ms"),
        "abs_pct_error",
        F.when(F.col("in_holdout") == 1, F.lit("holdout")).otherwise(F.lit("cross_validated"))
        .alias("prediction_scope")))


def worst_first(detail: DataFrame) -> DataFrame:
    """The whole detail table, largest error first."""
    return detail.orderBy(F.desc("abs_pct_error"), "query_id")


def sla_verdict(worst_actual: F.Column, worst_predicted: F.Column, sla_ms) -> F.Column:
    """the four verdicts, strict ``>`` on the unrounded worst values."""
    actual, predicted = worst_actual > F.lit(sla_ms), worst_predicted > F.lit(sla_ms)
    return (F.when(predicted & actual, F.lit("breach_called"))
            .when(~predicted & ~actual, F.lit("inside_sla"))
            .when(actual, F.lit("missed_breach"))
            .otherwise(F.lit("false_alarm")))


def sla_table(detail: DataFrame, sla_ms: float = SLA_MS) -> DataFrame:
    """One row per template (NULL templates dropped), worst first."""
    rows = detail.filter(F.col("template_id").isNotNull())
    g = (rows.groupBy("template_id").agg(
        F.max("template_label").alias("template_label"),
        F.count("query_id").cast("int").alias("queries"),
        F.max("actual_ms").alias("__wa"), F.max("predicted_ms").alias("__wp"),
        # the errors have three decimals: an exact sum does not depend on the order
        (F.sum(F.col("abs_pct_error").cast("decimal(18,3)")).cast("double")
         / F.count("abs_pct_error")).alias("__mape"))
        # Medians by rank (a template may hold a third of the log): exact, both
        # from one range sort, without an aggregation buffer per template.
        .join(exact_percentiles(rows, ["template_id"], {"actual_ms": "__p50a",
                                                        "predicted_ms": "__p50p"}, 0.5),
              "template_id", "left"))
    return (g.select(
        "template_id", "template_label", "queries",
        F.round("__p50a", 3).alias("p50_actual_ms"), F.round("__p50p", 3).alias("p50_predicted_ms"),
        F.round("__wa", 3).alias("worst_actual_ms"), F.round("__wp", 3).alias("worst_predicted_ms"),
        F.round("__mape", 3).alias("mean_abs_pct_error"),
        sla_verdict(F.col("__wa"), F.col("__wp"), sla_ms).alias("sla_verdict"),
        F.lit(float(sla_ms)).alias("sla_ms"))
        .orderBy(F.desc("worst_actual_ms"), "template_id"))


def model_versions(history: DataFrame, order_col: str = "model_sequence") -> DataFrame:
    """Sequence from 1, gain over the baseline, change against the
    previous version (NULL first), gate text. ``history`` has one row per
    training run (a small table: the window has no partition)."""
    w = W.orderBy(order_col)
    return history.select(
        F.row_number().over(w).cast("int").alias("model_sequence"),
        "model_version", "trained_at", "batches_measured", "n_train_rows", "n_holdout_rows",
        "holdout_mape_pct", "mape_ci_low_pct", "mape_ci_high_pct", "holdout_r2",
        "holdout_mae_ms", "cv_mape_pct", "baseline_mape_pct",
        F.round(F.col("baseline_mape_pct") - F.col("holdout_mape_pct"), 3)
        .alias("mape_gain_over_baseline"),
        F.round(F.col("holdout_mape_pct") - F.lag("holdout_mape_pct").over(w), 3)
        .alias("mape_change"),
        F.when(F.col("passes_gate"), F.lit("pass")).otherwise(F.lit("fail")).alias("gate_status"))


def checks(measured: DataFrame, detail: DataFrame, versions: DataFrame,
           key: str = "QUERY_ID") -> DataFrame:
    """Six checks (check, ok, detail), one aggregate job each
    side; the set equality is a full outer join on distinct ids."""
    m_ids = measured.select(F.col(key).alias("id")).distinct()
    s_ids = detail.select(F.col("query_id").alias("id")).distinct()
    both = (m_ids.withColumn("m", F.lit(1)).join(s_ids.withColumn("s", F.lit(1)), "id", "full")
            .agg(F.count_if(F.col("m").isNotNull()).alias("n_measured"),
                 F.count_if(F.col("s").isNotNull()).alias("n_scored"),
                 F.count_if(F.col("m").isNull() | F.col("s").isNull()).alias("n_unmatched")))
    d = detail.agg(F.count_if(F.col("predicted_ms") <= 0).alias("n_nonpos"),
                   (F.count(F.lit(1)) - F.countDistinct("query_id")).alias("n_dup"),
                   F.count_if(~F.col("prediction_scope").isin("holdout", "cross_validated"))
                   .alias("n_bad_scope"),
                   F.array_sort(F.collect_set("prediction_scope")).alias("scopes"),
                   F.countDistinct("model_version").alias("n_versions_detail"))
    v = versions.agg(F.count(F.lit(1)).alias("n_versions"),
                     F.count_if(~F.col("gate_status").isin("pass", "fail")).alias("n_ungated"),
                     F.array_sort(F.collect_set("gate_status")).alias("verdicts"))
    one = both.crossJoin(d).crossJoin(v)   # three one-row aggregates
    rows = [
        (CHECKS[0], F.col("n_unmatched") == 0,
         F.format_string("%d of %d measured queries scored", F.col("n_scored"), F.col("n_measured"))),
        (CHECKS[1], F.col("n_nonpos") == 0,
         F.format_string("%d non-positive predictions", F.col("n_nonpos"))),
        (CHECKS[2], F.col("n_dup") == 0,
         F.format_string("%d duplicate query_id rows", F.col("n_dup"))),
        (CHECKS[3], F.col("n_bad_scope") == 0,
         F.concat(F.lit("scopes "), F.array_join("scopes", ", "))),
        (CHECKS[4], F.col("n_versions_detail") <= 1,
         F.format_string("%d model version(s) in the detail table", F.col("n_versions_detail"))),
        (CHECKS[5], (F.col("n_ungated") == 0) & (F.col("n_versions") > 0),
         F.format_string("%d version(s), verdicts %s", F.col("n_versions"),
                         F.array_join("verdicts", ", "))),
    ]
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"), ok.alias("ok"), text.alias("detail"))
        for name, ok, text in rows])).alias("c")).select("c.*")


def fail_on_checks(check_rows: DataFrame) -> DataFrame:
    """A failed check fails the job (raised inside the query)."""
    return check_rows.withColumn("ok", F.when(F.col("ok"), F.col("ok")).otherwise(
        F.raise_error(F.concat(F.lit("[check] failed: "), F.col("check")))))


# ---- run log (K12, O7) -----------------------------------------------------------

RUN_LOG = "at string, action string, passed int, failed int, batch string, measure string, train string, publish string"
RUNS_KEPT = 12


def run_log_entries(measured: DataFrame, versions: DataFrame, passed: F.Column, failed: F.Column) -> DataFrame:
    """What each step of a run did, one row per batch with its model version.
    ``measured``: batch, queries, reps (upper median of the batch's repetitions),
    predictions (rows the run published); ``versions``: model_versions rows."""
    v = versions.select(F.col("trained_at").alias("batch"), "model_version", "holdout_mape_pct", "mape_ci_low_pct",
                        "mape_ci_high_pct", "holdout_r2", "gate_status")
    one = lambda c, d=1: F.round(c, d).cast("string")
    measure = F.when(F.col("queries") > 0, F.concat(
        "batch", F.lit(" · "), F.col("queries").cast("string"), F.lit(" queries measured ("), F.col("reps").cast("string"),
        F.lit(" reps median)"))).otherwise(F.lit("every batch is already measured"))
    train = F.when(F.col("model_version").isNotNull(), F.concat(
        F.lit("model "), "model_version", F.lit(" · holdout MAPE "), one("holdout_mape_pct"), F.lit("% ["), one("mape_ci_low_pct"),
        F.lit(", "), one("mape_ci_high_pct"), F.lit("] · R² "), one("holdout_r2", 2), F.lit(" · "), F.upper("gate_status"))).otherwise(F.lit("no model"))
    publish = F.when(passed + failed > 0, F.concat(
        F.col("predictions").cast("string"), F.lit(" predictions · checks PASS="), passed.cast("string"))).otherwise(F.lit("nothing to publish yet"))
    return measured.join(v, "batch", "left").select(
        F.col("batch").alias("at"), F.lit("measure_batch").alias("action"), passed.cast("int").alias("passed"), failed.cast("int").alias("failed"),
        "batch", measure.alias("measure"), train.alias("train"), publish.alias("publish"))


def append_run_log(log: DataFrame | None, entry: DataFrame, keep: int = RUNS_KEPT) -> DataFrame:
    """The log with the entry's rows, its last ``keep`` runs by ``at``; a run that is logged again replaces its row."""
    both = entry if log is None else log.join(entry.select("at"), "at", "left_anti").unionByName(entry)
    return both.orderBy(F.desc("at")).limit(keep)
