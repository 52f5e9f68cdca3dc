"""Registered summary and small-report queries (K10-K12, O7, O9, P11, P12,
A16, A19, F9, F10, F18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import template_label
from ..operators import report as R
from ..sources.testdata import table
from . import evaluate as E
from . import qlog as Q
from .q_report import _versions, detail, qq
from .oracle import q
from .registry import register


@register("P11_high_error_flag", qq("""
select query_id, abs_pct_error >= 30 as high_error from detail"""))
def p11(spark, sf_dir):
    return detail(spark, sf_dir).select("query_id", (F.col("abs_pct_error") >= 30)
                                        .alias("high_error"))


@register("P12_positive_pairs", qq("""
select count(*) as plotted from detail where actual_ms > 0 and predicted_ms > 0"""))
def p12(spark, sf_dir):
    d = detail(spark, sf_dir)
    return d.filter((F.col("actual_ms") > 0) & (F.col("predicted_ms") > 0)).agg(
        F.count(F.lit(1)).alias("plotted"))


@register("K10_checks_gate_the_run", qq("""
select cast((((select count(*) from (select query_id from qlog) m full join (select distinct query_id from detail) d
    on m.query_id = d.query_id where m.query_id is null or d.query_id is null) = 0)::int
  + ((select count(*) from detail where predicted_ms <= 0) = 0)::int
  + ((select count(*) - count(distinct query_id) from detail) = 0)::int
  + ((select count(*) from detail d join latest l on d.query_id = l.query_id where d.prediction_scope
      <> case when l.in_holdout = 1 then 'holdout' else 'cross_validated' end) = 0)::int
  + ((select count(distinct model_version) from detail) <= 1)::int
  + ((select count(*) from vmetrics) > 0)::int) as integer) as checks_passed"""))
def k10(spark, sf_dir):
    """The checks with a failure raised inside the job (K10); all pass here."""
    gated = R.fail_on_checks(R.checks(E.feature_rows(spark, sf_dir), detail(spark, sf_dir),
                                      R.model_versions(_versions(spark, sf_dir))))
    return gated.agg(F.count_if("ok").cast("int").alias("checks_passed"))


@register("K11_summary", qq("""
select (select count(*) from qlog) as queries_measured,
  (select count(distinct template_id) from qlog) as templates,
  (select count(*) from qtables) as warehouse_tables,
  (select count(*) from vmetrics) as models_trained,
  (select model_version from vmetrics where b = (select max(b) from vmetrics)) as model_version,
  (select holdout_mape_pct from vmetrics where b = (select max(b) from vmetrics)) as holdout_mape_pct,
  (select passes_gate from vmetrics where b = (select max(b) from vmetrics)) as passes_gate,
  (select count(*) from sla_out where sla_verdict = 'breach_called') as sla_breaches_called,
  (select count(*) from sla_out where sla_verdict = 'missed_breach') as sla_missed_breaches,
  (select coalesce(round(min(target_ms), 2), 0.0) from trp) as runtime_fastest_ms,
  (select coalesce(round(max(target_ms), 2), 0.0) from trp) as runtime_slowest_ms"""))
def k11(spark, sf_dir):
    """One row of headline numbers from the published tables."""
    log = Q.qlog(spark, sf_dir)
    feats = E.feature_rows(spark, sf_dir)
    versions = _versions(spark, sf_dir)
    latest = versions.orderBy(F.desc("model_sequence")).limit(1).select(
        "model_version", "holdout_mape_pct", "passes_gate")
    sla = R.sla_table(detail(spark, sf_dir))
    parts = [
        log.agg(F.count(F.lit(1)).alias("queries_measured"),
                F.countDistinct("template_id").alias("templates")),
        Q.qtables(spark, sf_dir).agg(F.count(F.lit(1)).alias("warehouse_tables")),
        versions.agg(F.count(F.lit(1)).alias("models_trained")),
        latest,
        sla.agg(F.count_if(F.col("sla_verdict") == "breach_called").alias("sla_breaches_called"),
                F.count_if(F.col("sla_verdict") == "missed_breach").alias("sla_missed_breaches")),
        feats.agg(F.coalesce(F.round(F.min("TARGET_MS"), 2), F.lit(0.0)).alias("runtime_fastest_ms"),
                  F.coalesce(F.round(F.max("TARGET_MS"), 2), F.lit(0.0)).alias("runtime_slowest_ms")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)      # one-row parts
    return out


_ENTRY_SQL = """
entries as (select query_tag as batch, count(*) as n,
  (select count(*) from qlog) as total from qlog group by query_tag)"""


@register("K12_run_log_entries", q(_ENTRY_SQL, """
select batch, batch || ' · ' || cast(n as varchar) || ' queries measured (5 reps median)' as measure
from entries"""))
def k12(spark, sf_dir):
    """One run-log line per measured batch (the measure step's text)."""
    log = Q.qlog(spark, sf_dir)
    per = log.groupBy(F.col("query_tag").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("batch", F.concat(F.col("batch"), F.lit(" · "), F.col("n").cast("string"),
                                        F.lit(" queries measured (5 reps median)")).alias("measure"))


@register("O07_run_log_keeps_last_12", q(_ENTRY_SQL, """
select batch from entries order by batch desc limit 12"""))
def o07(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    per = log.groupBy(F.col("query_tag").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return per.orderBy(F.desc("batch")).limit(12).select("batch")


@register("O09_sizes_in_thread_order", q("""
select string_agg(warehouse_size, ',' order by threads) as warehouse_sizes
from (select distinct warehouse_size, threads from spec) s"""))
def o09(spark, sf_dir):
    log = Q.qlog(spark, sf_dir, extra=True)
    sizes = log.select(F.struct("threads", "warehouse_size").alias("s")).distinct()
    return sizes.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")),
                                              lambda x: x["warehouse_size"]), ",")
                     .alias("warehouse_sizes"))


@register("A16_distinct_counts", q("""
select count(distinct template_id) as templates, count(distinct query_tag) as batches,
  (select count(*) from qtables) as tables, count(distinct warehouse_size) as sizes from qlog"""))
def a16(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    return log.agg(F.countDistinct("template_id").alias("templates"),
                   F.countDistinct("query_tag").alias("batches")).crossJoin(
        Q.qtables(spark, sf_dir).agg(F.count(F.lit(1)).alias("tables"))).crossJoin(
        log.agg(F.countDistinct("warehouse_size").alias("sizes"))).select(
        "templates", "batches", "tables", "sizes")


@register("A19_upper_median_runtime_per_batch", q("""
select query_tag, execution_ms as upper_median_ms from (
  select query_tag, execution_ms,
    row_number() over (partition by query_tag order by execution_ms, seq) - 1 as i,
    count(*) over (partition by query_tag) as n from qlog) s
where i = n // 2"""))
def a19(spark, sf_dir):
    """sorted(values)[n // 2] per batch: the upper median, an exact order
    statistic taken by rank (a batch may be a third of the log)."""
    from ..operators.ordinal import rank_value
    log = Q.qlog(spark, sf_dir)
    return rank_value(log, ["query_tag"], "execution_ms", lambda n: F.floor(n / 2) + 1,
                      "upper_median_ms")


@register("F09_F10_start_and_end_times", q("""
select l.query_id,
  strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%g') as start_time,
  strftime(e.ts + to_milliseconds(cast(round(l.execution_ms) as bigint)),
           '%Y-%m-%dT%H:%M:%S.%g') as end_time
from qlog l join events e on e.event_id = l.seq"""))
def f09(spark, sf_dir):
    """START_TIME = the event time, END_TIME = start + runtime (ms), ISO text."""
    log = Q.qlog(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts")
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSS"
    joined = log.join(ev, "seq")
    end = F.timestamp_add("MILLISECOND", F.round("execution_ms").cast("bigint"), F.col("ts"))
    return joined.select("query_id", F.date_format("ts", fmt).alias("start_time"),
                         F.date_format(end, fmt).alias("end_time"))


@register("F18_fact_size_labels", q("""
select distinct concat(cast(c.row_count as varchar), ' rows · ', concat_ws(' · ', sp.fact,
    cast(sp.n_joins as varchar) || case when sp.n_joins = 1 then ' join' else ' joins' end,
    case when sp.gb = 1 then 'group by' else 'no group by' end,
    case when sp.win = 1 then 'window' end,
    case when sp.lim > 0 then 'limit ' || cast(sp.lim as varchar) else 'no limit' end)) as label
from spec sp join qtables c on c.table_name = upper(sp.fact)"""))
def f18(spark, sf_dir):
    """Template labels led by the fact table's size (rows from the catalogue)."""
    log = Q.qlog(spark, sf_dir, extra=True)
    cat = Q.qtables(spark, sf_dir)
    joined = log.join(F.broadcast(cat), F.upper("fact") == cat["table_name"])   # 7 rows
    return joined.select(F.concat(F.col("row_count").cast("string"), F.lit(" rows · "),
                                  template_label()).alias("label")).distinct()
