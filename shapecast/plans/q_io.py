"""Registered source/sink and streaming queries (S1-S3, S5-S8, S10, S11, S13,
S15-S17, U1, U2, U4, U6, T1-T3). Each writes derived tables into a fresh
folder under the shared checkpoint folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as SC
from ..session import state_dir
from ..sources import history_io as IO
from ..sources.testdata import TABLES
from ..streaming import queue as SQ
from . import history as H
from . import qlog as Q
from .oracle import TRAIN_CTES, q
from .q_calibrate import BRACKET_CTES
from .q_report import K03_SQL as REPORT_K03_SQL
from .q_report import qq
from .registry import register


def _folder(spark, name):
    return state_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("S06_S01_history_csv_round_trip", q("""
select query_id as QUERY_ID, query_text as QUERY_TEXT, query_tag as QUERY_TAG,
  execution_ms as EXECUTION_TIME, cast(null as bigint) as BYTES_SCANNED from qlog"""))
def s06(spark, sf_dir):
    """QUERY_HISTORY layout to CSV (multi-line safe) and back with the schema."""
    path = _folder(spark, "history_csv")
    IO.write_csv(H.history(spark, sf_dir), path, SC.QUERY_HISTORY_COLUMNS)
    back = IO.read_history_csv(spark, path)
    return back.select("QUERY_ID", "QUERY_TEXT", "QUERY_TAG", "EXECUTION_TIME", "BYTES_SCANNED")


@register("S01_missing_csv_reads_empty", q("""
select query_tag as QUERY_TAG, count(*) as rows from qlog group by query_tag"""))
def s01(spark, sf_dir):
    """A written history CSV unioned with a path that does not exist (read as an
    empty table of the same schema): the counts are the written ones."""
    path = _folder(spark, "history_csv_and_absent")
    IO.write_csv(H.history(spark, sf_dir), f"{path}/present", SC.QUERY_HISTORY_COLUMNS)
    both = (IO.read_history_csv(spark, f"{path}/present")
            .unionByName(IO.read_history_csv(spark, f"{path}/absent.csv")))
    return both.groupBy("QUERY_TAG").agg(F.count(F.lit(1)).alias("rows"))


@register("S07_history_parquet_round_trip", q("""
select query_tag as QUERY_TAG, count(*) as rows,
  cast(sum(cast(execution_ms as decimal(18, 3))) as double) as total_ms from qlog
group by query_tag"""))
def s07(spark, sf_dir):
    path = _folder(spark, "history_parquet")
    IO.write_parquet(H.history(spark, sf_dir), path, partition_by=["QUERY_TAG"])
    back = spark.read.parquet(path)
    return back.groupBy("QUERY_TAG").agg(
        F.count(F.lit(1)).alias("rows"),
        # 3-decimal runtimes summed exactly: the same in any order and engine
        F.sum(F.col("EXECUTION_TIME").cast("decimal(18,3)")).cast("double").alias("total_ms"))


@register("S02_coerced_csv_read", q("""
select seq, query_id, execution_ms, pos from qlog"""))
def s02(spark, sf_dir):
    path = _folder(spark, "coerce_csv")
    IO.write_csv(Q.qlog(spark, sf_dir).select("seq", "query_id", "execution_ms", "pos"), path)
    return IO.read_csv_coerced(spark, path)


@register("S03_queue_batch_read", q("""
select query_id, template_id, warehouse_size, query_text from qlog
where query_tag = (select max(query_tag) from qlog)"""))
def s03(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    last = log.agg(F.max("query_tag").alias("__m"))
    queue = (log.crossJoin(F.broadcast(last)).filter(F.col("query_tag") == F.col("__m"))
             .select("query_id", "template_id", F.lit(None).cast("string").alias("template_label"),
                     "warehouse_size", "query_text"))
    path = _folder(spark, "queue")
    IO.write_csv(queue, path)
    return IO.read_batch(spark, path).drop("template_label")


@register("S05_S08_json_round_trip", q("""
select table_name, row_count, bytes from qtables"""))
def s05(spark, sf_dir):
    path = _folder(spark, "catalogue_json")
    IO.write_json(Q.qtables(spark, sf_dir), path)
    return IO.read_json(spark, path, "table_name string, row_count bigint, bytes bigint")


@register("S10_catalogue_row_counts", " union all ".join(
    f"select '{t.upper()}' as TABLE_NAME, count(*) as ROW_COUNT from {t}" for t in TABLES))
def s10(spark, sf_dir):
    stats = IO.catalogue_stats(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})
    return stats.select("TABLE_NAME", "ROW_COUNT")


@register("S13_catalogue_bytes_and_split_units")
def s13(spark, sf_dir):
    """Bytes on disk and split units per table (file metadata; rows-only)."""
    stats = IO.catalogue_stats(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})
    return stats.select("TABLE_NAME", "BYTES", "SPLIT_UNITS")


@register("S11_tables_layout", " union all ".join(
    f"select 'ANALYTICS' as TABLE_CATALOG, 'PUBLIC' as TABLE_SCHEMA, '{t.upper()}' as TABLE_NAME, "
    f"'SYSADMIN' as TABLE_OWNER, 'BASE TABLE' as TABLE_TYPE, count(*) as ROW_COUNT, "
    f"1 as RETENTION_TIME, 'NO' as IS_HYBRID from {t}" for t in TABLES))
def s11(spark, sf_dir):
    stats = IO.catalogue_stats(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})
    return IO.tables_layout(stats).select("TABLE_CATALOG", "TABLE_SCHEMA", "TABLE_NAME",
                                          "TABLE_OWNER", "TABLE_TYPE", "ROW_COUNT",
                                          "RETENTION_TIME", "IS_HYBRID")


@register("S15_queue_cut_in_batches_of_40", q("""
select query_id, cast(floor((row_number() over (order by seq) - 1) / 40) + 1 as integer) as batch
from qlog"""))
def s15(spark, sf_dir):
    return IO.cut_in_batches(Q.qlog(spark, sf_dir).select("query_id", "seq"), "seq").drop("seq")


@register("S17_bounded_sample_120", q("""
select query_id, execution_ms from qlog order by execution_ms desc, seq limit 120"""))
def s17(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    return IO.bounded_sample(log, [F.desc("execution_ms"), "seq"]).select(
        "query_id", "execution_ms")


@register("S16_publish_counts", q("""
select 'query_history' as table_name, count(*) as row_count from qlog
union all select 'calibration', count(*) from qlog
union all select 'tables', count(*) from qtables"""))
def s16(spark, sf_dir):
    log = Q.qlog(spark, sf_dir, extra=True)
    return IO.publish({"query_history": H.history(spark, sf_dir, log),
                       "calibration": H.calibration(spark, sf_dir, log),
                       "tables": Q.qtables(spark, sf_dir)}, _folder(spark, "published"))


@register("U01_union_of_batches", q("""
select query_tag, count(*) as rows from qlog group by query_tag"""))
def u01(spark, sf_dir):
    """One file per batch, read back as a union in load order."""
    log = Q.qlog(spark, sf_dir)
    root = _folder(spark, "batches")
    IO.write_parquet(log, root, partition_by=["query_tag"])
    return spark.read.parquet(root).groupBy("query_tag").agg(F.count(F.lit(1)).alias("rows"))


@register("U02_distinct_templates", q("""
select distinct template_id, warehouse_size from qlog"""))
def u02(spark, sf_dir):
    return Q.qlog(spark, sf_dir).select("template_id", "warehouse_size").distinct()


@register("U04_J09_measured_not_in_latest", q("""
select query_id from qlog where query_tag <> (select max(query_tag) from qlog)"""))
def u04(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    last = log.agg(F.max("query_tag").alias("__m"))
    latest = log.crossJoin(F.broadcast(last)).filter(F.col("query_tag") == F.col("__m"))
    return log.select("query_id").join(latest.select("query_id"), "query_id", "left_anti")


@register("U06_upsert_batch_twice", q("""
select query_tag as QUERY_TAG, count(*) as rows from qlog group by query_tag"""))
def u06(spark, sf_dir):
    """Write every batch, then replace the latest batch again: counts unchanged."""
    hist = H.history(spark, sf_dir)
    path = _folder(spark, "upsert")
    IO.upsert_batches(hist, path)
    last = hist.agg(F.max("QUERY_TAG").alias("__m"))
    IO.upsert_batches(hist.crossJoin(F.broadcast(last))
                      .filter(F.col("QUERY_TAG") == F.col("__m")).drop("__m"), path)
    return spark.read.parquet(path).groupBy("QUERY_TAG").agg(F.count(F.lit(1)).alias("rows"))


def _stream(spark, sf_dir, rerun=False, files=1):
    root = _folder(spark, "stream")
    SQ.write_intake(Q.qlog(spark, sf_dir), f"{root}/intake", files)
    paths = SQ.run_intake(spark, f"{root}/intake", root)
    if rerun:
        SQ.run_intake(spark, f"{root}/intake", root)   # nothing new: no change
    return spark.read.parquet(paths["history"])


@register("T01_T02_stream_pickup_and_rerun", q("""
select query_id, query_tag, execution_ms from qlog"""))
def t01(spark, sf_dir):
    """Every row of batches that come in two files each, after a run and a re-run."""
    return _stream(spark, sf_dir, rerun=True, files=2).select("query_id", "query_tag", "execution_ms")


@register("T03_streamed_target_and_prior", q(BRACKET_CTES, TRAIN_CTES, """
select query_id, target_ms as TARGET_MS, has_prior as HAS_PRIOR, prior_ms as PRIOR_EXECUTION_MS
from trp"""))
def t03(spark, sf_dir):
    return _stream(spark, sf_dir).select("query_id", "TARGET_MS", "HAS_PRIOR",
                                         "PRIOR_EXECUTION_MS")


@register("S04_table_index", q("""
select upper(table_name) as table_name, coalesce(cast(row_count as bigint), 0) as rows,
  coalesce(cast(bytes as bigint), 0) as bytes from qtables"""))
def s04(spark, sf_dir):
    from ..operators.shape import table_index
    return table_index(Q.qtables(spark, sf_dir))


@register("S12_history_layout", q("""
select query_id as QUERY_ID, 'ANALYTICS' as DATABASE_NAME, cast(null as bigint) as BYTES_SCANNED,
  cast(null as varchar) as ERROR_CODE, 1 as CLUSTER_NUMBER, 1 as QUERY_HASH_VERSION from qlog"""))
def s12(spark, sf_dir):
    """Rows conformed to the 75-column layout: filled, constant and typed-NULL columns."""
    hist = H.history(spark, sf_dir)
    assert hist.columns[:75] == SC.QUERY_HISTORY_COLUMNS
    return hist.select("QUERY_ID", "DATABASE_NAME", "BYTES_SCANNED", "ERROR_CODE",
                       "CLUSTER_NUMBER", "QUERY_HASH_VERSION")


@register("S14_pending_intake_files", q("""
select distinct query_tag as name from qlog
where query_tag > (select min(query_tag) from qlog)"""))
def s14(spark, sf_dir):
    """Intake files not yet loaded: every batch but the first (marked loaded)."""
    root = _folder(spark, "pending")
    SQ.write_intake(Q.qlog(spark, sf_dir), f"{root}/intake")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.json")
             .load(f"{root}/intake").select(
                 F.regexp_extract("path", r"query_tag=([^/]+)/", 1).alias("name")))
    loaded = files.agg(F.min("name").alias("name"))
    return files.join(loaded, "name", "left_anti").distinct()


@register("K03_streamed_model_versions", REPORT_K03_SQL)
def k03s(spark, sf_dir):
    """The learning curve built incrementally: each streamed batch trains the
    newest version and appends it; equals the curve recomputed from the log."""
    from ..operators import report as R
    root = _folder(spark, "stream_versions")
    SQ.write_intake(Q.qlog(spark, sf_dir), f"{root}/intake")
    paths = SQ.run_intake(spark, f"{root}/intake", root, catalogue=Q.qtables(spark, sf_dir))
    return R.model_versions(spark.read.parquet(paths["versions"]))


#: Columns whose cells differ in kind: numbers and empty, text and numbers, decimals and text.
_CELLS = ["mixed", "plain", "wide"]


@register("S02_cells_typed_one_by_one", q("""
select seq, kind.name as name, kind.type as type, kind.value as value from (
  select seq, unnest([
    {'name': 'mixed', 'type': case seq % 4 when 0 then 'BIGINT' when 1 then 'DOUBLE' when 2 then 'STRING' end,
     'value': case seq % 4 when 0 then cast(seq as varchar) when 1 then cast(round(execution_ms * 1000) as bigint)::varchar when 2 then query_id end},
    {'name': 'plain', 'type': 'BIGINT', 'value': cast(pos as varchar)},
    {'name': 'wide', 'type': 'STRING', 'value': warehouse_size}]) as kind from qlog) s"""))
def s02_cells(spark, sf_dir):
    """A column of integers, floats, text and blanks: every cell keeps its own type."""
    log = Q.qlog(spark, sf_dir)
    i = F.col("seq") % 4
    mixed = (F.when(i == 0, F.col("seq").cast("string")).when(i == 1, F.format_string("%.6f", F.col("execution_ms")))
             .when(i == 2, F.col("query_id")).otherwise(F.lit("")))
    path = _folder(spark, "cells_csv")
    IO.write_csv(log.select("seq", mixed.alias("mixed"), F.col("pos").alias("plain"), F.col("warehouse_size").alias("wide")), path)
    cells = IO.read_csv_cells(spark, path)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in _CELLS])).alias("c")
    seq = F.try_variant_get("seq", "$", "bigint").alias("seq")
    kind = F.when(F.col("c.v").isNotNull(), F.schema_of_variant("c.v"))
    number = F.round(F.try_variant_get("c.v", "$", "double") * 1000).cast("bigint").cast("string")
    return cells.select(seq, each).select("seq", F.col("c.name").alias("name"), kind.alias("type"),
                                          F.when(kind == "DOUBLE", number).otherwise(F.try_variant_get("c.v", "$", "string")).alias("value"))


def _published(spark, sf_dir, root):
    """The run's six tables, checked on their staged copies, as one commit."""
    from ..operators import report as R
    from ..sources import publish as P
    from . import evaluate as E
    from .q_report import _versions, detail
    log = Q.qlog(spark, sf_dir, extra=True)
    found = detail(spark, sf_dir)
    tables = {"query_history": H.history(spark, sf_dir, log).select(*SC.QUERY_HISTORY_COLUMNS),
              "tables": IO.tables_layout(Q.qtables(spark, sf_dir).select(
                  F.col("table_name").alias("TABLE_NAME"), F.col("row_count").alias("ROW_COUNT"), F.col("bytes").alias("BYTES"))),
              "calibration": H.calibration(spark, sf_dir, log), "predictions": found,
              "model_versions": R.model_versions(_versions(spark, sf_dir)), "sla": R.sla_table(found)}
    return P.publish_set(tables, root, lambda t: R.checks(t["query_history"], t["predictions"], t["model_versions"]))


@register("S16_A15_T02_published_set", qq("""
select 'query_history' as table_name, (select count(*) from qlog) as row_count
union all select 'tables', (select count(*) from qtables) union all select 'calibration', (select count(*) from qlog)
union all select 'predictions', (select count(*) from detail) union all select 'model_versions', (select count(*) from vmetrics)
union all select 'sla', (select count(*) from sla_out) union all select 'run_checks', 6"""))
def s16_set(spark, sf_dir):
    """Published twice (a re-run changes nothing): row counts that readers see."""
    from ..sources import publish as P
    root = _folder(spark, "published-set")
    _published(spark, sf_dir, root)
    _published(spark, sf_dir, root)
    return P.counts(spark, root)


@register("S16_published_predictions_and_verdicts", qq("""
select d.query_id, d.model_version, d.actual_ms, d.predicted_ms, s.sla_verdict
from detail d left join sla_out s on s.template_id = d.template_id"""))
def s16_rows(spark, sf_dir):
    """Two published tables read through the commit and joined."""
    from ..sources import publish as P
    root = _folder(spark, "published-rows")
    _published(spark, sf_dir, root)
    verdicts = P.published(spark, root, "sla").select("template_id", "sla_verdict")
    return P.published(spark, root, "predictions").join(verdicts, "template_id", "left").select(
        "query_id", "model_version", "actual_ms", "predicted_ms", "sla_verdict")


@register("T01_T03_name_order_and_late_files", q(BRACKET_CTES, TRAIN_CTES, """
select query_id, target_ms as TARGET_MS, has_prior as HAS_PRIOR, prior_ms as PRIOR_EXECUTION_MS
from trp"""))
def t01_names(spark, sf_dir):
    """Every second batch comes late: first the others, file by file in name order,
    then the late ones; targets and priors are those of the whole log."""
    root = _folder(spark, "names")
    log = Q.qlog(spark, sf_dir)
    even = F.substring("query_tag", -1, 1).cast("int") % 2 == 0
    for part in (log.filter(even), log.filter(~even)):
        SQ.write_intake(part, f"{root}/intake")
        SQ.run_in_name_order(spark, f"{root}/intake", root)
    return spark.read.parquet(SQ.folders(root)["history"]).select("query_id", "TARGET_MS", "HAS_PRIOR", "PRIOR_EXECUTION_MS")
