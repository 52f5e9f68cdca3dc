"""Registered shape queries over the whole query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shape as S
from ..operators import shape as op
from . import qlog as Q
from .oracle import SHAPE_CTES, q
from .registry import register


def _shaped(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    return op.shape(log, Q.qtables(spark, sf_dir))


@register("X01_comment_free_text", q(SHAPE_CTES, """
select query_id, cast(length(t) as integer) as clean_chars,
       cast(length(query_text) - length(t) as integer) as removed_chars from cleaned"""))
def x01(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    t = S.clean(F.col("query_text"))
    return log.select("query_id", F.length(t).alias("clean_chars"),
                      (F.length("query_text") - F.length(t)).alias("removed_chars"))


@register("X02_cte_names", q(SHAPE_CTES, """
select query_id, array_to_string(ctes, ',') as ctes, cast(len(ctes) as integer) as n_ctes
from parsed"""))
def x02(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    c = S.ctes(S.clean(F.col("query_text")))
    return log.select("query_id", F.array_join(c, ",").alias("ctes"),
                      F.size(c).alias("n_ctes"))


@register("X03_tables", q(SHAPE_CTES, """
select query_id, array_to_string(tables, ',') as tables from shaped"""))
def x03(spark, sf_dir):
    log = op.with_shape(Q.qlog(spark, sf_dir))
    return log.select("query_id", F.array_join("tables", ",").alias("tables"))


@register("X04_table_and_join_counts", q(SHAPE_CTES, """
select query_id, n_tables, n_joins from sized"""))
def x04(spark, sf_dir):
    return op.with_shape(Q.qlog(spark, sf_dir)).select("query_id", "n_tables", "n_joins")


@register("X05_clause_flags", q(SHAPE_CTES, """
select query_id, has_group_by, has_order_by, has_window from shaped"""))
def x05(spark, sf_dir):
    return op.with_shape(Q.qlog(spark, sf_dir)).select(
        "query_id", "has_group_by", "has_order_by", "has_window")


@register("X06_limit_rows", q(SHAPE_CTES, """
select query_id, limit_rows from shaped"""))
def x06(spark, sf_dir):
    return op.with_shape(Q.qlog(spark, sf_dir)).select("query_id", "limit_rows")


@register("X07_where_clauses", q(SHAPE_CTES, """
select query_id, cast(len(clauses) as integer) as n_clauses,
       trim(array_to_string(clauses, ' | ')) as where_text from parsed"""))
def x07(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    w = S.where_clauses(S.clean(F.col("query_text")))
    return log.select("query_id", F.size(w).alias("n_clauses"),
                      F.trim(F.array_join(w, " | ")).alias("where_text"))


@register("X08_predicate_count", q(SHAPE_CTES, """
select query_id, n_predicates from shaped"""))
def x08(spark, sf_dir):
    return op.with_shape(Q.qlog(spark, sf_dir)).select("query_id", "n_predicates")


@register("X09_predicate_literal", q(SHAPE_CTES, """
select query_id, predicate_literal from shaped"""))
def x09(spark, sf_dir):
    return op.with_shape(Q.qlog(spark, sf_dir)).select("query_id", "predicate_literal")


@register("X10_query_hash", q("""
select query_id, substr(sha256(query_text), 1, 32) as query_hash from qlog"""))
def x10(spark, sf_dir):
    return Q.qlog(spark, sf_dir).select(
        "query_id", S.query_hash(F.col("query_text")).alias("query_hash"))


@register("X11_parameterized_hash", q("""
select query_id,
  substr(sha256(regexp_replace(query_text, '''[^'']*''|\\b\\d+(?:\\.\\d+)?\\b', '?', 'g')), 1, 32)
    as parameterized_hash
from qlog"""))
def x11(spark, sf_dir):
    return Q.qlog(spark, sf_dir).select(
        "query_id", S.parameterized_hash(F.col("query_text")).alias("parameterized_hash"))


@register("X11b_shapes_per_parameterized_hash", q("""
hashed as (select template_id,
  substr(sha256(regexp_replace(query_text, '''[^'']*''|\\b\\d+(?:\\.\\d+)?\\b', '?', 'g')), 1, 32) as h
  from qlog)""", """
select h as parameterized_hash, count(*) as queries, count(distinct template_id) as templates
from hashed group by h"""))
def x11b(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    return (log.select("template_id",
                       S.parameterized_hash(F.col("query_text")).alias("parameterized_hash"))
            .groupBy("parameterized_hash")
            .agg(F.count(F.lit(1)).alias("queries"),
                 F.countDistinct("template_id").alias("templates")))


@register("X12_pre_run_rows", q("""
select query_id, warehouse_size as WAREHOUSE_SIZE,
  substr(sha256(regexp_replace(query_text, '''[^'']*''|\\b\\d+(?:\\.\\d+)?\\b', '?', 'g')), 1, 32)
    as QUERY_PARAMETERIZED_HASH
from qlog"""))
def x12(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    return log.select("query_id", op.check_warehouse().alias("WAREHOUSE_SIZE"),
                      S.parameterized_hash(F.col("query_text"))
                      .alias("QUERY_PARAMETERIZED_HASH"))


@register("X13_shape_table", q(SHAPE_CTES, """
select query_id, template_id, query_tag as batch_name, warehouse_size,
  cast(n_tables as double) as n_tables, cast(n_joins as double) as n_joins,
  cast(has_group_by as double) as has_group_by, cast(has_order_by as double) as has_order_by,
  cast(has_window as double) as has_window, predicate_literal,
  cast(table_rows as double) as table_rows
from sized"""))
def x13(spark, sf_dir):
    s = _shaped(spark, sf_dir)
    return s.select("query_id", "template_id", F.col("query_tag").alias("batch_name"),
                    "warehouse_size",
                    *[F.col(c).cast("double").alias(c) for c in
                      ("n_tables", "n_joins", "has_group_by", "has_order_by", "has_window")],
                    "predicate_literal", F.col("table_rows").cast("double").alias("table_rows"))


@register("X14_table_sizes", q(SHAPE_CTES, """
select query_id, cast(table_rows as bigint) as table_rows, cast(table_bytes as bigint) as table_bytes,
  tables_known, warehouse_threads from sized"""))
def x14(spark, sf_dir):
    return _shaped(spark, sf_dir).select("query_id", "table_rows", "table_bytes",
                                         "tables_known", "warehouse_threads")


@register("X14b_table_sizes_by_join", q(SHAPE_CTES, """
select query_id, cast(table_rows as bigint) as table_rows, cast(table_bytes as bigint) as table_bytes,
  tables_known from sized"""))
def x14b(spark, sf_dir):
    """X14, shuffle-join form (the path taken for a catalogue too big to broadcast)."""
    parsed = op.with_shape(Q.qlog(spark, sf_dir))
    return op.with_table_sizes(parsed, Q.qtables(spark, sf_dir)).select(
        "query_id", "table_rows", "table_bytes", "tables_known")


@register("X15_estimated_bytes_scanned", q(SHAPE_CTES, """
select query_id, cast(nullif(table_bytes, 0) as bigint) as BYTES_SCANNED from sized"""))
def x15(spark, sf_dir):
    return _shaped(spark, sf_dir).select(
        "query_id", op.estimated_bytes_scanned().alias("BYTES_SCANNED"))


@register("X16_statement_text", q("""
select query_id, query_text from qlog"""))
def x16(spark, sf_dir):
    return Q.qlog(spark, sf_dir).select("query_id", "query_text")


@register("P07_warehouse_threads", q("""
select query_id, case warehouse_size when 'X-Small' then 1 when 'Small' then 2
  when 'Medium' then 4 else 0 end as warehouse_threads from qlog"""))
def p07(spark, sf_dir):
    return Q.qlog(spark, sf_dir).select("query_id",
                                        op.warehouse_threads().alias("warehouse_threads"))


@register("P13_template_label", q("""
labels as (select distinct concat('t', lpad(cast(tmpl + 1 as varchar(10)), 2, '0')) as template_id,
  concat_ws(' · ', fact,
    cast(n_joins as varchar) || case when n_joins = 1 then ' join' else ' joins' end,
    case when gb = 1 then 'group by' else 'no group by' end,
    case when win = 1 then 'window' end,
    case when lim > 0 then 'limit ' || cast(lim as varchar) else 'no limit' end) as template_label
  from spec)""", """
select template_id, template_label from labels"""))
def p13(spark, sf_dir):
    from ..functions.text import template_label
    log = Q.qlog(spark, sf_dir, extra=True)
    return log.select("template_id", template_label().alias("template_label")).distinct()


@register("F17_text_preview", q("""
select query_id, substr(regexp_replace(query_text, '\\s+', ' ', 'g'), 1, 70) as preview from qlog"""))
def f17(spark, sf_dir):
    from ..functions.text import preview
    return Q.qlog(spark, sf_dir).select("query_id", preview(F.col("query_text")).alias("preview"))
