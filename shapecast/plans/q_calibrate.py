"""Registered calibration queries over the whole log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate as cal
from ..operators.ordinal import block_position, sorted_position
from . import qlog as Q
from .oracle import q
from .registry import register

# DuckDB: nearest checkpoints by correlated lookups (a different formulation
# from the block windows of the DataFrame plan).
BRACKET_CTES = """
br as (
  select l.query_id, l.query_tag, l.pos, l.execution_ms,
    (select c.seconds from qcal c where c.query_tag = l.query_tag and c.pos = l.pos) as exact_s,
    (select max(c.pos) from qcal c where c.query_tag = l.query_tag and c.pos < l.pos) as lp,
    (select min(c.pos) from qcal c where c.query_tag = l.query_tag and c.pos > l.pos) as rp
  from qlog l),
lastr as (select query_tag, arg_max(seconds, pos) as last_s from qcal group by query_tag),
base as (select arg_min(seconds, query_tag || lpad(cast(pos as varchar), 12, '0')) as b from qcal),
interp as (
  select br.*, cl.seconds as ls, cr.seconds as rs,
    coalesce(br.exact_s,
             case when br.lp is not null and br.rp is not null
                  then cl.seconds + (cr.seconds - cl.seconds) * ((br.pos - br.lp) / (br.rp - br.lp)) end,
             lastr.last_s) as cal_s
  from br left join qcal cl on cl.query_tag = br.query_tag and cl.pos = br.lp
          left join qcal cr on cr.query_tag = br.query_tag and cr.pos = br.rp
          join lastr on lastr.query_tag = br.query_tag)"""


@register("W05_position_in_batch", q("""
select query_id, query_tag, cast(pos as bigint) as pos from qlog"""))
def w05(spark, sf_dir):
    return Q.qlog(spark, sf_dir).select("query_id", "query_tag", "pos")


@register("C04_checkpoint_schedule", q("""
select query_tag, cast(pos as bigint) as pos from qlog where pos % 10 = 0
union all
select query_tag, cast(max(pos) + 1 as bigint) as pos from qlog group by query_tag"""))
def c04(spark, sf_dir):
    return cal.checkpoint_schedule(Q.qlog(spark, sf_dir))


@register("W06_bracketing_checkpoints", q(BRACKET_CTES, """
select query_id, cast(lp as bigint) as left_pos, cast(rp as bigint) as right_pos,
       ls as left_seconds, rs as right_seconds from interp"""))
def w06(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    marks = cal.readings_by_position(Q.qcal(spark, sf_dir, log))
    found = cal.bracket(log.select("query_tag", "pos"), marks, "query_tag", "pos",
                        "last_s", "first_s")
    return log.join(found, ["query_tag", "pos"], "left").select(
        "query_id", F.col("__left.p").alias("left_pos"), F.col("__right.p").alias("right_pos"),
        F.col("__left.v").alias("left_seconds"), F.col("__right.v").alias("right_seconds"))


@register("J06_checkpoint_interval_lookup_small_blocks", q(BRACKET_CTES, """
select query_id, cast(lp as bigint) as left_pos, cast(rp as bigint) as right_pos from interp"""))
def j06(spark, sf_dir):
    """The same lookup with 7-position blocks: most rows take their
    neighbours from the cross-block carry, which this exercises."""
    log = Q.qlog(spark, sf_dir)
    marks = cal.readings_by_position(Q.qcal(spark, sf_dir, log))
    found = cal.bracket(log.select("query_tag", "pos"), marks, "query_tag", "pos",
                        "last_s", "first_s", block=7)
    return log.join(found, ["query_tag", "pos"], "left").select(
        "query_id", F.col("__left.p").alias("left_pos"), F.col("__right.p").alias("right_pos"))


@register("C01_interpolated_calibration", q(BRACKET_CTES, """
select query_id, cal_s as calibration_seconds from interp"""))
def c01(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    return cal.interpolate(log, Q.qcal(spark, sf_dir, log)).select(
        "query_id", "calibration_seconds")


@register("C02_calibrated_runtime", q(BRACKET_CTES, """
select query_id, round(cal_s * 1000.0, 3) as calibration_ms,
       round(cal_s / b, 6) as machine_factor,
       round(execution_ms / (cal_s / b), 3) as calibrated_execution_ms
from interp, base"""))
def c02(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    return cal.calibrate(log, Q.qcal(spark, sf_dir, log)).select(
        "query_id", "calibration_ms", "machine_factor", "calibrated_execution_ms")


@register("C03_baseline_reading", q("""
select arg_min(seconds, query_tag || lpad(cast(pos as varchar), 12, '0')) as baseline_seconds
from qcal"""))
def c03(spark, sf_dir):
    return cal.baseline_reading(Q.qcal(spark, sf_dir))


@register("A04_repetition_summary", q("""
reps as (select query_id, execution_ms * (1 + 0.01 * r) / 1000.0 as seconds
         from qlog, range(1, 6) as t(r))""", """
select query_id, cast(count(*) as integer) as reps, round(median(seconds), 9) as median_seconds,
       round(min(seconds), 9) as min_seconds, round(max(seconds), 9) as max_seconds
from reps group by query_id"""))
def a04(spark, sf_dir):
    log = Q.qlog(spark, sf_dir)
    reps = log.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("r"),
                      "execution_ms").select(
        "query_id", (F.col("execution_ms") * (F.lit(1) + F.lit(0.01) * F.col("r"))
                     / F.lit(1000.0)).alias("seconds"))
    out = cal.repetition_summary(reps)
    # 0.01 is an exact decimal in one engine and a double in the other: the
    # published seconds are rounded to 9 decimals on both sides.
    return out.select("query_id", "reps", *[F.round(c, 9).alias(c) for c in
                                           ("median_seconds", "min_seconds", "max_seconds")])


@register("W05_positions_with_null_tags", q("""
select query_id, tag, row_number() over (partition by tag order by seq) - 1 as pos,
  row_number() over (partition by tag order by execution_ms, query_id) as by_runtime
from (select *, case when seq % 5 = 0 then null else query_tag end as tag from qlog)"""))
def w05_null(spark, sf_dir):
    """A fifth of the log without a tag: those rows are a group of their own."""
    log = Q.qlog(spark, sf_dir).select(
        "query_id", "seq", "execution_ms", F.when(F.col("seq") % 5 != 0, F.col("query_tag")).alias("tag"))
    placed = block_position(log, ["tag"], "seq", "pos", block_size=1000)
    return sorted_position(placed, ["tag"], [F.col("execution_ms").asc(), F.col("query_id").asc()],
                           "by_runtime").select("query_id", "tag", "pos", "by_runtime")
