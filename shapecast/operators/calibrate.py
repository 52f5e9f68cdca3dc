"""Drift calibration (C1-C4, W5, W6, J6) and the repetition summary (A4).

A fixed calibration statement is timed every ``every`` positions of a batch and
once at its end. Each logged runtime is divided by the calibration reading
interpolated to its position, relative to a baseline reading.

Interpolation rule (C1), per batch, checkpoints in position order:
  * a row at the position of a checkpoint takes the first reading there;
  * a row strictly between two checkpoint positions is on the straight line
    from the last reading at the left position to the first at the right one;
  * a row outside every pair (before the first, after the last) takes the
    batch's last reading.

Scale: a batch can hold a third of the log, so nothing here is one window
partition per batch. ``bracket`` finds the closest checkpoint before or
after each row with windows inside fixed-width position blocks and a carry
from neighbouring blocks computed on the small (batch, block) table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordinal import DEFAULT_BLOCK

CALIBRATION_EVERY = 10


def checkpoint_schedule(log: DataFrame, tag: str = "query_tag", pos: str = "pos",
                        every: int = CALIBRATION_EVERY) -> DataFrame:
    """C4: positions where a reading is due: every ``every``-th row (from 0) and
    one after the last row of each batch."""
    inner = log.filter(F.col(pos) % every == 0).select(tag, pos)
    end = log.groupBy(tag).agg((F.max(pos) + 1).alias(pos))
    return inner.unionByName(end)


def readings_by_position(checkpoints: DataFrame, tag: str = "query_tag", pos: str = "pos",
                         seconds: str = "seconds", order: str | None = None) -> DataFrame:
    """One row per (batch, position): the first and the last reading there
    (``order`` is the list order of repeated readings; default: any)."""
    ordcol = F.col(order) if order else F.lit(0)
    return (checkpoints.select(tag, pos, F.struct(ordcol.alias("o"), F.col(seconds).alias("s"))
                               .alias("r"))
            .groupBy(tag, pos).agg(F.min("r")["s"].alias("first_s"),
                                   F.max("r")["s"].alias("last_s")))


def bracket(keys: DataFrame, marks: DataFrame, tag: str, pos: str, left_value: str,
            right_value: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    """For every (tag, pos) of ``keys`` the nearest mark strictly before
    (``__left`` = struct(p, v) of ``left_value``) and strictly after (``__right``,
    of ``right_value``) in the same tag; NULL where there is none.

    ``marks`` has one row per (tag, pos). Windows run per (tag, position block);
    a block without a mark on one side takes the nearest mark of the nearest
    block on that side, found on the (tag, block) table.
    """
    blk = F.floor(F.col(pos) / F.lit(block))
    lm = F.struct(F.col(pos).alias("p"), F.col(left_value).alias("v"))
    rm = F.struct(F.col(pos).alias("p"), F.col(right_value).alias("v"))
    stype = (f"struct<p:{marks.schema[pos].dataType.simpleString()},"
             f"v:{marks.schema[left_value].dataType.simpleString()}>")
    none = F.lit(None).cast(stype)
    u = (keys.select(tag, pos, F.lit(True).alias("__row"), none.alias("__lm"), none.alias("__rm"))
         .unionByName(marks.select(tag, pos, F.lit(False).alias("__row"), lm.alias("__lm"),
                                   rm.alias("__rm")))
         .withColumn("__blk", blk))
    # Both frames are "everything before me" in some order - running frames
    # that Spark updates row by row (an unbounded-following frame would be
    # re-aggregated for every row). "After me" is "before me" in descending order.
    up = W.partitionBy(tag, "__blk").orderBy(F.col(pos).asc())
    down = W.partitionBy(tag, "__blk").orderBy(F.col(pos).desc())
    inblock = (u.select(
        tag, pos, "__blk", "__row",
        F.last("__lm", ignorenulls=True).over(up.rangeBetween(W.unboundedPreceding, -1))
        .alias("__il"),
        F.last("__rm", ignorenulls=True).over(down.rangeBetween(W.unboundedPreceding, -1))
        .alias("__ir"))
        .filter("__row"))
    summary = (marks.withColumn("__blk", blk).groupBy(tag, "__blk")
               .agg(F.max(lm).alias("__bl"), F.min(rm).alias("__br")))
    bup = W.partitionBy(tag).orderBy(F.col("__blk").asc())
    bdown = W.partitionBy(tag).orderBy(F.col("__blk").desc())
    blocks = (u.select(tag, "__blk").distinct().join(summary, [tag, "__blk"], "left")
              .select(tag, "__blk",
                      F.last("__bl", ignorenulls=True)
                      .over(bup.rowsBetween(W.unboundedPreceding, -1)).alias("__cl"),
                      F.last("__br", ignorenulls=True)
                      .over(bdown.rowsBetween(W.unboundedPreceding, -1)).alias("__cr")))
    return (inblock.join(blocks, [tag, "__blk"], "left")
            .select(tag, pos, F.coalesce("__il", "__cl").alias("__left"),
                    F.coalesce("__ir", "__cr").alias("__right"))
            .dropDuplicates([tag, pos]))


def interpolate(rows: DataFrame, checkpoints: DataFrame, tag: str = "query_tag",
                pos: str = "pos", seconds: str = "seconds", order: str | None = None,
                out: str = "calibration_seconds", block: int = DEFAULT_BLOCK) -> DataFrame:
    """The calibration reading interpolated to every row's position."""
    marks = readings_by_position(checkpoints, tag, pos, seconds, order)
    found = bracket(rows.select(tag, pos), marks, tag, pos, "last_s", "first_s", block)
    exact = marks.select(tag, pos, F.col("first_s").alias("__exact"))
    # One row per batch: its last reading (the number of batches bounds it).
    last = (marks.groupBy(tag).agg(F.max(F.struct(F.col(pos), F.col("last_s")))["last_s"]
                                   .alias("__last")))
    staged = (rows.join(found, [tag, pos], "left").join(exact, [tag, pos], "left")
              .join(F.broadcast(last), tag, "left"))
    lp, lv = F.col("__left.p"), F.col("__left.v")
    rp, rv = F.col("__right.p"), F.col("__right.v")
    weight = (F.col(pos) - lp) / (rp - lp)
    value = (F.when(F.col("__exact").isNotNull(), F.col("__exact"))
             .when(F.col("__left").isNotNull() & F.col("__right").isNotNull(),
                   lv + (rv - lv) * weight)
             .otherwise(F.col("__last")))
    return staged.withColumn(out, value).drop("__left", "__right", "__exact", "__last")


def baseline_reading(checkpoints: DataFrame, tag: str = "query_tag", pos: str = "pos",
                     seconds: str = "seconds") -> DataFrame:
    """One row, the first reading of the first batch (tag order)."""
    return checkpoints.agg(F.min(F.struct(F.col(tag), F.col(pos), F.col(seconds)))[seconds]
                           .alias("baseline_seconds"))


def calibrate(rows: DataFrame, checkpoints: DataFrame, baseline: DataFrame | float | None = None,
              runtime: str = "execution_ms", tag: str = "query_tag", pos: str = "pos",
              seconds: str = "seconds", order: str | None = None) -> DataFrame:
    """calibration_ms (3 dp), machine_factor (6 dp) and
    calibrated_execution_ms (3 dp, from the unrounded factor)."""
    staged = interpolate(rows, checkpoints, tag, pos, seconds, order, "__cal")
    if baseline is None:
        baseline = baseline_reading(checkpoints, tag, pos, seconds)
    if isinstance(baseline, DataFrame):
        # One row: joined to every row without a shuffle.
        staged = staged.crossJoin(F.broadcast(baseline.select(
            F.col(baseline.columns[0]).alias("__base"))))
    else:
        staged = staged.withColumn("__base", F.lit(float(baseline)))
    factor = F.col("__cal") / F.nullif(F.col("__base"), F.lit(0.0))
    return (staged.withColumn("calibration_ms", F.round(F.col("__cal") * 1000.0, 3))
            .withColumn("machine_factor", F.round(factor, 6))
            .withColumn("calibrated_execution_ms", F.round(F.col(runtime) / factor, 3))
            .drop("__cal", "__base"))


def repetition_summary(reps: DataFrame, key: str = "query_id",
                       seconds: str = "seconds") -> DataFrame:
    """A4: reps, median, min and max of repeated timings per statement
    (combinable except the median, which Spark computes per key)."""
    return reps.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("reps"),
        F.median(seconds).alias("median_seconds"),
        F.min(seconds).alias("min_seconds"),
        F.max(seconds).alias("max_seconds"))
