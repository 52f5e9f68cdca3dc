"""Row numbers inside a group without putting a whole group in one task.

``row_number() over (partition by g order by k)`` is one window partition per
group: a group that holds a third of the table is sorted by a single task.
Both helpers below give the same numbers with bounded task sizes.

``block_position``  the order key is an integer (an arrival ordinal). Rows are
                    cut into fixed-width blocks of that integer; a small
                    ``(group, block) -> count`` table gives each block its
                    offset, and the window runs per ``(group, block)``, so no
                    window partition holds more than ``block_size`` rows.

``sorted_position`` any total order. A range-partitioned sort on
                    ``(group, order key)`` splits a hot group across many
                    tasks; the sorted rows are numbered and written to the
                    shared folder so that no number changes on recompute; the
                    least number and the count per ``(partition, group)`` give
                    the offsets, without a second sort.

NULL group keys are a group of their own, as in ``group by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize

#: Rows of a block. A block is sorted by one task, and is what a written table's
#: tasks are made of: small enough that a batch of a few hundred thousand rows is
#: many of them, large enough that the (group, block) table stays tiny.
DEFAULT_BLOCK = 1 << 16


def block_position(df: DataFrame, group_cols: list[str], ordinal: str, out: str,
                   block_size: int = DEFAULT_BLOCK, base: int = 0) -> DataFrame:
    """``row_number() over (partition by group_cols order by ordinal) - 1 + base``.

    ``ordinal`` must be a non-negative integer, unique inside a group.
    """
    blk = "__blk"
    staged = df.withColumn(blk, F.floor(F.col(ordinal) / F.lit(block_size)))
    counts = staged.groupBy(*group_cols, blk).agg(F.count(F.lit(1)).alias("__n"))
    # One row per (group, block): rows / block_size rows in all, so the window
    # below sorts a few thousand entries per group even at billions of rows.
    offsets = counts.select(
        *group_cols, blk,
        F.coalesce(F.sum("__n").over(
            W.partitionBy(*group_cols).orderBy(blk)
            .rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    local = W.partitionBy(*group_cols, blk).orderBy(ordinal)
    return (join_same(staged, offsets, [*group_cols, blk])
            .withColumn(out, (F.col("__off") + F.row_number().over(local) - 1 + base)
                        .cast("bigint"))
            .drop(blk, "__off"))


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL, as grouping does; the keys and
    columns of ``left`` stay, then the other columns of ``right``."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"__right_{k}"])
    return left.join(named, on, how).drop(*[f"__right_{k}" for k in keys])


def sorted_position(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                    out: str, partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by group_cols order by order_cols)``, from 1.

    ``order_cols`` must make the order total inside a group (end with a unique
    key), otherwise ties are numbered arbitrarily, as in SQL.
    """
    keys = [F.col(c) for c in group_cols] + list(order_cols)
    # Without a number of partitions the adaptive planner sizes them from the data.
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    # Written once: the range bounds are sampled, so a recomputed sort could
    # move rows between partitions; the written copy pins each row's number.
    ordered = materialize(dealt.sortWithinPartitions(*keys)
                          .withColumn("__id", F.monotonically_increasing_id()))
    # Rows of a group are neighbours in a partition: a row's place is its number
    # less the group's first one there, plus the rows in the partitions before.
    ordered = ordered.withColumn("__pid", F.shiftright("__id", 33))
    per_part = ordered.groupBy("__pid", *group_cols).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = W.partitionBy(*group_cols).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select("__pid", *group_cols, (
        F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__off"))
    return (join_same(ordered, offsets, ["__pid", *group_cols])
            .withColumn(out, (F.col("__id") + F.col("__off")).cast("bigint"))
            .drop("__id", "__pid", "__off"))


def exact_percentiles(df: DataFrame, group_cols: list[str], values: dict[str, str],
                      q: float) -> DataFrame:
    """The ``q`` quantile of each value column per group with linear interpolation
    (position q * (n - 1) in ascending order, as ``percentile`` / numpy), exact.

    Spark's ``percentile`` keeps a group's values in one aggregation buffer. Here
    the columns are counted by value and dealt by ranges together, and only the two
    values around the position are kept. ``values``: column -> name."""
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("w"), F.col(c).cast("double").alias("v"))
                                for i, c in enumerate(values)]))
    vals = (df.select(*group_cols, which.alias("__x"))
            .select(*group_cols, F.col("__x.w").alias("__w"), F.col("__x.v").alias("__v"))
            .filter(F.col("__v").isNotNull()))
    keys = [*group_cols, "__w"]
    # Equal values are one row with their number: a value that most rows have would
    # else be sorted by one task, as no range splits it.
    counted = vals.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    order = [*[F.col(k) for k in keys], F.col("__v")]
    ordered = materialize(counted.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()))
    parts = ordered.groupBy("__pid", *keys).agg(F.sum("__c").alias("__m"))
    group = W.partitionBy(*keys)
    before = group.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    places = parts.select("__pid", *keys, "__m", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__off"),
                          F.sum("__m").over(group).alias("__n"))
    pos = F.lit(q) * (F.col("__n") - 1)
    lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
    # only the parts that hold one of the two ranks are numbered
    places = places.filter((F.col("__off") < hi) & (F.col("__off") + F.col("__m") >= lo))
    upto = F.col("__off") + F.sum("__c").over(W.partitionBy("__pid", *keys).orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    picked = (join_same(ordered, places, ["__pid", *keys]).withColumn("__last", upto)
              .select(*keys, "__v", lo.between(F.col("__last") - F.col("__c") + 1, F.col("__last")).alias("__is_lo"),
                      hi.between(F.col("__last") - F.col("__c") + 1, F.col("__last")).alias("__is_hi"), (pos - F.floor(pos)).alias("__f"))
              .filter(F.col("__is_lo") | F.col("__is_hi")))
    g = picked.groupBy(*keys).agg(
        F.max(F.when(F.col("__is_lo"), F.col("__v"))).alias("__lo"),
        F.max(F.when(F.col("__is_hi"), F.col("__v"))).alias("__hi"),
        F.max("__f").alias("__f"))
    at = (F.lit(1.0) - F.col("__f")) * F.col("__lo") + F.col("__f") * F.col("__hi")
    return g.groupBy(*group_cols).agg(*[F.max(F.when(F.col("__w") == i, at)).alias(name)
                                        for i, name in enumerate(values.values())])


def exact_percentile(df: DataFrame, group_cols: list[str], value: str, q: float,
                     out: str) -> DataFrame:
    """``exact_percentiles`` of one column."""
    return exact_percentiles(df, group_cols, {value: out}, q)


def rank_value(df: DataFrame, group_cols: list[str], value: str, rank_of_n, out: str) -> DataFrame:
    """The value at 1-based ascending rank ``rank_of_n(n)`` per group (an exact
    order statistic, e.g. ``lambda n: floor(n / 2) + 1`` for the upper median)."""
    vals = df.select(*group_cols, F.col(value).alias("__v")).filter(F.col("__v").isNotNull())
    ranked = sorted_position(vals, group_cols, [F.col("__v").asc()], "__r")
    counts = vals.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("__n"))
    return (join_same(ranked, counts, group_cols)
            .filter(F.col("__r") == rank_of_n(F.col("__n")))
            .select(*group_cols, F.col("__v").alias(out)))
