"""The star-query family (J1, P4, P5, W1, A1-A3, O1-O3) and its knob catalogue
(J7, O8, W9).

One statement shape, seven knobs: fact ``lineitem`` joined to 0-3 dimensions
(part -> ``p_brand``, supplier -> ``s_nationkey``, nation -> ``n_name``), a
filter on a computed expression, an optional ranking window
(``row_number() over (partition by l_suppkey order by l_extendedprice desc)``),
grouped or global aggregates, ``order by amount_total desc`` and a limit.

``star_query`` declares the plan with the DataFrame API; ``star_sql`` writes the
same statement as SQL text (DuckDB and Spark SQL both run it).

Scale notes. Dimensions are joined without a broadcast hint: Spark broadcasts
a side only when its measured size is under ``autoBroadcastJoinThreshold``
(and adaptive execution re-checks after filters); a dimension above it is
joined by a shuffle. The computed filter runs right after the scan, before any
join. The ranking window is never one task per supplier: when the result only
needs the size of a rank partition (global aggregate, or groups equal to the
rank key) the rank is a combinable count; otherwise ranks come from a
range-partitioned sort (``ordinal.sorted_position``) that splits a hot supplier
over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.testdata import table
from .ordinal import sorted_position

# ---- fixed values: the dimensions in join order ------------------------------
# (table, fact-side key, dimension key, attribute carried into the result)
DIMS = [
    ("part", "l_partkey", "p_partkey", "p_brand"),
    ("supplier", "l_suppkey", "s_suppkey", "s_nationkey"),
    ("nation", "s_nationkey", "n_nationkey", "n_name"),
]
FILTER_LITERALS = [20, 150, 450, 900]
LIMITS = [0, 100, 1000]
RANK_KEY = "l_suppkey"
DISTINCT_KEY = "l_partkey"
MEASURE = "l_extendedprice"
TIE_BREAK = ["l_orderkey", "l_linenumber"]


@dataclass(frozen=True)
class StarSpec:
    n_joins: int = 0
    group_by: bool = False
    order_by: bool = False
    window: bool = False
    limit: int = 0
    literal: int = 450

    def group_columns(self) -> list[str]:
        return [d[3] for d in DIMS[: self.n_joins]] + [RANK_KEY] if self.group_by else []


def code_filter(literal: int) -> F.Column:
    """``cast(substr(cast(l_orderkey + 1000000 as string), 5, 3) as int) < k``.
    A computed predicate: it cannot prune parquet row groups, so it runs in the
    scan's whole-stage code right after the read."""
    code = F.substring((F.col("l_orderkey") + F.lit(1000000)).cast("string"), 5, 3)
    return code.cast("int") < F.lit(literal)


def filtered(spark: SparkSession, sf_dir: str, spec: StarSpec) -> DataFrame:
    """P5 + J1: the ``filtered`` CTE - dimension attributes and fact columns."""
    fact = table(spark, sf_dir, "lineitem").select(
        *TIE_BREAK, "l_partkey", "l_suppkey", MEASURE).filter(code_filter(spec.literal))
    out = fact
    for name, fkey, dkey, attr in DIMS[: spec.n_joins]:
        dim = table(spark, sf_dir, name).select(F.col(dkey), F.col(attr))
        out = out.join(dim, out[fkey] == dim[dkey], "inner").drop(dkey)
    attrs = [d[3] for d in DIMS[: spec.n_joins]]
    return out.select(*attrs, *TIE_BREAK, "l_suppkey", "l_partkey", MEASURE)


def _order_cols():
    return [F.col(MEASURE).desc(), *[F.col(c).asc() for c in TIE_BREAK]]


def ranked(spark: SparkSession, sf_dir: str, spec: StarSpec) -> DataFrame:
    """Every filtered row with its ``amount_rank`` inside its supplier."""
    return sorted_position(filtered(spark, sf_dir, spec), [RANK_KEY], _order_cols(),
                           "amount_rank")


def _measures():
    return [F.count(F.lit(1)).alias("query_rows"),
            F.sum(F.col(MEASURE).cast("decimal(18,2)")).cast("double").alias("amount_total"),
            F.countDistinct(DISTINCT_KEY).alias("products")]


def star_query(spark: SparkSession, sf_dir: str, spec: StarSpec) -> DataFrame:
    """A1-A3, O1-O3 over ``filtered``: the statement's full result."""
    rows = filtered(spark, sf_dir, spec)
    groups = spec.group_columns()
    if not spec.window:
        out = (rows.groupBy(*groups).agg(*_measures()) if groups else rows.agg(*_measures()))
    elif groups == [RANK_KEY]:
        # Groups are the rank partitions: the deepest rank is the group size.
        out = rows.groupBy(*groups).agg(*_measures(),
                                        F.count(F.lit(1)).cast("int").alias("deepest_rank"))
    elif not groups:
        # Global: the deepest rank is the size of the largest rank partition,
        # a combinable count per supplier; both sides are one row.
        deepest = (rows.groupBy(RANK_KEY).agg(F.count(F.lit(1)).alias("n"))
                   .agg(F.max("n").cast("int").alias("deepest_rank")))
        out = rows.agg(*_measures()).crossJoin(deepest)
    else:
        ranks = sorted_position(rows, [RANK_KEY], _order_cols(), "amount_rank")
        out = ranks.groupBy(*groups).agg(*_measures(),
                                         F.max("amount_rank").cast("int").alias("deepest_rank"))
    if spec.order_by:
        # Group keys break ties, so a limit keeps the same rows every run.
        out = out.orderBy(F.col("amount_total").desc(), *[F.col(g).asc() for g in groups])
    if spec.limit:
        out = out.limit(spec.limit)
    return out


def star_sql(spec: StarSpec) -> str:
    """The same statement as SQL text (runs in DuckDB and Spark SQL)."""
    attrs = [f"{d[0]}.{d[3]}" for d in DIMS[: spec.n_joins]]
    joins = []
    for i, (name, fkey, dkey, _) in enumerate(DIMS[: spec.n_joins]):
        left = "supplier" if fkey == "s_nationkey" else "l"
        joins.append(f"inner join {name} on {left}.{fkey} = {name}.{dkey}")
    cols = attrs + [f"l.{c}" for c in (*TIE_BREAK, "l_suppkey", "l_partkey", MEASURE)]
    sql = ("with filtered as (select " + ", ".join(cols) + " from lineitem as l "
           + " ".join(joins)
           + " where cast(substr(cast(l.l_orderkey + 1000000 as varchar(20)), 5, 3) as integer) < "
           + str(spec.literal) + ")")
    source = "filtered"
    if spec.window:
        sql += (", ranked as (select filtered.*, row_number() over (partition by l_suppkey "
                "order by l_extendedprice desc, l_orderkey, l_linenumber) as amount_rank "
                "from filtered)")
        source = "ranked"
    groups = [a.split(".")[1] for a in attrs] + ["l_suppkey"] if spec.group_by else []
    measures = ["count(*) as query_rows",
                "cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount_total",
                "count(distinct l_partkey) as products"]
    if spec.window:
        measures.append("cast(max(amount_rank) as integer) as deepest_rank")
    sql += " select " + ", ".join(groups + measures) + f" from {source}"
    if groups:
        sql += " group by " + ", ".join(groups)
    if spec.order_by:
        sql += " order by amount_total desc" + "".join(f", {g}" for g in groups)
    if spec.limit:
        sql += f" limit {spec.limit}"
    return sql
