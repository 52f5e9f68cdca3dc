"""Registered star queries over the whole ``lineitem`` fact (J1, A1-A3, W1, P4,
P5, O1-O3). The SQL twin of each is produced by ``star_sql`` from the same
spec, so DataFrame plan and SQL text describe one statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import star as st
from ..operators.star import StarSpec
from .registry import register

STAR_CASES = {
    "J1_star_join0_grouped": StarSpec(n_joins=0, group_by=True, literal=450),
    "J1_star_join1_grouped": StarSpec(n_joins=1, group_by=True, literal=450),
    "J1_star_join2_grouped": StarSpec(n_joins=2, group_by=True, literal=450),
    "J1_star_join3_grouped": StarSpec(n_joins=3, group_by=True, literal=450),
    "A1_star_global_aggregate": StarSpec(n_joins=2, literal=900),
    "A2_star_grouped_aggregate": StarSpec(n_joins=3, group_by=True, literal=150),
    "A3_star_window_global": StarSpec(n_joins=1, window=True, literal=900),
    "A3_star_window_by_rank_key": StarSpec(n_joins=0, group_by=True, window=True, literal=450),
    "A3_star_window_grouped": StarSpec(n_joins=2, group_by=True, window=True, literal=450),
    "O1_star_order_by": StarSpec(n_joins=1, group_by=True, order_by=True, literal=900),
    "O3_star_top_k_100": StarSpec(n_joins=3, group_by=True, order_by=True, limit=100,
                                  literal=900),
    "O3_star_top_k_1000_window": StarSpec(n_joins=1, group_by=True, order_by=True,
                                          window=True, limit=1000, literal=450),
}


def _make(spec):
    return lambda spark, sf_dir: st.star_query(spark, sf_dir, spec)


for _name, _spec in STAR_CASES.items():
    register(_name, st.star_sql(_spec))(_make(_spec))


_LIMIT_SPEC = StarSpec(n_joins=2, group_by=True, limit=100, literal=450)


@register("O2_star_limit_row_count",
          f"select count(*) as result_rows from ({st.star_sql(_LIMIT_SPEC)}) as r")
def o2(spark, sf_dir):
    """An order-free limit keeps an arbitrary 100 groups; only the count is fixed."""
    return st.star_query(spark, sf_dir, _LIMIT_SPEC).agg(F.count(F.lit(1)).alias("result_rows"))


@register("P4_computed_filter_selectivity", " union all ".join(
    f"select {k} as literal, count(*) filter (where cast(substr(cast(l_orderkey + 1000000 "
    f"as varchar(20)), 5, 3) as integer) < {k}) as kept_rows, count(*) as scanned_rows "
    f"from lineitem" for k in st.FILTER_LITERALS))
def p4(spark, sf_dir):
    """Rows kept by the computed filter for each literal, one scan for all four."""
    from ..sources.testdata import table
    li = table(spark, sf_dir, "lineitem").select("l_orderkey")
    code = F.substring((F.col("l_orderkey") + F.lit(1000000)).cast("string"), 5, 3).cast("int")
    aggs = []
    for k in st.FILTER_LITERALS:
        aggs += [F.count_if(code < F.lit(k)).alias(f"kept_{k}")]
    wide = li.agg(F.count(F.lit(1)).alias("scanned_rows"), *aggs)
    stacked = ", ".join(f"{k}, kept_{k}" for k in st.FILTER_LITERALS)
    return wide.selectExpr(f"stack({len(st.FILTER_LITERALS)}, {stacked}) as (literal, kept_rows)",
                           "scanned_rows")


_P5_SPEC = StarSpec(n_joins=3, literal=20)


@register("P5_star_filtered_projection", st.star_sql(_P5_SPEC).split(" select count(*)")[0]
          .replace("with filtered as (", "select * from (", 1) + " as f")
def p5(spark, sf_dir):
    return st.filtered(spark, sf_dir, _P5_SPEC)


_W1_SPEC = StarSpec(n_joins=0, window=True, literal=150)


@register("W1_star_ranked_rows", st.star_sql(_W1_SPEC).split(" select count(*)")[0]
          + " select l_orderkey, l_linenumber, l_suppkey, cast(amount_rank as bigint) as amount_rank"
            " from ranked")
def w1(spark, sf_dir):
    return st.ranked(spark, sf_dir, _W1_SPEC).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "amount_rank")
