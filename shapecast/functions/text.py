"""Text helpers: template labels (P13, F18) and a one-line preview."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " · "


def template_label(fact: Column | None = None, n_joins: Column | None = None,
                   group_by: Column | None = None, window: Column | None = None,
                   order_by: Column | None = None, limit: Column | None = None,
                   fact_rows: Column | None = None) -> Column:
    """Non-empty parts joined with ' · ' (NULL parts are skipped).

    With ``fact_rows`` the first part reads "5M rows" (F18), otherwise it is
    the fact table name. Defaults read the qlog knob columns.
    """
    fact = F.col("fact") if fact is None else fact
    n_joins = F.col("n_joins") if n_joins is None else n_joins
    group_by = F.col("gb") if group_by is None else group_by
    window = F.col("win") if window is None else window
    limit = F.col("lim") if limit is None else limit
    first = (F.concat(F.format_string("%.0f", fact_rows / F.lit(1e6)), F.lit("M rows"))
             if fact_rows is not None else fact)
    parts = [
        first,
        F.concat(n_joins.cast("string"),
                 F.when(n_joins == 1, F.lit(" join")).otherwise(F.lit(" joins"))),
        F.when(group_by == 1, F.lit("group by")).otherwise(F.lit("no group by")),
        F.when(window == 1, F.lit("window")),
    ]
    if order_by is not None:
        parts.append(F.when(order_by == 1, F.lit("order by")))
    parts.append(F.when(limit > 0, F.concat(F.lit("limit "), limit.cast("string")))
                 .otherwise(F.lit("no limit")))
    return F.concat_ws(SEPARATOR, *parts)


def preview(text: Column, width: int = 70) -> Column:
    """whitespace runs collapsed to one space, first ``width`` characters."""
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, width)
