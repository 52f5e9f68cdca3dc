"""Shape extraction over a table of statements.

``with_shape`` adds the parsed columns to any DataFrame that carries a SQL text
column; ``with_table_sizes`` looks the named tables up in a catalogue
(ACCOUNT_USAGE.TABLES layout, or any ``table_name, row_count, bytes`` table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shape as S
from ..schemas import WAREHOUSE_SIZES

SHAPE_COLUMNS = ["tables", "n_tables", "n_joins", "has_group_by", "has_order_by",
                 "has_window", "limit_rows", "n_predicates", "predicate_literal"]


def with_shape(df: DataFrame, text_col: str = "query_text", prefix: str = "") -> DataFrame:
    """Add X1-X9 columns. The comment-free text is computed once per row."""
    tmp = "__clean_text"
    staged = df.withColumn(tmp, S.clean(F.col(text_col)))
    t = F.col(tmp)
    tabs = S.tables(t)
    staged = staged.withColumn(prefix + "tables", tabs).withColumn(
        "__clauses", S.where_clauses(t))
    clauses = F.col("__clauses")
    return staged.select(
        *df.columns,
        F.col(prefix + "tables"),
        F.size(prefix + "tables").alias(prefix + "n_tables"),
        S.n_joins(t).alias(prefix + "n_joins"),
        S.flag(t, S.GROUP_BY_RE).alias(prefix + "has_group_by"),
        S.flag(t, S.ORDER_BY_RE).alias(prefix + "has_order_by"),
        S.flag(t, S.WINDOW_RE).alias(prefix + "has_window"),
        S.limit_rows(t).alias(prefix + "limit_rows"),
        S.n_predicates(clauses).alias(prefix + "n_predicates"),
        S.predicate_literal(clauses).alias(prefix + "predicate_literal"))


def table_index(tables: DataFrame) -> DataFrame:
    """TABLES rows to (table_name upper-case, rows, bytes); blank -> 0. A name
    listed more than once (in several schemas, say) keeps its last row in the
    order of LAST_ALTERED (where the column is there), rows, bytes."""
    cols = {c.lower(): c for c in tables.columns}
    name = F.col(cols.get("table_name"))
    rows = F.col(cols.get("row_count", cols.get("rows", "row_count")))
    size = F.col(cols.get("bytes"))
    number = lambda c: F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit(""))
                                  .try_cast("bigint"), F.lit(0).cast("bigint"))
    altered = F.col(cols["last_altered"]) if "last_altered" in cols else F.lit(0)
    last = F.max(F.struct(altered.alias("t"), number(rows).alias("rows"), number(size).alias("bytes")))
    return (tables.groupBy(F.upper(name.cast("string")).alias("table_name")).agg(last.alias("__l"))
            .select("table_name", "__l.rows", "__l.bytes"))


def warehouse_threads(size_col: str = "warehouse_size") -> F.Column:
    """X-Small/Small/Medium -> 1/2/4, anything else 0."""
    mapping = F.create_map(*[x for k, v in WAREHOUSE_SIZES.items()
                             for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(mapping, F.col(size_col)), F.lit(0))


def check_warehouse(size_col: str = "warehouse_size") -> F.Column:
    """The size itself, or a task error naming the unknown size."""
    return F.when(F.col(size_col).isin(*WAREHOUSE_SIZES), F.col(size_col)).otherwise(
        F.raise_error(F.concat(F.lit("unknown warehouse size "),
                               F.coalesce(F.col(size_col), F.lit("NULL")),
                               F.lit("; expected one of X-Small, Small, Medium"))))


def with_table_sizes(df: DataFrame, catalogue: DataFrame, tables_col: str = "tables") -> DataFrame:
    """table_rows, table_bytes (sums) and tables_known (count) over
    the named tables; a table missing from the catalogue adds nothing.

    Statements name few different lists of tables: the distinct lists are
    exploded, joined to the catalogue and summed, and the sums joined back on the
    list, so a table that most statements name is looked up once for each list.
    """
    lists = df.select(F.col(tables_col).alias("__list")).distinct()
    exploded = lists.select("__list", F.explode("__list").alias("table_name"))
    sums = (exploded.join(table_index(catalogue), "table_name").groupBy("__list").agg(
        F.sum("rows").alias("table_rows"), F.sum("bytes").alias("table_bytes"),
        F.count(F.lit(1)).cast("int").alias("tables_known")))
    joined = df.join(sums, df[tables_col] == sums["__list"], "left")
    return joined.select(*[df[c] for c in df.columns], *[
        F.coalesce(sums[c], F.lit(0)).cast(t).alias(c) for c, t in
        (("table_rows", "bigint"), ("table_bytes", "bigint"), ("tables_known", "int"))])


def shape(df: DataFrame, catalogue: DataFrame, text_col: str = "query_text",
          size_col: str = "warehouse_size") -> DataFrame:
    """X14 in full: parsed columns, table sizes and warehouse threads."""
    parsed = with_shape(df, text_col)
    sized = with_table_sizes(parsed, catalogue)
    return sized.withColumn("warehouse_threads", warehouse_threads(size_col))


def estimated_bytes_scanned() -> F.Column:
    """BYTES_SCANNED estimate: bytes of the known tables, NULL when 0."""
    return F.nullif(F.col("table_bytes"), F.lit(0).cast("bigint"))


def pre_run(df: DataFrame, text_col: str = "query_text",
            size_col: str = "warehouse_size") -> DataFrame:
    """Text, checked size and parameterised hash, QUERY_HISTORY names."""
    return df.select(
        F.col(text_col).alias("QUERY_TEXT"),
        check_warehouse(size_col).alias("WAREHOUSE_SIZE"),
        S.parameterized_hash(F.col(text_col)).alias("QUERY_PARAMETERIZED_HASH"))
