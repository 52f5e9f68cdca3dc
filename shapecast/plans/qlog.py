"""``qlog``: a query log derived from the ``events`` table, as DataFrame code.

Every ``events`` row becomes one logged statement: a star-query template
(fact table, 0-3 joins, group by, ranking window, limit), a filter constant, a
warehouse size, a batch tag from the day of the month, an execution time from
a fixed law and the row's position in its batch. ``qcal`` holds the drift
readings taken every tenth position and one at the end of each batch, and
``qtables`` the catalogue (row count and bytes per table).

The same definitions exist as SQL text in ``plans/oracle.py``; both have to
give identical rows. The work grows with ``events``: everything is a per-row
expression except the position, which uses block offsets (no window partition
holds a whole batch) and the end-of-batch reading, a combinable aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinal import block_position
from ..session import stage
from ..sources.testdata import table

# Fixed values of the log (they define the oracle's answers).
FACTS = ["lineitem", "orders", "events", "part"]
JOIN_CLAUSES = [
    " inner join customer on f.k = customer.c_custkey",
    " inner join supplier on f.k = supplier.s_suppkey",
    " inner join nation on f.k = nation.n_nationkey",
]
LITERALS = [20, 150, 450, 900]
LIMITS = [0, 100, 1000]
WAREHOUSE_SIZES = ["X-Small", "Small", "Medium"]
WAREHOUSE_THREADS = [1, 2, 4]
N_TEMPLATES = 60
BATCHES = 6
DAYS_PER_BATCH = 5
CATALOGUE = [("LINEITEM", "lineitem", 120), ("ORDERS", "orders", 80),
             ("EVENTS", "events", 60), ("PART", "part", 90),
             ("CUSTOMER", "customer", 70), ("SUPPLIER", "supplier", 50),
             ("NATION", "nation", 20)]


def _pick(values: list, index) -> F.Column:
    """``values[index]`` for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _div(column, n: int):
    return F.floor(column / F.lit(n)).cast("bigint")


def spec(events: DataFrame) -> DataFrame:
    tmpl = F.col("event_id") % N_TEMPLATES
    knobs = events.select(
        F.col("event_id").alias("seq"), tmpl.alias("tmpl"),
        (F.col("user_id") % 4).alias("v"),
        ((F.col("event_id") + F.col("user_id")) % 3).alias("w"),
        F.dayofmonth("ts").alias("dom"), "value")
    t = F.col("tmpl")
    return knobs.select(
        "seq", "tmpl", "dom", "value",
        (t % 4).alias("fact_idx"),
        _pick(FACTS, t % 4).alias("fact"),
        (_div(t, 4) % 4).alias("n_joins"),
        (_div(t, 16) % 2).alias("gb"),
        (_div(t, 32) % 2).alias("win"),
        _pick(LITERALS, F.col("v")).alias("lit"),
        _pick(LIMITS, t % 3).alias("lim"),
        _pick(WAREHOUSE_SIZES, F.col("w")).alias("warehouse_size"),
        _pick(WAREHOUSE_THREADS, F.col("w")).alias("threads"))


def statement_text() -> F.Column:
    """The logged SQL text of a spec row (X16: text from the knob columns)."""
    nj, win, lim = F.col("n_joins"), F.col("win"), F.col("lim")
    joins = [F.when(nj >= i + 1, F.lit(c)).otherwise(F.lit(""))
             for i, c in enumerate(JOIN_CLAUSES)]
    return F.concat(
        F.lit("with filtered as (select f.k, f.amount from "), F.col("fact"), F.lit(" as f"),
        *joins,
        F.lit(" where cast(substr(f.code, 3, 3) as integer) < "),
        F.col("lit").cast("string"), F.lit(")"),
        F.when(win == 1, F.lit(", ranked as (select filtered.*, row_number() over "
                               "(partition by k order by amount desc) as amount_rank "
                               "from filtered)")).otherwise(F.lit("")),
        F.lit(" select count(*) as c from "),
        F.when(win == 1, F.lit("ranked")).otherwise(F.lit("filtered")),
        F.when(F.col("gb") == 1, F.lit(" group by k")).otherwise(F.lit("")),
        F.when(lim > 0, F.concat(F.lit(" limit "), lim.cast("string"))).otherwise(F.lit("")))


def execution_ms() -> F.Column:
    """The runtime law; evaluated left to right exactly as the SQL text does."""
    c = F.col
    ms = ((F.lit(20) + F.lit(10) * c("fact_idx")) * (F.lit(1) + F.lit(0.35) * c("n_joins"))
          * (F.lit(1) + F.lit(0.5) * c("lit") / F.lit(1000))
          * (F.lit(1) + F.lit(0.4) * c("gb"))
          * (F.lit(1) + F.lit(0.6) * c("win")) / c("threads")
          * (F.lit(1) + c("value") / F.lit(2000)))
    return F.round(ms, 3)


def qlog(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    """seq, query_id, query_tag, template_id, warehouse_size, query_text, execution_ms, pos.

    ``extra=True`` keeps the knob columns (fact, n_joins, gb, win, lit, lim,
    threads) for the operators that label or check templates.
    """
    # The log is the base of every later stage: written once per application.
    full = stage(spark, ("qlog", sf_dir), lambda: _build_qlog(spark, sf_dir))
    return full if extra else full.select(*BASE_COLUMNS)


BASE_COLUMNS = ["seq", "query_id", "query_tag", "template_id", "warehouse_size", "query_text",
                "execution_ms", "pos"]


def _build_qlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spec(table(spark, sf_dir, "events"))
    batch = F.least(F.lit(BATCHES), F.lit(1) + _div(F.col("dom") - 1, DAYS_PER_BATCH))
    logged = s.select(
        "seq",
        F.concat(F.lit("q"), F.col("seq").cast("string")).alias("query_id"),
        F.concat(F.lit("batch_0"), batch.cast("string")).alias("query_tag"),
        F.concat(F.lit("t"), F.lpad((F.col("tmpl") + 1).cast("string"), 2, "0"))
        .alias("template_id"),
        "warehouse_size",
        statement_text().alias("query_text"),
        execution_ms().alias("execution_ms"),
        *[F.col(c) for c in ("fact", "n_joins", "gb", "win", "lit", "lim", "threads")])
    return block_position(logged, ["query_tag"], "seq", "pos")


def qcal(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """query_tag, pos, seconds: a reading every tenth position plus the end one."""
    log = log if log is not None else qlog(spark, sf_dir)
    pos = F.col("pos")
    every = log.filter(pos % 10 == 0).select(
        "query_tag", "pos",
        (F.lit(0.25) * (F.lit(1) + F.lit(0.01) * (pos % 70) / F.lit(10))).alias("seconds"))
    last = (log.groupBy("query_tag").agg((F.max("pos") + 1).alias("pos"))
            .filter(F.col("pos") % 10 != 0)
            .select("query_tag", "pos", F.lit(0.25).alias("seconds")))
    return every.unionByName(last)


def qtables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_count, bytes (bytes = rows x a fixed width per table).
    Seven counts, written once per application and reused by every lookup."""
    return stage(spark, ("qtables", sf_dir), lambda: _build_qtables(spark, sf_dir))


def _build_qtables(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, src).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count",
                     (F.col("row_count") * F.lit(width)).alias("bytes"))
             for name, src, width in CATALOGUE]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
