"""Pre-run features (P1, P8, F1, F16), priors from history (A5, A6, J4) and
the training join (J2).

The feature builder sees four columns and nothing else: QUERY_TEXT,
WAREHOUSE_SIZE, PRIOR_EXECUTION_MS and HAS_PRIOR (``project``), plus pass-through
keys that it does not read. The two history columns come from strictly earlier
batches of the same parameterised shape (``attach_history``).

Scale: the prior is computed on the (hash, batch) aggregate - one row per shape
and batch, whatever the number of executions - so a hot shape costs one
combinable group per batch; the lookback window runs over a shape's batches
only. The catalogue lookup broadcasts a size-checked map (see ``shape``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import PRE_RUN_COLUMNS
from ..session import materialize
from . import shape as shape_op

# ---- fixed values: the feature contract ---------------------------------------
SOURCE_COLUMNS = ["QUERY_TEXT", "WAREHOUSE_SIZE"]
HISTORY_COLUMNS = ["PRIOR_EXECUTION_MS", "HAS_PRIOR"]
HISTORY_SOURCE_COLUMNS = ["QUERY_TAG", "QUERY_PARAMETERIZED_HASH"]
FEATURES = ["log_table_rows", "log_table_bytes", "n_tables", "n_joins",
            "has_group_by", "has_order_by", "has_window", "log_limit_rows",
            "n_predicates", "predicate_literal", "warehouse_threads",
            "has_prior", "log_prior_ms"]
# -------------------------------------------------------------------------------


def project(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Only the source and history columns survive (plus ``keys``, which must
    be pre-run columns and are passed through unread)."""
    for k in keys:
        if k not in PRE_RUN_COLUMNS:
            raise ValueError(f"{k} is not a pre-run column and cannot pass the guard")
    allowed = [c for c in SOURCE_COLUMNS + HISTORY_COLUMNS if c in df.columns]
    return df.select(*keys, *allowed)


def featurise(df: DataFrame, catalogue: DataFrame, keys: tuple[str, ...] = ("QUERY_ID",),
              vector: str | None = None, passthrough: tuple[str, ...] = ()) -> DataFrame:
    """The 13 features in contract order (doubles), after the guard.

    ``vector`` adds a Spark ML vector column of the same 13 values;
    ``passthrough`` keeps parsed shape columns (e.g. ``table_rows``) beside
    them, for tables that display the shape the model saw.
    """
    seen = project(df, keys)
    for c in HISTORY_COLUMNS:
        if c not in seen.columns:
            seen = seen.withColumn(c, F.lit(None).cast("double" if c.startswith("PRIOR")
                                                       else "int"))
    # Written without the texts: the parse is most of the work, and the look-up of the
    # table lists below reads its result twice.
    parsed = materialize(shape_op.with_shape(seen, "QUERY_TEXT").drop("QUERY_TEXT"))
    sized = shape_op.with_table_sizes(parsed, catalogue)
    has_prior = F.coalesce(F.col("HAS_PRIOR").cast("double"), F.lit(0.0))
    prior = F.coalesce(F.col("PRIOR_EXECUTION_MS").cast("double"), F.lit(0.0))
    d = lambda c: F.col(c).cast("double")
    feats = [
        F.log10(F.greatest(d("table_rows"), F.lit(1.0))).alias("log_table_rows"),
        F.log10(F.greatest(d("table_bytes"), F.lit(1.0))).alias("log_table_bytes"),
        d("n_tables").alias("n_tables"), d("n_joins").alias("n_joins"),
        d("has_group_by").alias("has_group_by"), d("has_order_by").alias("has_order_by"),
        d("has_window").alias("has_window"),
        F.log10(d("limit_rows") + F.lit(1.0)).alias("log_limit_rows"),
        d("n_predicates").alias("n_predicates"), d("predicate_literal").alias("predicate_literal"),
        shape_op.warehouse_threads("WAREHOUSE_SIZE").cast("double").alias("warehouse_threads"),
        has_prior.alias("has_prior"),
        F.when(has_prior != 0, F.log10(prior + F.lit(1.0))).otherwise(F.lit(0.0))
        .alias("log_prior_ms"),
    ]
    out = sized.select(*[k for k in keys], *feats, *passthrough)
    if vector:
        from pyspark.ml.functions import array_to_vector
        out = out.withColumn(vector, array_to_vector(F.array(*FEATURES)))
    return out


def training_rows(history: DataFrame, calibration: DataFrame,
                  order_col: str | None = None) -> DataFrame:
    """History rows with the calibrated target beside them (inner join on
    the query id). A calibration id that repeats keeps its last row: by
    ``order_col``, else by its columns in their order."""
    first = [order_col] if order_col else []
    rest = [x for x in calibration.columns if x not in ("query_id", order_col)]
    c = (calibration.groupBy("query_id").agg(F.max(F.struct(*first, *rest)).alias("__r"))
         .select("query_id", *[F.col("__r")[x].alias(x) for x in rest]))
    beside = c.select(
        F.col("query_id").alias("QUERY_ID"),
        F.col("calibrated_execution_ms").cast("double").alias("TARGET_MS"),
        F.col("machine_factor").cast("double").alias("MACHINE_FACTOR"),
        F.col("reps").cast("int").alias("REPS"),
        F.col("template_id").alias("TEMPLATE_ID"),
        F.col("template_label").alias("TEMPLATE_LABEL"))
    return history.join(beside, "QUERY_ID", "inner")


def thousandths(col: str) -> F.Column:
    """A runtime in ms (3 decimals) as an exact integer count of microseconds
    (thousandths of a millisecond)."""
    return F.round(F.col(col).cast("double") * 1000).cast("bigint")


def mean_3dp(total_thousandths: str, count: str) -> F.Column:
    """Mean of 3-decimal values rounded half-up to 3 decimals, in exact integer
    arithmetic: the same in every engine and for every summation order."""
    return F.expr(f"cast((2 * {total_thousandths} + {count}) div (2 * {count}) as double) / 1000")


def prior_table(rows: DataFrame, target: str = "TARGET_MS", tag: str = "QUERY_TAG",
                key: str = "QUERY_PARAMETERIZED_HASH") -> DataFrame:
    """A6 core: per (shape, batch) the mean target over strictly earlier batches
    (string order of the tag). Columns key, tag, HAS_PRIOR, PRIOR_EXECUTION_MS."""
    per_batch = rows.groupBy(key, tag).agg(F.sum(thousandths(target)).alias("__s"),
                                           F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(key).orderBy(tag).rowsBetween(W.unboundedPreceding, -1)
    cum = per_batch.select(key, tag, F.sum("__s").over(before).alias("__cs"),
                           F.sum("__n").over(before).alias("__cn"))
    has = F.coalesce(F.col("__cn"), F.lit(0)) > 0
    return cum.select(
        key, tag,
        F.when(has, F.lit(1)).otherwise(F.lit(0)).alias("HAS_PRIOR"),
        F.when(has, mean_3dp("__cs", "__cn")).alias("PRIOR_EXECUTION_MS"))


def attach_history(rows: DataFrame, target: str = "TARGET_MS", tag: str = "QUERY_TAG",
                   key: str = "QUERY_PARAMETERIZED_HASH") -> DataFrame:
    """HAS_PRIOR and PRIOR_EXECUTION_MS from earlier batches only. NULL
    hashes form one shape (null-safe join)."""
    priors = (prior_table(rows, target, tag, key)
              .withColumnRenamed(key, "__k").withColumnRenamed(tag, "__t"))
    base = rows.drop(*[c for c in HISTORY_COLUMNS if c in rows.columns])
    on = base[key].eqNullSafe(F.col("__k")) & base[tag].eqNullSafe(F.col("__t"))
    return base.join(priors, on, "left").drop("__k", "__t")


def history_index(rows: DataFrame, target: str = "TARGET_MS",
                  key: str = "QUERY_PARAMETERIZED_HASH") -> DataFrame:
    """A5: mean past runtime per shape over everything measured (3 dp)."""
    return (rows.groupBy(key).agg(F.sum(thousandths(target)).alias("__s"),
                                  F.count(F.lit(1)).alias("__n"))
            .select(key, mean_3dp("__s", "__n").alias("PRIOR_EXECUTION_MS")))


def attach_prior(rows: DataFrame, index: DataFrame,
                 key: str = "QUERY_PARAMETERIZED_HASH") -> DataFrame:
    """The same lookup for statements that have not run; a prior of 0 or
    NULL counts as none."""
    idx = index.select(F.col(key).alias("__k"), "PRIOR_EXECUTION_MS")
    base = rows.drop(*[c for c in HISTORY_COLUMNS if c in rows.columns])
    joined = base.join(idx, base[key].eqNullSafe(idx["__k"]), "left").drop("__k")
    prior = F.col("PRIOR_EXECUTION_MS")
    return joined.withColumn(
        "HAS_PRIOR", F.when(prior.isNotNull() & (prior != 0), F.lit(1)).otherwise(F.lit(0)))
