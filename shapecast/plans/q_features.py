"""Registered feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as SC
from ..operators import features as fe
from . import history as H
from . import qlog as Q
from .oracle import FEATURE_CTES, SHAPE_CTES, TRAIN_CTES, q
from .q_calibrate import BRACKET_CTES
from .registry import register

FEATURE_SQL_COLS = ", ".join(fe.FEATURES)


def features(spark, sf_dir, extra=()):
    rows = H.training(spark, sf_dir)
    return fe.featurise(rows, Q.qtables(spark, sf_dir), keys=("QUERY_ID", *extra))


@register("J02_training_rows", q(BRACKET_CTES, TRAIN_CTES, """
select query_id as QUERY_ID, target_ms as TARGET_MS, machine_factor as MACHINE_FACTOR,
       5 as REPS, template_id as TEMPLATE_ID
from tr join qlog using (query_id)"""))
def j02(spark, sf_dir):
    return H.training(spark, sf_dir, with_prior=False).select(
        "QUERY_ID", "TARGET_MS", "MACHINE_FACTOR", "REPS", "TEMPLATE_ID")


@register("A06_prior_from_earlier_batches", q(BRACKET_CTES, TRAIN_CTES, """
select query_id as QUERY_ID, has_prior as HAS_PRIOR, prior_ms as PRIOR_EXECUTION_MS from trp"""))
def a06(spark, sf_dir):
    return H.training(spark, sf_dir).select("QUERY_ID", "HAS_PRIOR", "PRIOR_EXECUTION_MS")


@register("W02_prior_frame_per_shape_batch", q(BRACKET_CTES, TRAIN_CTES, """
select ph as QUERY_PARAMETERIZED_HASH, query_tag as QUERY_TAG,
  case when coalesce(cn, 0) > 0 then 1 else 0 end as HAS_PRIOR,
  case when coalesce(cn, 0) > 0 then cast((2 * cs + cn) // (2 * cn) as double) / 1000 end as PRIOR_EXECUTION_MS
from pw"""))
def w02(spark, sf_dir):
    return fe.prior_table(H.training(spark, sf_dir, with_prior=False))


@register("A05_history_index", q(BRACKET_CTES, TRAIN_CTES, """
select ph as QUERY_PARAMETERIZED_HASH,
  cast((2 * sum(cast(round(target_ms * 1000) as bigint)) + count(*)) // (2 * count(*)) as double)
    / 1000
    as PRIOR_EXECUTION_MS
from tr group by ph"""))
def a05(spark, sf_dir):
    return fe.history_index(H.training(spark, sf_dir, with_prior=False))


@register("J04_queue_prior_lookup", q(BRACKET_CTES, TRAIN_CTES, """
idx as (select ph, cast((2 * sum(cast(round(target_ms * 1000) as bigint)) + count(*))
                    // (2 * count(*)) as double) / 1000 as p from tr
        where query_tag < (select max(query_tag) from qlog) group by ph),
queue as (select h.query_id, h.ph from hashed h join qlog l on l.query_id = h.query_id
          where l.query_tag = (select max(query_tag) from qlog))""", """
select queue.query_id as QUERY_ID, idx.p as PRIOR_EXECUTION_MS,
  case when idx.p is not null and idx.p <> 0 then 1 else 0 end as HAS_PRIOR
from queue left join idx on idx.ph = queue.ph"""))
def j04(spark, sf_dir):
    """The latest batch as the queue, scored against the index of the others."""
    rows = H.training(spark, sf_dir, with_prior=False)
    latest = rows.agg(F.max("QUERY_TAG").alias("__m"))
    # One row: the latest tag, broadcast to every task.
    tagged = rows.crossJoin(F.broadcast(latest))
    index = fe.history_index(tagged.filter(F.col("QUERY_TAG") < F.col("__m")))
    queue = tagged.filter(F.col("QUERY_TAG") == F.col("__m")).select(
        "QUERY_ID", "QUERY_PARAMETERIZED_HASH")
    return fe.attach_prior(queue, index).select("QUERY_ID", "PRIOR_EXECUTION_MS", "HAS_PRIOR")


# log10 differs in the last bit between math libraries: published values are
# rounded to 12 decimals on both sides.
FEATURE_SQL_ROUNDED = ", ".join(f"round({c}, 12) as {c}" for c in fe.FEATURES)


@register("P08_feature_vector", q(SHAPE_CTES, BRACKET_CTES, TRAIN_CTES, FEATURE_CTES, f"""
select query_id as QUERY_ID, {FEATURE_SQL_ROUNDED} from feat"""))
def p08(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select("QUERY_ID", *[F.round(c, 12).alias(c) for c in fe.FEATURES])


@register("F01_log_transforms", q(SHAPE_CTES, BRACKET_CTES, TRAIN_CTES, FEATURE_CTES, """
select query_id as QUERY_ID, round(log_table_rows, 12) as log_table_rows,
  round(log_limit_rows, 12) as log_limit_rows, round(log_prior_ms, 12) as log_prior_ms from feat"""))
def f01(spark, sf_dir):
    return features(spark, sf_dir).select(
        "QUERY_ID", *[F.round(c, 12).alias(c) for c in ("log_table_rows", "log_limit_rows",
                                                         "log_prior_ms")])


@register("P01_projection_guard", q(BRACKET_CTES, TRAIN_CTES, """
select t.query_id as QUERY_ID, l.warehouse_size as WAREHOUSE_SIZE,
       t.prior_ms as PRIOR_EXECUTION_MS, t.has_prior as HAS_PRIOR
from trp t join qlog l on l.query_id = t.query_id"""))
def p01(spark, sf_dir):
    visible = fe.project(H.training(spark, sf_dir), keys=("QUERY_ID",))
    return visible.drop("QUERY_TEXT")


@register("P02_pre_run_projection", q("""
select query_id as QUERY_ID, query_tag as QUERY_TAG, warehouse_size as WAREHOUSE_SIZE,
  substr(sha256(query_text), 1, 32) as QUERY_HASH from qlog"""))
def p02(spark, sf_dir):
    pre = SC.select_pre_run(H.history(spark, sf_dir))
    return pre.select("QUERY_ID", "QUERY_TAG", "WAREHOUSE_SIZE", "QUERY_HASH")


def _filled(dtype, seq):
    """A value for any column of the layout, different from row to row."""
    if isinstance(dtype, T.StringType):
        return F.concat(F.lit("x"), seq.cast("string"))
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_seconds(seq)
    return (seq + 1).cast(dtype)


@register("P03_blanking_after_the_fact_changes_no_feature", q("""
select cast(0 as bigint) as differing_rows, count(*) as feature_rows, 45 as blanked_columns from qlog"""))
def p03(spark, sf_dir):
    """All 45 after-the-fact columns set, then blanked: no feature of any row changes."""
    rows = H.training(spark, sf_dir)
    types = {f.name: f.dataType for f in SC.QUERY_HISTORY_SCHEMA.fields}
    full = rows.withColumns({c: _filled(types[c], F.col("seq")) for c in SC.AFTER_THE_FACT_COLUMNS})
    blank = SC.blank_after_the_fact(full)
    changed = sum(c in SC.AFTER_THE_FACT_COLUMNS for c in blank.columns)
    cat = Q.qtables(spark, sf_dir)
    plain, blind = fe.featurise(full, cat), fe.featurise(blank, cat)
    diff = plain.exceptAll(blind).unionByName(blind.exceptAll(plain))
    return diff.agg(F.count(F.lit(1)).alias("differing_rows")).crossJoin(
        plain.agg(F.count(F.lit(1)).alias("feature_rows"))).withColumn("blanked_columns", F.lit(changed))


@register("A21_always_null_columns", " union all ".join(
    f"select '{c}' as column_name, cast({expr} as bigint) as non_null"
    for c, expr in [(c, {"QUERY_ID": "count(*)", "QUERY_TEXT": "count(*)",
                         "DATABASE_NAME": "count(*)", "SCHEMA_NAME": "count(*)",
                         "QUERY_TYPE": "count(*)", "USER_NAME": "count(*)",
                         "ROLE_NAME": "count(*)", "WAREHOUSE_NAME": "count(*)",
                         "WAREHOUSE_SIZE": "count(*)", "WAREHOUSE_TYPE": "count(*)",
                         "CLUSTER_NUMBER": "count(*)", "QUERY_TAG": "count(*)",
                         "EXECUTION_STATUS": "count(*)", "EXECUTION_TIME": "count(*)",
                         "IS_CLIENT_GENERATED_STATEMENT": "count(*)", "ROLE_TYPE": "count(*)",
                         "QUERY_HASH": "count(*)", "QUERY_HASH_VERSION": "count(*)",
                         "QUERY_PARAMETERIZED_HASH": "count(*)",
                         "QUERY_PARAMETERIZED_HASH_VERSION": "count(*)",
                         "SECONDARY_ROLE_STATS": "count(*)", "USER_TYPE": "count(*)",
                         "USER_DATABASE_NAME": "count(*)",
                         "USER_SCHEMA_NAME": "count(*)"}.get(c, "count(*) * 0"))
                    for c in SC.QUERY_HISTORY_COLUMNS]) .replace(
    "as non_null", "as non_null from events"))
def a21(spark, sf_dir):
    """Non-NULL count per QUERY_HISTORY column (0 = always NULL), one pass."""
    hist = H.history(spark, sf_dir).select(*SC.QUERY_HISTORY_COLUMNS)
    wide = hist.agg(*[F.count(F.col(c)).alias(c) for c in SC.QUERY_HISTORY_COLUMNS])
    pairs = ", ".join(f"'{c}', `{c}`" for c in SC.QUERY_HISTORY_COLUMNS)
    return wide.selectExpr(
        f"stack({len(SC.QUERY_HISTORY_COLUMNS)}, {pairs}) as (column_name, non_null)")
