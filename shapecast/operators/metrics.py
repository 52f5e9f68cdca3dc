"""Model-quality aggregates (A7-A13, A20) as DataFrame aggregations.

Every metric is an aggregate over a scored DataFrame with ``actual_ms`` and
``predicted_ms`` columns (one-row results), so it runs on executors whatever
the size of the scored set. Deciles (A11) use a global rank from the
range-partitioned sort, not a single-partition window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .draws import least_hashes, md5_heads, weights_of
from .ordinal import sorted_position

# ---- fixed values: gate and bootstrap settings ----------------------------------
GATE_MAPE_PCT = 15.0
GATE_R2 = 0.90
GATE_RULE = "holdout MAPE <= 15% and holdout R2 >= 0.90 on log10 ms"
BOOTSTRAP_DRAWS = 2000
HOLDOUT_FRACTION = 0.3
MIN_ROWS_TO_TRAIN = 12
POISSON_MAX = 12          # bootstrap weights above this have a chance below 1e-10
# ---------------------------------------------------------------------------------



def _a() -> F.Column:
    return F.col("actual_ms")


def _p() -> F.Column:
    return F.col("predicted_ms")


def ape() -> F.Column:
    """Absolute percentage error of one row."""
    return F.abs(_p() - _a()) / _a() * F.lit(100.0)


def mape() -> F.Column:
    """Mean absolute percentage error."""
    return F.avg(F.abs(_p() - _a()) / _a()) * F.lit(100.0)


def mae() -> F.Column:
    """A9."""
    return F.avg(F.abs(_p() - _a()))


def r_squared(scored: DataFrame) -> DataFrame:
    """R^2 on log10 ms (0 when the actuals have no variance). Two passes:
    the mean first (one row, broadcast), then the sums."""
    la, lp = F.log10(_a()), F.log10(_p())
    mean = scored.agg(F.avg(la).alias("__m"))
    sums = scored.crossJoin(F.broadcast(mean)).agg(
        F.sum((la - lp) * (la - lp)).alias("__res"),
        F.sum((la - F.col("__m")) * (la - F.col("__m"))).alias("__tot"))
    return sums.select(F.when(F.col("__tot") > 0, F.lit(1.0) - F.col("__res") / F.col("__tot"))
                       .otherwise(F.lit(0.0)).alias("r2"))


def passes_gate(mape_col: F.Column, r2_col: F.Column) -> F.Column:
    """M6: inclusive on both bounds."""
    return (mape_col <= F.lit(GATE_MAPE_PCT)) & (r2_col >= F.lit(GATE_R2))


def poisson_cdf(kmax: int = POISSON_MAX) -> list[float]:
    """Poisson(1): P(weight <= k), k = 0.. (P(k > 12) < 1e-10)."""
    cdf, term, out = 0.0, math.exp(-1.0), []
    for k in range(kmax + 1):
        cdf += term
        term /= (k + 1)
        out.append(cdf)
    return out


def _draw_sums(draws: int):
    """Of each task, by draw: the sum of the weights, and of the weighted errors (null where it had none)."""
    least = least_hashes(poisson_cdf())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, error, counted = np.zeros(draws), np.zeros(draws), 0
        for batch in batches:
            e = batch.column("e")
            known, e = ~e.is_null().to_numpy(zero_copy_only=False), e.fill_null(0.0).to_numpy()
            counted += int(known.sum())
            for rows, first, h in md5_heads(batch.column("k").to_pylist(), draws):
                w = weights_of(h, least).astype(np.float64)
                at = slice(first - 1, first - 1 + w.shape[1])
                weight[at] += w.sum(axis=0)
                error[at] += e[rows] @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, draws + 1, dtype=np.int32)), pa.array(weight),
                                          pa.array(error, mask=np.full(draws, not counted))], ["draw", "w", "e"])
    return run


def bootstrap_mape_ci(scored: DataFrame, key: str = "query_id",
                      draws: int = BOOTSTRAP_DRAWS) -> DataFrame:
    """A10: 95% interval of MAPE by a Poisson bootstrap: each row enters draw d
    with a Poisson(1) weight from md5(key:d); each draw's weighted MAPE, then
    the 2.5th and 97.5th percentiles. A task adds up all draws of its rows in
    arrays and emits ``draws`` partial rows; no row is copied."""
    parts = scored.select(F.col(key).cast("string").alias("k"), ape().cast("double").alias("e")).mapInArrow(
        _draw_sums(draws), "draw int, w double, e double")
    per_draw = parts.groupBy("draw").agg((F.sum("e") / F.sum("w")).alias("__m"))
    return per_draw.agg(F.percentile("__m", 0.025).alias("mape_ci_low_pct"),
                        F.percentile("__m", 0.975).alias("mape_ci_high_pct"))


def decile_of(rank: F.Column, n: F.Column, k: F.Column) -> F.Column:
    """Bucket of 1-based ``rank`` when n rows are cut into k nearly equal
    consecutive buckets, the first n % k one row larger (= ntile)."""
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    return (F.when(rank <= big, F.floor((rank - 1) / (q + 1)) + 1)
            .otherwise(rem + F.floor((rank - big - 1) / q) + 1)).cast("int")


def calibration_table(scored: DataFrame, key: str = "query_id") -> DataFrame:
    """k = min(10, max(1, n // 4)) buckets by predicted runtime (ties by
    key): queries, mean predicted, mean actual, MAPE (2 dp)."""
    ranked = sorted_position(scored.select(key, "actual_ms", "predicted_ms"), [],
                             [_p().asc(), F.col(key).asc()], "__r")
    n = scored.agg(F.count(F.lit(1)).alias("__n"))
    k = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.col("__n") / 4)))
    return (ranked.crossJoin(F.broadcast(n))
            .withColumn("decile", decile_of(F.col("__r"), F.col("__n"), k))
            .groupBy("decile")
            .agg(F.count(F.lit(1)).cast("int").alias("queries"),
                 F.round(F.avg(_p()), 2).alias("predicted_ms"),
                 F.round(F.avg(_a()), 2).alias("actual_ms"),
                 F.round(mape(), 2).alias("abs_pct_error")))


def feature_envelope(features: DataFrame, names: list[str]) -> DataFrame:
    """Min and max of every feature (6 dp), long form (feature, min, max)."""
    wide = features.agg(*[x for c in names for x in
                          (F.min(c).alias(f"min__{c}"), F.max(c).alias(f"max__{c}"))])
    pairs = ", ".join(f"'{c}', round(`min__{c}`, 6), round(`max__{c}`, 6)" for c in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) as (feature, min, max)")


def runtime_profile(rows: DataFrame) -> DataFrame:
    """Target and drift profile of a training set (one row). Medians are
    exact order statistics by rank (the whole table is one group)."""
    from .ordinal import exact_percentiles
    one = rows.withColumn("__all", F.lit(1))
    base = one.groupBy("__all").agg(
        F.min("TARGET_MS").alias("runtime_min_ms"), F.max("TARGET_MS").alias("runtime_max_ms"),
        F.min("MACHINE_FACTOR").alias("machine_factor_min"),
        F.max("MACHINE_FACTOR").alias("machine_factor_max"),
        F.round(F.avg(F.coalesce(F.col("HAS_PRIOR").cast("double"), F.lit(0.0))), 4)
        .alias("seen_before_share"))
    medians = exact_percentiles(one, ["__all"], {"TARGET_MS": "runtime_median_ms",
                                                 "REPS": "reps_median"}, 0.5)
    return (base.join(medians, "__all", "left").select(
        "runtime_min_ms", "runtime_max_ms", "runtime_median_ms", "machine_factor_min",
        "machine_factor_max", "reps_median", "seen_before_share"))


def training_digest(rows: DataFrame, key: str = "QUERY_ID",
                    runtime: str = "EXECUTION_TIME") -> DataFrame:
    """8-hex digest of the training set, independent of row order: per row
    sha2(key:runtime in microseconds); count, sum and xor of a 60-bit prefix;
    sha2 of the three. One row, one column ``digest``."""
    micro = F.round(F.col(runtime) * 1000).cast("bigint").cast("string")
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(key), micro), 256), 1, 15),
               16, 10).cast("bigint")
    return (rows.select(h.alias("__h"))
            .agg(F.count(F.lit(1)).alias("__n"),
                 F.sum(F.col("__h").cast("decimal(20,0)")).alias("__s"),
                 F.bit_xor("__h").alias("__x"))
            .select(F.substring(F.sha2(F.concat_ws(
                ":", F.col("__n").cast("string"), F.col("__s").cast("string"),
                F.col("__x").cast("string")), 256), 1, 8).alias("digest")))
