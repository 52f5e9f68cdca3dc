"""Model versions over growing batch prefixes from additive state.

Version b is trained on the log up to batch b: batch b is its holdout (the last
30% of batch 1 for b = 1), its training rows are scored out of fold.

``state``    one row per (batch, fold, head or tail of the first batch): counts,
             the parts of the training digest and the moments of the features.
             Rows of later batches add rows to it and change none.
``models``   prefix sums of the state over batches give every version's training
             moments, "total minus fold" its out-of-fold ones: coefficients of
             all versions and folds without another look at the log.
``names``    version names from the prefix of the digest parts.
``report``   one pass over the rows: a task keeps, for each version, a vector of
             error sums and two of bootstrap sums, and passes those on. A row is
             evaluated under each version whose training set holds it, and never
             copied; its 2000 bootstrap weights come from one hash by counter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import linear as L
from . import metrics as M
from .draws import TILE, least_hashes, weights_of
from .features import FEATURES
from .model import N_FOLDS, fold_of

X_FEATURE = "log_table_rows"
K = len(FEATURES)
#: Sums that ``report`` keeps for each version.
SUMS = ["n_hold", "ape", "ae", "res", "la", "la2", "base_ape", "n_train", "cv_ape"]


def numbered(feats: DataFrame, holdout_fraction: float = M.HOLDOUT_FRACTION) -> DataFrame:
    """Adds bn (number of the batch in tag order, from 1), nb (batches), fold and
    tail (the part of the first batch that version 1 holds out)."""
    tags = feats.select("QUERY_TAG").distinct()
    # One row per batch: a window without partition over a tiny table.
    tags = tags.withColumn("bn", F.row_number().over(W.orderBy("QUERY_TAG")))
    meta = tags.agg(F.count(F.lit(1)).alias("nb"), F.min("QUERY_TAG").alias("__first"))
    n1 = (feats.join(F.broadcast(meta), feats["QUERY_TAG"] == meta["__first"], "inner")
          .agg(F.count(F.lit(1)).alias("__n1")))
    one = F.broadcast(meta.crossJoin(n1))   # one row
    tail = (F.col("bn") == 1) & (F.col("pos") >= F.floor(F.col("__n1") * F.lit(1.0 - holdout_fraction)))
    return (feats.join(F.broadcast(tags), "QUERY_TAG", "inner").crossJoin(one)
            .withColumns({"tail": tail, "fold": fold_of("QUERY_ID")}).drop("__first", "__n1"))


def digest_hash(key: str = "QUERY_ID", runtime: str = "EXECUTION_TIME") -> F.Column:
    """The 60-bit hash of one measurement (runtime in microseconds)."""
    micro = F.round(F.col(runtime) * 1000).cast("bigint").cast("string")
    return F.conv(F.substring(F.sha2(F.concat_ws(":", key, micro), 256), 1, 15), 16, 10).cast("bigint")


def state(rows: DataFrame) -> DataFrame:
    """Additive statistics of ``numbered`` rows."""
    h = digest_hash()
    return rows.groupBy("bn", "QUERY_TAG", "fold", "tail").agg(
        F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).alias("digest_sum"),
        F.bit_xor(h).alias("digest_xor"), L.moments(FEATURES, F.log("TARGET_MS")).alias("m"))


def names(st: DataFrame) -> DataFrame:
    """b, model_version, trained_at: the digest of every row up to batch b."""
    per = st.groupBy("bn", "QUERY_TAG").agg(F.sum("n").alias("n"), F.sum("digest_sum").alias("s"),
                                            F.bit_xor("digest_xor").alias("x"))
    upto = W.orderBy("bn").rowsBetween(W.unboundedPreceding, 0)      # one row per batch
    run = per.select("bn", "QUERY_TAG", F.sum("n").over(upto).alias("n"),
                     F.sum("s").over(upto).cast("decimal(30,0)").alias("s"), F.bit_xor("x").over(upto).alias("x"))
    digest = F.substring(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "s", "x")]), 256), 1, 8)
    return run.select(F.col("bn").alias("b"), F.concat(F.lit("v"), F.col("bn").cast("string"), F.lit("-"), digest)
                      .alias("model_version"), F.col("QUERY_TAG").alias("trained_at"))


def trainable(st: DataFrame) -> list[int]:
    """Versions with enough rows up to their batch (M7), in order; fewer rows than
    ``MIN_ROWS_TO_TRAIN`` in the whole log are refused."""
    upto = W.orderBy("bn").rowsBetween(W.unboundedPreceding, 0)      # one row per batch
    rows = st.groupBy("bn").agg(F.sum("n").alias("n")).select("bn", F.sum("n").over(upto).alias("n")).orderBy("bn").collect()
    if not rows or rows[-1]["n"] < M.MIN_ROWS_TO_TRAIN:
        raise ValueError(f"{rows[-1]['n'] if rows else 0} rows are too few to train on; {M.MIN_ROWS_TO_TRAIN} are needed")
    return [r["bn"] for r in rows if r["n"] >= M.MIN_ROWS_TO_TRAIN]


def training_moments(st: DataFrame) -> DataFrame:
    """b, fold, k, v: moment k of the training rows of version b in that fold (0
    where there are none). Long form: prefix sums are one window, whatever k is."""
    long = st.select("bn", "fold", "tail", F.posexplode("m").alias("k", "v"))
    per = long.groupBy("bn", "fold", "k").agg(F.sum("v").alias("v"))
    head = long.filter((F.col("bn") == 1) & ~F.col("tail")).groupBy("fold", "k").agg(F.sum("v").alias("v"))
    every = st.sparkSession.range(N_FOLDS * L.place(K + 1, K + 2, K)).select(
        (F.col("id") % N_FOLDS).cast("int").alias("fold"), F.floor(F.col("id") / N_FOLDS).cast("int").alias("k"))
    grid = st.select("bn").distinct().crossJoin(F.broadcast(every))      # batches x folds x moments
    before = W.partitionBy("fold", "k").orderBy("bn").rowsBetween(W.unboundedPreceding, -1)
    later = grid.join(per, ["bn", "fold", "k"], "left").select(
        F.col("bn").alias("b"), "fold", "k", F.coalesce(F.sum("v").over(before), F.lit(0.0)).alias("v"))
    first = every.join(head, ["fold", "k"], "left").select(
        F.lit(1).alias("b"), "fold", "k", F.coalesce("v", F.lit(0.0)).alias("v"))
    return later.filter("b > 1").unionByName(first)


def models(st: DataFrame) -> DataFrame:
    """b, fold, n (rows of the fit), slope, intercept (one feature) and coef (13
    features): the fit of version b without that fold; fold -1: on all its training rows."""
    train = training_moments(st)
    total = train.groupBy("b", "k").agg(F.sum("v").alias("all"))
    without = train.join(total, ["b", "k"]).select("b", "fold", "k", (F.col("all") - F.col("v")).alias("v"))
    fits = (without.unionByName(total.select("b", F.lit(-1).alias("fold"), "k", F.col("all").alias("v")))
            .groupBy("b", "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("m")))
    x, y = FEATURES.index(X_FEATURE) + 1, K + 1
    n, sx, sy, sxx, sxy = (F.get("m", F.lit(L.place(i, j, K))) for i, j in ((0, 0), (0, x), (0, y), (x, x), (x, y)))
    den = n * sxx - sx * sx
    one = fits.withColumn("slope", F.when(den != 0, (n * sxy - sx * sy) / den).otherwise(F.lit(0.0)))
    return one.select("b", "fold", n.cast("long").alias("n"), "slope",
                      F.try_divide(sy - F.col("slope") * sx, n).alias("intercept"),
                      L.coefficients(F.col("m"), K).alias("coef"))


class OneFeature:
    """Predictions of the one-feature fits, for ``report``."""

    def __init__(self, table: Sequence):
        self.fits = {(r["b"], r["fold"]): (r["slope"], r["intercept"]) for r in table}
        self.x = FEATURES.index(X_FEATURE)

    def log_ms(self, b: int, fold: int, x: np.ndarray) -> np.ndarray:
        slope, intercept = self.fits[b, fold]
        return intercept + slope * x[:, self.x] if intercept is not None else np.full(len(x), np.nan)


class Linear:
    """Predictions of the 13-feature fits."""

    def __init__(self, table: Sequence):
        self.fits = {(r["b"], r["fold"]): np.array(r["coef"]) for r in table}

    def log_ms(self, b: int, fold: int, x: np.ndarray) -> np.ndarray:
        c = self.fits[b, fold]
        return c[0] + x @ c[1:]


# ---- bootstrap weights by counter ----------------------------------------------

#: Poisson(1): P(weight <= k), k = 0, 1, ...
CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(M.POISSON_MAX + 1)])
LEAST = least_hashes(CDF)


def draw_weights(h: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) weights (rows x draws): draw d of a row with the 32-bit hash h is
    the inverse CDF at mix(h + d * 0x9E3779B9) / 2^32."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint32)[:, None] + np.arange(1, draws + 1, dtype=np.uint32)[None, :] * np.uint32(0x9E3779B9)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
    return weights_of(x, LEAST).astype(np.float64)


def _sums(model, baseline, versions: list[int], draws: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {b: np.zeros(len(SUMS)) for b in versions}
        weight = {b: np.zeros(draws) for b in versions}
        error = {b: np.zeros(draws) for b in versions}
        for batch in batches:
            bn, fold = (batch.column(c).to_numpy() for c in ("bn", "fold"))
            tail = batch.column("tail").to_numpy(zero_copy_only=False)
            actual = batch.column("actual_ms").to_numpy()
            h = batch.column("h").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            for b in versions:
                s = sums[b]
                hold = np.flatnonzero(bn == b if b > 1 else tail)
                if len(hold):
                    a = actual[hold]
                    p = np.exp(model.log_ms(b, -1, x[hold]))
                    e = np.abs(p - a) / a
                    la, lp = np.log10(a), np.log10(p)
                    base = np.abs(np.exp(baseline.log_ms(b, -1, x[hold])) - a) / a
                    s[:7] += len(a), e.sum(), np.abs(p - a).sum(), ((la - lp) ** 2).sum(), la.sum(), (la * la).sum(), base.sum()
                    step = max(1, TILE // max(draws, 1))
                    for at in range(0, len(a), step) if draws else ():
                        w = draw_weights(h[hold[at:at + step]], draws)
                        weight[b] += w.sum(axis=0)
                        error[b] += e[at:at + step] @ w
                for k in range(N_FOLDS):
                    train = np.flatnonzero((bn < b if b > 1 else (bn == 1) & ~tail) & (fold == k))
                    if len(train):
                        a = actual[train]
                        s[7:] += len(a), (np.abs(np.exp(model.log_ms(b, k, x[train])) - a) / a).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(versions, pa.int32()), *[pa.array([d[b] for b in versions], pa.list_(pa.float64())) for d in (sums, weight, error)]],
            ["b", "sums", "weight", "error"])
    return run


def report(rows: DataFrame, model, baseline, versions: list[int], draws: int = M.BOOTSTRAP_DRAWS) -> DataFrame:
    """Per version b: SUMS over its rows and the bootstrap interval of the holdout
    error (percent). ``model`` and ``baseline`` have log_ms(b, fold, x)."""
    seen = rows.select("bn", "fold", "tail", F.col("TARGET_MS").cast("double").alias("actual_ms"),
                       F.conv(F.substring(F.md5("QUERY_ID"), 9, 8), 16, 10).cast("bigint").alias("h"),
                       F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x")).filter("actual_ms is not null")
    parts = seen.mapInArrow(_sums(model, baseline, versions, draws), "b int, sums array<double>, weight array<double>, error array<double>")
    from ..session import materialize
    parts = materialize(parts)      # a few rows a task; both summaries below read it
    totals = parts.groupBy("b").agg(*[F.sum(F.get("sums", F.lit(i))).alias(s) for i, s in enumerate(SUMS)])
    each = parts.select("b", F.posexplode(F.arrays_zip("weight", "error")).alias("draw", "d")).groupBy("b", "draw").agg(
        F.try_divide(F.sum("d.error") * 100.0, F.sum("d.weight")).alias("__m"))
    ci = each.groupBy("b").agg(F.percentile("__m", 0.025).alias("mape_ci_low_pct"), F.percentile("__m", 0.975).alias("mape_ci_high_pct"))
    return totals.filter("n_hold > 0").join(ci, "b", "left")


def metrics(found: DataFrame, named: DataFrame) -> DataFrame:
    """M8 per version from ``report`` and ``names``."""
    n = F.col("n_hold")
    mape, mae = F.col("ape") / n * 100.0, F.col("ae") / n
    spread = F.col("la2") - F.col("la") * F.col("la") / n
    r2 = F.when(spread > 1e-12, F.lit(1.0) - F.col("res") / spread).otherwise(0.0)
    return found.join(F.broadcast(named), "b").select(
        F.col("b").cast("int").alias("model_sequence"), "model_version", "trained_at",
        F.col("b").cast("int").alias("batches_measured"), F.col("n_train").cast("int").alias("n_train_rows"),
        n.cast("int").alias("n_holdout_rows"), F.round(mape, 3).alias("holdout_mape_pct"),
        F.round("mape_ci_low_pct", 3).alias("mape_ci_low_pct"), F.round("mape_ci_high_pct", 3).alias("mape_ci_high_pct"),
        F.round(r2, 4).alias("holdout_r2"), F.round(mae, 3).alias("holdout_mae_ms"),
        F.round(F.try_divide(F.col("cv_ape") * 100.0, F.col("n_train")), 3).alias("cv_mape_pct"),
        F.round(F.col("base_ape") / n * 100.0, 3).alias("baseline_mape_pct"), M.passes_gate(mape, r2).alias("passes_gate"))
