"""Training and scoring.

Split (M1): the latest batch is the holdout; with one batch, the last 30% by
arrival ordinal. Two model families:

* ``ols_1d``: least squares of log runtime on one feature, fitted from
  sufficient statistics (n, sum x, sum y, sum xx, sum xy) - one combinable
  aggregate; 5-fold out-of-fold predictions (M4) come from "total minus fold"
  statistics in the same pass. Expressible in SQL, so it has a DuckDB twin.
* Spark ML pipelines on the 13-feature vector: ``LinearRegression`` (M2) and
  ``GBTRegressor`` (M3) on log runtime, out-of-fold by five fits submitted
  concurrently with the holdout and deployed fits,
  permutation importance (M5) and a small grid (M16).

Scores are ``exp`` of the log prediction (M12). Nothing is collected except
model coefficients and one-row metrics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import even_tasks, materialize
from . import metrics as M
from .features import FEATURES
from .ordinal import block_position

N_FOLDS = 5
SEED = 20260821


def split(rows: DataFrame, tag: str = "QUERY_TAG", ordinal: str = "seq",
          holdout_fraction: float = M.HOLDOUT_FRACTION) -> DataFrame:
    """M1: add ``in_holdout`` (0/1)."""
    stats = rows.agg(F.countDistinct(tag).alias("tags"), F.max(tag).alias("last"),
                     F.count(F.lit(1)).alias("n")).first()      # one row
    if stats["tags"] > 1:
        return rows.withColumn("in_holdout", (F.col(tag) == F.lit(stats["last"])).cast("int"))
    if ordinal not in rows.columns:
        return rows.withColumn("in_holdout", F.lit(0))
    cut = math.floor(stats["n"] * (1.0 - holdout_fraction))
    return block_position(rows, [], ordinal, "__ord").withColumn(
        "in_holdout", (F.col("__ord") >= cut).cast("int")).drop("__ord")


def fold_of(key: str = "QUERY_ID", folds: int = N_FOLDS) -> F.Column:
    """M4: a portable pseudo-random fold from md5 of the row key."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(folds)).cast("int")


def _slope_intercept(n, sx, sy, sxx, sxy):
    den = n * sxx - sx * sx
    slope = F.when(den != 0, (n * sxy - sx * sy) / den).otherwise(F.lit(0.0))
    return slope, (sy - slope * sx) / n


def ols_1d_predictions(rows: DataFrame, x: str, key: str = "QUERY_ID",
                       target: str = "TARGET_MS", folds: int = N_FOLDS) -> DataFrame:
    """M2 (one feature) + M4 + M9: ``in_holdout`` rows are scored by the fit on
    all training rows, training rows by the fit on the other folds.

    Output: key, in_holdout, actual_ms, predicted_ms, abs_pct_error (3 dp)."""
    y = F.log(F.col(target))
    staged = rows.select(key, "in_holdout", F.col(x).cast("double").alias("__x"),
                         y.alias("__y"), F.col(target).alias("actual_ms"),
                         fold_of(key, folds).alias("__fold"))
    train = staged.filter(F.col("in_holdout") == 0)
    per_fold = train.groupBy("__fold").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("__x").alias("sx"),
        F.sum("__y").alias("sy"), F.sum(F.col("__x") * F.col("__x")).alias("sxx"),
        F.sum(F.col("__x") * F.col("__y")).alias("sxy"))
    total = per_fold.agg(*[F.sum(c).alias("t" + c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    # Coefficients: one row for the holdout fit, one per fold (folds bounded).
    coef = per_fold.crossJoin(total)
    s_o, i_o = _slope_intercept(*[F.col("t" + c) - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    oof = coef.select("__fold", s_o.alias("__b"), i_o.alias("__a"))
    s_h, i_h = _slope_intercept(*[F.col("t" + c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    full = total.select(s_h.alias("__hb"), i_h.alias("__ha"))
    scored = (staged.join(F.broadcast(oof), "__fold", "left")
              .crossJoin(F.broadcast(full)))
    pred = F.when(F.col("in_holdout") == 1, F.exp(F.col("__ha") + F.col("__hb") * F.col("__x"))) \
        .otherwise(F.exp(F.col("__a") + F.col("__b") * F.col("__x")))
    return scored.select(
        key, "in_holdout", F.round("actual_ms", 3).alias("actual_ms"),
        F.round(pred, 3).alias("predicted_ms"),
        F.round(F.abs(pred - F.col("actual_ms")) / F.col("actual_ms") * 100.0, 3)
        .alias("abs_pct_error"))


def ols_1d_coefficients(rows: DataFrame, x: str, target: str = "TARGET_MS") -> DataFrame:
    """M2 (one feature): slope and intercept with the engine's regression
    aggregates (one row)."""
    return rows.agg(F.regr_slope(F.log(F.col(target)), F.col(x)).alias("slope"),
                    F.regr_intercept(F.log(F.col(target)), F.col(x)).alias("intercept"))


# ---- Spark ML models on the 13-feature vector -----------------------------------

def assembler(output: str = "features"):
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=FEATURES, outputCol=output)


def new_gbt(max_iter: int = 40, max_depth: int = 3, step: float = 0.12):
    """M3: boosted trees on log runtime, squared loss."""
    from pyspark.ml.regression import GBTRegressor
    return GBTRegressor(featuresCol="features", labelCol="label", lossType="squared",
                        maxDepth=max_depth, stepSize=step, maxIter=max_iter, seed=SEED,
                        minInstancesPerNode=4, checkpointInterval=10)


def new_linear():
    """M2: ordinary least squares on the same vector."""
    from pyspark.ml.regression import LinearRegression
    return LinearRegression(featuresCol="features", labelCol="label", regParam=0.0,
                            elasticNetParam=0.0, solver="normal")


def pipeline(estimator):
    from pyspark.ml import Pipeline
    return Pipeline(stages=[assembler(), estimator])


def labelled(features: DataFrame, target: str = "TARGET_MS") -> DataFrame:
    return features.withColumn("label", F.log(F.col(target)))


def dealt(data: DataFrame, rows: int, key: str = "QUERY_ID") -> DataFrame:
    """``data`` in tasks of even size for a fit, which passes over it hundreds of
    times (each tree level is a job of all tasks)."""
    return data.repartition(even_tasks(data.sparkSession, rows), key, *FEATURES)


def grouped(data: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of equal ``keys`` and features as one, with their number (``weight``) and
    mean ``label``. To trees of squared loss they are the same: gradients and the
    gain of a split are sums over rows, and what the labels of equal rows differ by
    is on the same side of every split. Kept, in tasks of even size."""
    mean = F.when(F.count("label") == F.count(F.lit(1)), F.avg("label"))     # a missing label is refused by the fit
    table = materialize(data.groupBy(*(keys or []), *FEATURES).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), mean.alias("label")))
    tasks = even_tasks(data.sparkSession, table.count())
    return table.repartition(tasks, *(keys or []), *FEATURES).cache()


def by_rows(estimator, rows: float):
    """The estimator for ``grouped`` data: the least rows of a leaf count rows, not groups."""
    least = estimator.getMinInstancesPerNode()
    return (estimator.setWeightCol("weight").setMinInstancesPerNode(1)
            .setMinWeightFractionPerNode(min(0.49, (least - 0.5) / max(rows, 1.0))))


def score(model, features: DataFrame, out: str = "predicted_ms") -> DataFrame:
    """milliseconds = exp(log prediction); empty in, empty out."""
    return model.transform(features).withColumn(out, F.exp("prediction")).drop(
        "prediction", "features")


def fit_and_score(train_features: DataFrame, estimator_factory, key: str = "QUERY_ID",
                  target: str = "TARGET_MS", folds: int = N_FOLDS):
    """M9 with a Spark ML model: holdout rows scored by a fit on the training
    rows, training rows by five out-of-fold fits (M4), plus the deployed refit
    on everything (M10). Returns (predictions, holdout_model, deployed_model)."""
    rows = train_features.count()
    if rows < M.MIN_ROWS_TO_TRAIN:      # M7
        raise ValueError(f"{rows} rows are too few to train on; {M.MIN_ROWS_TO_TRAIN} are needed")
    data = labelled(train_features, target).withColumn("__fold", fold_of(key, folds))
    trees = hasattr(estimator_factory(), "setMinWeightFractionPerNode")
    data = (data.select(key, "in_holdout", target, "label", "__fold", *FEATURES) if trees else dealt(data, rows, key)).cache()
    data.count()        # kept before the fits start side by side
    train = data.filter(F.col("in_holdout") == 0)
    hold = data.filter(F.col("in_holdout") == 1)
    table = grouped(data, ["in_holdout", "__fold"]) if trees else data
    known = table.filter(F.col("in_holdout") == 0)
    # The seven fits are independent: holdout model, one per fold, deployed.
    fitted = fit_all([known] + [known.filter(F.col("__fold") != k) for k in range(folds)]
                     + [table], estimator_factory)
    if trees:
        table.unpersist()
    model, deployed = fitted[0], fitted[-1]
    parts = [score(model, hold)] + [score(m, train.filter(F.col("__fold") == k))
                                    for k, m in enumerate(fitted[1:-1])]
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    predictions = scored.select(
        key, "in_holdout", F.round(F.col(target), 3).alias("actual_ms"),
        F.round("predicted_ms", 3).alias("predicted_ms"),
        F.round(F.abs(F.col("predicted_ms") - F.col(target)) / F.col(target) * 100.0, 3)
        .alias("abs_pct_error"))
    return predictions, model, deployed


def fit(train_features: DataFrame, estimator_factory, key: str = "QUERY_ID", target: str = "TARGET_MS"):
    """One fit of trees on all rows, grouped and kept while it passes over them."""
    data = grouped(labelled(train_features, target))
    try:
        return fit_all([data], estimator_factory)[0]
    finally:
        data.unpersist()


def fit_all(datasets: list[DataFrame], estimator_factory, workers: int = 4) -> list:
    """Fit one pipeline per DataFrame, submitting the fits from a few driver
    threads so their Spark jobs run side by side (each fit is a sequence of
    small jobs that alone would leave executors idle)."""
    from concurrent.futures import ThreadPoolExecutor

    def fit_one(data: DataFrame):
        use = estimator_factory()
        if "weight" in data.columns:
            use = by_rows(use, data.agg(F.sum("weight")).first()[0] or 0.0)
        return pipeline(use).fit(data)

    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(fit_one, datasets))


def permutation_importance(model, holdout: DataFrame, key: str = "QUERY_ID",
                           target: str = "TARGET_MS", repeats: int = 15) -> DataFrame:
    """M5: drop in log-ms MAE when one feature is permuted, mean of ``repeats``.

    Permutation r gives the row at place p (in the order of the key) the values
    of the row at place p in the order of md5(key:r): portable, no random state,
    and no structure of the keys survives. The rows are numbered once; a repeat
    sorts only hashes and numbers. Features are taken one by one after the donor
    join, where the donor's value is another.
    """
    from .importance import tree_rises
    from .ordinal import sorted_position
    base = labelled(holdout, target).select(key, "label", *FEATURES)
    if base.isEmpty():
        return base.sparkSession.createDataFrame([], "feature string, importance double")
    # a row's place in the order of the key is the same in every repeat
    off = F.abs(F.col("prediction") - F.col("label"))
    own = materialize(model.transform(sorted_position(base, [], [F.col(key).asc()], "__pos")).select(
        F.col(key).cast("string").alias("__key"), "__pos", "label", off.alias("__off"), *FEATURES))
    n = own.agg(F.count("__off")).first()[0]
    shuffled = F.unhex(F.md5(F.concat_ws(":", F.col("__key"), F.col("__r").cast("string"))))
    copies = (own.select("__key", F.col("__pos").alias("__donor"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("__r"))
              .select("__r", shuffled.alias("__m"), "__donor"))
    donors = sorted_position(copies, ["__r"], [F.col("__m").asc(), F.col("__donor").asc()], "__pos").select("__pos", "__donor")
    trees = _gbt_trees(model)
    if trees:
        def rises(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(FEATURES))
            for batch in batches:
                y = batch.column("label")
                known = ~y.is_null().to_numpy(zero_copy_only=False)
                x, other = (batch.column(c).flatten().to_numpy().reshape(len(y), -1)[known] for c in ("x", "dx"))
                sums += tree_rises(0.0, trees, x, other, y.to_numpy(zero_copy_only=False)[known])
            yield pa.RecordBatch.from_arrays([pa.array(FEATURES), pa.array(sums)], ["__feature", "__rise"])

        row = F.array(*FEATURES).alias("x")
        paired = (donors.join(own.select(F.col("__pos").alias("__donor"), row.alias("dx")), "__donor").select("__pos", "dx")
                  .join(own.select("__pos", "label", row), "__pos").select("label", "x", "dx"))
        rise = paired.mapInArrow(rises, "__feature string, __rise double").groupBy("__feature").agg(F.sum("__rise").alias("__rise"))
        return _importances(rise, n * repeats)
    values = own.select(F.col("__pos").alias("__donor"), F.struct(*FEATURES).alias("__vals"))
    paired = donors.join(values, "__donor").select("__pos", "__vals").join(own.drop("__key"), "__pos")
    # a donor of the same value changes nothing
    other = [F.when(~F.col(f).eqNullSafe(F.col("__vals")[f]), F.lit(f)) for f in FEATURES]
    permuted = paired.select("*", F.explode(F.array_compact(F.array(*other))).alias("__feature"))
    permuted = permuted.select("__feature", "label", "__off", *[
        F.when(F.col("__feature") == f, F.col("__vals")[f]).otherwise(F.col(f)).alias(f) for f in FEATURES])
    rise = model.transform(permuted).groupBy("__feature").agg(F.sum(off - F.col("__off")).alias("__rise"))
    return _importances(rise, n * repeats)


def _importances(rise: DataFrame, n: int) -> DataFrame:
    names = rise.sparkSession.createDataFrame([(f,) for f in FEATURES], "__feature string")
    return names.join(rise, "__feature", "left").select(
        F.col("__feature").alias("feature"),
        F.round(F.try_divide(F.coalesce("__rise", F.lit(0.0)), F.lit(float(n))), 4).alias("importance"))


def _gbt_trees(model) -> list[tuple]:
    """Spark's boosted trees as (splits, leaf values) of ``importance.tree_rises``;
    none for another model, or one whose trees have categories."""
    last = model.stages[-1]
    out = []
    for tree, weight in zip(getattr(last, "trees", []), getattr(last, "treeWeights", [])):
        splits, values, todo = [], [0.0], [(tree._call_java("rootNode"), 0)]
        while todo:
            node, leaf = todo.pop(0)
            if node.subtreeDepth() == 0:
                values[leaf] = weight * node.prediction()
                continue
            split = node.split()
            if not split.getClass().getSimpleName().startswith("Continuous"):
                return []
            splits.append((leaf, split.featureIndex(), split.threshold(), len(values)))
            todo += [(node.leftChild(), leaf), (node.rightChild(), len(values))]
            values.append(0.0)
        out.append((splits, values))
    return out


def out_of_envelope(scored: DataFrame, envelope: DataFrame, slack: float = 1e-5) -> DataFrame:
    """Names of the features outside the training envelope, per row."""
    bounds = envelope.agg(F.map_from_entries(F.collect_list(
        F.struct("feature", F.struct("min", "max")))).alias("__env"))
    # One row (13 entries), broadcast.
    staged = scored.crossJoin(F.broadcast(bounds))
    checks = [F.when((F.col(f) < F.element_at("__env", F.lit(f))["min"] - slack)
                     | (F.col(f) > F.element_at("__env", F.lit(f))["max"] + slack), F.lit(f))
              for f in FEATURES]
    return staged.withColumn("outside", F.array_compact(F.array(*checks))).drop("__env")


def grid_search(train_features: DataFrame, key: str = "QUERY_ID", target: str = "TARGET_MS",
                grid: dict | None = None, folds: int = N_FOLDS) -> DataFrame:
    """Each grid point scored by out-of-fold MAPE on the training rows
    only (holdout untouched). Returns (params, cv_mape_pct), best first."""
    from itertools import product
    grid = grid or {"max_depth": [2, 3], "step": [0.12, 0.3]}
    names = sorted(grid)
    spark = train_features.sparkSession
    train = train_features.filter(F.col("in_holdout") == 0)
    data = labelled(train, target).withColumn("__fold", fold_of(key, folds)).select(target, "label", "__fold", *FEATURES).cache()
    table = grouped(data, ["__fold"])
    points = [dict(zip(names, values)) for values in product(*[grid[k] for k in names])]
    fitted = [fit_all([table.filter(F.col("__fold") != k) for k in range(folds)], lambda p=p: new_gbt(max_iter=20, **p))
              for p in points]
    parts = []
    for k in range(folds):      # a fold's rows are read once for all points
        part = data.filter(F.col("__fold") == k)
        for i, models in enumerate(fitted):
            part = score(models[k], part, f"__p{i}")
        parts.append(part.select(F.col(target).alias("actual_ms"), *[f"__p{i}" for i in range(len(points))]))
    allp = parts[0]
    for part in parts[1:]:
        allp = allp.unionByName(part)
    error = [F.avg(F.abs(F.col(f"__p{i}") - F.col("actual_ms")) / F.col("actual_ms")) * 100.0 for i in range(len(points))]
    found = allp.agg(*[e.alias(f"m{i}") for i, e in enumerate(error)]).first()
    rows = [(", ".join(f"{k}={v}" for k, v in p.items()), float(found[i])) for i, p in enumerate(points)]
    table.unpersist()
    data.unpersist()
    return spark.createDataFrame(rows, "params string, cv_mape_pct double").orderBy("cv_mape_pct")


def predict_text(model, catalogue: DataFrame, text: str, warehouse_size: str,
                 index: DataFrame | None = None) -> float:
    """The runtime in ms of one statement before it runs. ``index``: the
    history's means by parameterised hash (``features.history_index``); without
    it, or for a shape not seen before, there is no prior."""
    from ..functions import shape as S
    from . import features as fe
    from .shape import check_warehouse
    spark = catalogue.sparkSession
    one = spark.createDataFrame([("statement", text, warehouse_size)],
                                "QUERY_ID string, QUERY_TEXT string, warehouse_size string")
    pre = one.select("QUERY_ID", "QUERY_TEXT", check_warehouse().alias("WAREHOUSE_SIZE"),
                     S.parameterized_hash(F.col("QUERY_TEXT")).alias("QUERY_PARAMETERIZED_HASH"))
    if index is not None:
        pre = fe.attach_prior(pre, index)
    return score(model, fe.featurise(pre, catalogue)).first()["predicted_ms"]


def save_model(model, path: str) -> None:
    """A fitted PipelineModel to a shared folder (feature order is the
    assembler's input list, stored with it)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
