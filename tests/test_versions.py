"""Mergeable least squares, additive version state and the one-pass report."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapecast.operators import linear as L
from shapecast.operators import metrics as M
from shapecast.operators import versions as V
from shapecast.operators.features import FEATURES


def log_rows(spark, batches=4, per=60, seed=3):
    """Feature rows of a log: a constant and two dependent features among the 13."""
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(batches):
        for i in range(per):
            x = rng.normal(3, 1, len(FEATURES))
            x[3], x[4], x[5] = 1.0, x[2] + 2.0, (0.0 if b < 2 else 1.0)
            y = 2 + 0.5 * x[0] - 0.2 * x[2] + 0.1 * rng.normal()
            rows.append((f"q{b}_{i}", f"batch_{b:02d}", i, float(np.exp(y)), float(np.round(np.exp(y), 3)), *map(float, x)))
    schema = "QUERY_ID string, QUERY_TAG string, pos long, TARGET_MS double, EXECUTION_TIME double, " + ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, schema).repartition(5), rows


def brute(rows):
    """Per version: indices of training and holdout rows, design and target."""
    x = np.array([r[5:] for r in rows])
    y = np.log([r[3] for r in rows])
    batch = np.array([int(r[1][-2:]) for r in rows])
    pos = np.array([r[2] for r in rows])
    out = {}
    for b in range(1, batch.max() + 2):
        hold = batch == b - 1
        train = batch < b - 1
        if b == 1:
            train = hold & (pos < math.floor(hold.sum() * 0.7))
            hold = hold & ~train
        out[b] = (train, hold)
    return x, y, out


def test_moments_add_up_and_solve_as_least_squares(spark):
    df, rows = log_rows(spark)
    x, y, _ = brute(rows)
    got = df.agg(L.moments(FEATURES, F.log("TARGET_MS")).alias("m")).select(L.coefficients(F.col("m"), len(FEATURES))).first()[0]
    a = np.c_[np.ones(len(x)), x]
    want = np.linalg.lstsq(a, y, rcond=None)[0]
    assert np.allclose(a @ np.array(got), a @ want, atol=1e-8)
    assert got[1 + 3] == 0.0        # the constant feature
    none = df.filter("1 = 0").agg(L.moments(FEATURES, F.log("TARGET_MS")).alias("m")).select(L.coefficients(F.col("m"), len(FEATURES))).first()[0]
    assert none == [0.0] * (len(FEATURES) + 1)


def test_version_models_come_from_the_state(spark):
    df, rows = log_rows(spark)
    x, y, parts = brute(rows)
    numbered = V.numbered(df)
    fold = {r["QUERY_ID"]: r["fold"] for r in numbered.select("QUERY_ID", "fold").collect()}
    fold = np.array([fold[r[0]] for r in rows])
    fits = {(r["b"], r["fold"]): r for r in V.models(V.state(numbered)).collect()}
    assert set(fits) == {(b, f) for b in parts for f in (-1, 0, 1, 2, 3, 4)}
    for (b, f), r in fits.items():
        at = parts[b][0] & (fold != f)
        a = np.c_[np.ones(at.sum()), x[at]]
        want = a @ np.linalg.lstsq(a, y[at], rcond=None)[0]
        assert r["n"] == at.sum() and np.allclose(a @ np.array(r["coef"]), want, atol=1e-7)
        slope, intercept = np.polyfit(x[at, 0], y[at], 1)
        assert r["slope"] == pytest.approx(slope) and r["intercept"] == pytest.approx(intercept)


def test_report_equals_a_loop_over_versions(spark):
    df, rows = log_rows(spark)
    x, y, parts = brute(rows)
    numbered = V.numbered(df)
    st = V.state(numbered)
    known = V.models(st).collect()
    model, base = V.OneFeature(known), V.Linear(known)
    found = V.metrics(V.report(numbered, model, base, sorted(parts), draws=400), V.names(st)).collect()
    fold = {r["QUERY_ID"]: r["fold"] for r in numbered.select("QUERY_ID", "fold").collect()}
    fold = np.array([fold[r[0]] for r in rows])
    ms = np.exp(y)
    for r in found:
        train, hold = parts[r["model_sequence"]]
        p = np.exp(model.log_ms(r["model_sequence"], -1, x[hold]))
        e = np.abs(p - ms[hold]) / ms[hold] * 100
        la, lp = np.log10(ms[hold]), np.log10(p)
        cv = np.concatenate([np.abs(np.exp(model.log_ms(r["model_sequence"], k, x[train & (fold == k)])) - ms[train & (fold == k)])
                             / ms[train & (fold == k)] for k in range(5)])
        assert (r["n_train_rows"], r["n_holdout_rows"]) == (train.sum(), hold.sum())
        assert r["holdout_mape_pct"] == pytest.approx(e.mean(), abs=1e-3)
        assert r["holdout_r2"] == pytest.approx(1 - ((la - lp) ** 2).sum() / ((la - la.mean()) ** 2).sum(), abs=1e-4)
        assert r["cv_mape_pct"] == pytest.approx(cv.mean() * 100, abs=1e-3)
        assert r["baseline_mape_pct"] == pytest.approx(
            (np.abs(np.exp(base.log_ms(r["model_sequence"], -1, x[hold])) - ms[hold]) / ms[hold]).mean() * 100, abs=1e-3)
        assert r["mape_ci_low_pct"] < r["holdout_mape_pct"] < r["mape_ci_high_pct"]


def test_a_later_batch_changes_no_earlier_state(spark):
    df, _ = log_rows(spark)
    key = lambda t: sorted((tuple(r) for r in t.select("bn", "fold", "tail", "n", "digest_sum", "digest_xor").collect()), key=str)
    early = key(V.state(V.numbered(df.filter("QUERY_TAG < 'batch_03'"))))
    assert early == [r for r in key(V.state(V.numbered(df))) if r[0] < 4]
    digest = M.training_digest(df).first()[0]
    assert V.names(V.state(V.numbered(df))).filter("b = 4").first()["model_version"] == f"v4-{digest}"


def test_draw_weights_are_poisson_of_mean_one():
    w = V.draw_weights(np.arange(3000) * 2654435761 % 2**32, 200)
    assert w.mean() == pytest.approx(1.0, abs=0.01) and w.var() == pytest.approx(1.0, abs=0.02)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25
