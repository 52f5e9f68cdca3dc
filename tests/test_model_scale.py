"""Fits, importance and bootstrap at size: as on rows and copies, without passing over them."""

import math

import pytest

from shapecast.operators import model as MO
from shapecast.operators.features import FEATURES


def _repeated(spark, groups=20, copies=30):
    import random
    rng = random.Random(3)
    kinds = [[float(rng.randrange(5)) for _ in FEATURES] for _ in range(groups)]
    rows = [(f"q{g}_{i}", f"b{i % 3}", i * groups + g, math.exp(x[0] - 0.5 * x[3] + 0.1 * rng.gauss(0, 1)), *x)
            for g, x in enumerate(kinds) for i in range(copies)]
    return spark.createDataFrame(rows, "QUERY_ID string, QUERY_TAG string, seq long, TARGET_MS double, "
                                 + ", ".join(f"{f} double" for f in FEATURES))


def test_fits_pass_over_groups_of_equal_rows_and_score_as_fits_on_rows(spark, monkeypatch):
    rows, sizes, plain = MO.split(_repeated(spark)), [], MO.fit_all
    monkeypatch.setattr(MO, "fit_all", lambda sets, factory, **k: sizes.extend(d.count() for d in sets) or plain(sets, factory, **k))
    got, _, deployed = MO.fit_and_score(rows, lambda: MO.new_gbt(max_iter=5))
    by_rows = MO.pipeline(MO.new_gbt(max_iter=5)).fit(MO.labelled(rows))
    a, b = ({r.QUERY_ID: r.predicted_ms for r in MO.score(m, rows).collect()} for m in (deployed, by_rows))
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in b)
    assert sizes[-1] <= 20 * 10 < rows.count() and got.count() == rows.count()
    assert all(n <= 20 * 5 for n in sizes[:-1])
    held = MO.pipeline(MO.new_gbt(max_iter=5)).fit(MO.labelled(rows.filter("in_holdout = 0")))
    c = {r.QUERY_ID: round(r.predicted_ms, 3) for r in MO.score(held, rows.filter("in_holdout = 1")).collect()}
    assert all(math.isclose(r.predicted_ms, c[r.QUERY_ID], rel_tol=1e-3) for r in got.filter("in_holdout = 1").collect())
    best = MO.grid_search(rows, grid={"max_depth": [2], "step": [0.3, 0.1]})
    assert best.count() == 2 and all(n <= 20 * 5 for n in sizes[7:]) and len(sizes) == 7 + 2 * 5


def test_permutation_importance_sorts_hashes_and_is_that_of_the_copies(spark, monkeypatch):
    import hashlib

    from shapecast.operators import ordinal
    rows = MO.split(_repeated(spark)).filter("in_holdout = 1")
    model = MO.fit(_repeated(spark), lambda: MO.new_gbt(max_iter=4))
    seen, plain = [], ordinal.sorted_position
    monkeypatch.setattr(ordinal, "sorted_position", lambda df, *a, **k: seen.append((df.count(), df.columns)) or plain(df, *a, **k))
    got = {r.feature: r.importance for r in MO.permutation_importance(model, rows, repeats=3).collect()}
    assert all(not set(FEATURES) & set(c) and "__vals" not in c for n, c in seen if n > rows.count())
    own = sorted(rows.collect(), key=lambda r: r.QUERY_ID)
    changed, schema = [], "f string, label double, " + ", ".join(f"{f} double" for f in FEATURES)
    for k in (1, 2, 3):
        donors = sorted(own, key=lambda r: hashlib.md5(f"{r.QUERY_ID}:{k}".encode()).hexdigest())
        for r, d in zip(own, donors):
            changed += [(f, math.log(r.TARGET_MS), *[d[g] if g == f else r[g] for g in FEATURES]) for f in [*FEATURES, "none"]]
    off = model.transform(spark.createDataFrame(changed, schema)).selectExpr("f", "abs(prediction - label) as e").groupBy("f").avg("e")
    mean = {r[0]: r[1] for r in off.collect()}
    assert got == {f: pytest.approx(mean[f] - mean["none"], abs=6e-5) for f in FEATURES} and max(got.values()) > 0.1


def test_bootstrap_draws_are_those_of_the_md5_of_key_and_draw(spark):
    import hashlib

    import numpy as np

    from shapecast.operators import metrics as M
    rows = [(f"query {i}" * (1 + 9 * (i % 3)), 10.0 + i, 12.0 + i % 5) for i in range(30)]
    frame = spark.createDataFrame([*rows, ("é", 5.0, 6.0)], "query_id string, actual_ms double, predicted_ms double")
    got = M.bootstrap_mape_ci(frame, draws=120)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()       # no row a draw
    cdf, means = M.poisson_cdf(), []
    for d in range(1, 121):
        heads = [int(hashlib.md5(f"{r.query_id}:{d}".encode()).hexdigest()[:8], 16) / 2**32 for r in frame.collect()]
        w = [sum(u >= c for c in cdf) for u in heads]
        means.append(sum(k * abs(r.predicted_ms - r.actual_ms) / r.actual_ms * 100 for k, r in zip(w, frame.collect())) / sum(w))
    assert list(got.first()) == pytest.approx([np.percentile(means, 2.5), np.percentile(means, 97.5)])


def test_importance_of_boosted_trees_equals_scoring_every_copy(spark):
    import numpy as np

    from shapecast.operators.importance import tree_rises
    rng = np.random.default_rng(4)
    x, other, y = rng.integers(0, 9, (60, 13)).astype(np.uint8), rng.integers(0, 9, (60, 13)).astype(np.uint8), rng.normal(size=60)
    trees = [([(0, 2, 4, 1), (1, 5, 3, 2), (0, 2, 1, 3)], [0.1, -0.4, 0.7, 0.2]), ([(0, 7, 6, 1)], [0.3, -0.3])]

    def score(rows):
        out = np.full(len(rows), 0.25)
        for splits, values in trees:
            for i, r in enumerate(rows):
                leaf = 0
                for at, f, cut, new in splits:
                    leaf = new if leaf == at and r[f] > cut else leaf
                out[i] += values[leaf]
        return out

    want = []
    for f in range(13):
        changed = x.copy()
        changed[:, f] = other[:, f]
        want.append((np.abs(score(changed) - y) - np.abs(score(x) - y)).sum())
    assert np.allclose(tree_rises(0.25, trees, x, other, y), want)


def test_importance_of_boosted_models_joins_bins_and_equals_scoring_every_row(spark):
    from shapecast.operators import boosting as B
    from shapecast.operators import versions as V
    from shapecast.operators.importance import permutation_importance
    rows = V.numbered(_repeated(spark).selectExpr("*", "seq as pos", "TARGET_MS as EXECUTION_TIME"))
    m = B.fit(rows, [(2, B.HOLDOUT)], B.Setting(rounds=4, rate=0.4))
    hold = rows.filter("bn = 2")
    trees = (m.base[2, B.HOLDOUT], m.trees[2, B.HOLDOUT], lambda x: B.to_bins(x, m.edges))
    by_bins = {r.feature: r.importance for r in permutation_importance(hold, None, boosted=trees).collect()}
    by_rows = {r.feature: r.importance for r in permutation_importance(hold, lambda x: m.log_ms(2, B.HOLDOUT, x)).collect()}
    assert by_bins == pytest.approx(by_rows, abs=1.1e-4) and max(by_bins.values()) > 0.1


def test_weights_are_the_inverse_cdf_of_the_hash():
    import numpy as np

    from shapecast.operators import draws as D
    from shapecast.operators import versions as V
    edges = [int(c * 2**32) + d for c in V.CDF for d in (-1, 0, 1) if 0 <= int(c * 2**32) + d < 2**32]
    h = np.array([0, 2**32 - 1, *edges, *range(0, 2**32, 40_000_003)], np.uint32)
    want = np.searchsorted(V.CDF, h / 4294967296.0, side="right")
    assert (D.weights_of(h, D.least_hashes(V.CDF)) == want).all()
