"""Histogram boosting: splits, growth, cells, all models in the same passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapecast.operators import boosting as B
from shapecast.operators import versions as V
from shapecast.operators.features import FEATURES

FITS = B.Setting(rounds=6, rate=0.5, leaves=5, least_rows=4)


def rows_of(spark, batches=3, per=80, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(batches):
        for i in range(per):
            x = rng.integers(0, 4, len(FEATURES)).astype(float)
            x[1] = float(rng.integers(0, 200))          # more values than bins
            x[2] = 7.0                                  # constant
            y = 3 + (x[0] > 1) * 1.5 + (x[0] > 1) * (x[3] > 2) - 0.004 * x[1] + 0.05 * rng.normal()
            rows.append((f"q{b}_{i}", f"batch_{b:02d}", i, float(np.exp(y)), float(np.exp(y)), *map(float, x)))
    schema = "QUERY_ID string, QUERY_TAG string, pos long, TARGET_MS double, EXECUTION_TIME double, " + ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, schema).repartition(4)


def brute_fit(bins, y, use):
    """Leaf-wise growth on rows, one split at a time; scores of the rows."""
    base = y.mean()
    score = np.full(len(y), base)
    for _ in range(use.rounds):
        g = y - score
        leaf, leaves = np.zeros(len(y), int), 1

        def best(v):
            at = np.flatnonzero(leaf == v)
            out = (0.0, None)
            for k in range(bins.shape[1]):
                for c in range(B.BINS - 1):
                    low = bins[at, k] <= c
                    if low.sum() >= use.least_rows and (~low).sum() >= use.least_rows:
                        gain = g[at][low].sum() ** 2 / low.sum() + g[at][~low].sum() ** 2 / (~low).sum() - g[at].sum() ** 2 / len(at)
                        if gain > out[0] * (1 + 1e-12) + 1e-12:
                            out = (gain, (k, c))
            return out

        found = {0: best(0)}
        while leaves < use.leaves:
            v = max(found, key=lambda i: found[i][0])
            if not found[v][1]:
                break
            k, c = found[v][1]
            leaf[(leaf == v) & (bins[:, k] > c)] = leaves
            found[v], found[leaves] = best(v), best(leaves)
            leaves += 1
        for v in range(leaves):
            score[leaf == v] += use.rate * g[leaf == v].mean()
    return base, score


@pytest.fixture(scope="module")
def fitted(spark):
    rows = V.numbered(rows_of(spark))
    names = B.model_names([1, 2, 3])
    return rows, names, B.fit(rows, names, FITS)


def test_every_model_equals_growth_on_its_own_rows(fitted):
    """Nineteen models grown in the same passes over cells, against one at a time over rows."""
    rows, names, model = fitted
    got = rows.select("bn", "tail", "fold", "TARGET_MS", F.array(*FEATURES).alias("x")).collect()
    x = np.array([r["x"] for r in got])
    bn, tail, fold = (np.array([r[c] for r in got]) for c in ("bn", "tail", "fold"))
    y = np.log([r["TARGET_MS"] for r in got])
    bins = B.to_bins(x, model.edges)
    assert len(names) == 19 and bins.max() < B.BINS
    for name in names[::4] + names[-1:]:
        at = B.in_training(name, bn, tail, fold)
        base, score = brute_fit(bins[at], y[at], FITS)
        assert model.base[name] == pytest.approx(base)
        assert np.allclose(model.log_ms(*name, x[at]), score, atol=1e-8)
        assert all(len(values) <= FITS.leaves for _, values in model.trees[name])


def test_predictions_cover_every_row_once(fitted, spark, tmp_path):
    rows, _, model = fitted
    got = B.predict(rows, model, 3)
    assert got.count() == got.select("QUERY_ID").distinct().count() == 240
    assert got.filter("in_holdout = 1").count() == 80 and got.filter("predicted_ms <= 0").count() == 0
    assert B.predict(rows, model, 1).filter("in_holdout = 1").count() == 24
    model.save(spark, f"{tmp_path}/model")
    back = B.Boosted.load(spark, f"{tmp_path}/model")
    one = lambda m: sorted(tuple(r) for r in B.predict(rows, m, 3, deployed=True).collect())
    assert one(back) == one(model)


def test_cuts_are_values_and_ranks(spark):
    df = spark.createDataFrame([tuple([float(i % 3), float(i)] + [1.0] * (len(FEATURES) - 2)) for i in range(256)], FEATURES)
    got = B.cuts(df)
    assert got[0].tolist() == [0.0, 1.0] and got[2].tolist() == []
    assert len(got[1]) == B.BINS - 1 and got[1][0] == 3.0 and got[1][-1] == 251.0
    assert B.to_bins(np.array([[0.0, 3.0] + [1.0] * 11, [9.0, 3.5] + [2.0] * 11]), got)[:, :3].tolist() == [[0, 0, 0], [2, 1, 0]]


def test_too_few_rows_are_refused(spark):
    few = V.numbered(rows_of(spark, batches=1, per=11))
    with pytest.raises(ValueError, match="too few"):
        B.fit(few, B.model_names([1]))
    with pytest.raises(ValueError, match="too few"):
        V.trainable(V.state(few))
    assert V.trainable(V.state(V.numbered(rows_of(spark, batches=3, per=5)))) == [3]


def test_grid_keeps_the_winner_and_leaves_the_holdout_alone(spark):
    grid = {"rate": (0.1, 0.5), "rounds": (4, 8), "leaves": (2, 5), "least_rows": (4,), "l2": (0.0,)}
    rows = V.numbered(rows_of(spark))
    every = B.grid_search(rows, 3, grid, exact=True, step=2)
    some = B.grid_search(rows, 3, grid, step=2)
    assert len(every) == len(some) == 8 and all(e is not None for _, e in every)
    assert some[0][0] == every[0][0] and some[0][1] == pytest.approx(every[0][1])
    assert any(e is None for _, e in some)
    # the error is that of models fitted one by one, and no holdout row counts
    point, error = every[0]
    names = [(3, k) for k in range(5)]
    model = B.fit(rows, names, B.Setting(**point))
    kept = rows.filter("bn < 3").select("fold", "TARGET_MS", F.array(*FEATURES).alias("x")).collect()
    off = [abs(np.exp(model.log_ms(3, r["fold"], np.array([r["x"]]))[0]) - r["TARGET_MS"]) / r["TARGET_MS"] for r in kept]
    assert error == pytest.approx(np.mean(off) * 100)
    changed = rows.withColumn("TARGET_MS", F.when(F.col("bn") == 3, F.col("TARGET_MS") * 7).otherwise(F.col("TARGET_MS")))
    assert B.grid_search(changed, 3, grid, exact=True, step=2)[0][1] == pytest.approx(error)


def test_the_grid_query_scores_every_point(spark, monkeypatch):
    from shapecast.plans import q_boosted as Q
    grid = {"rate": (0.1, 0.5), "rounds": (9, 18), "leaves": (2, 5), "least_rows": (4,), "l2": (0.0,)}
    monkeypatch.setattr(B, "GRID", grid)
    monkeypatch.setattr(Q.E, "numbered", lambda *_: V.numbered(rows_of(spark)))
    monkeypatch.setattr(Q.E, "state", lambda *_: V.state(V.numbered(rows_of(spark))))
    got = Q.grid(spark, "rows").collect()
    assert len(got) == 8 and all(r["cv_mape_pct"] is not None for r in got)
    assert [r["cv_mape_pct"] for r in got] == sorted(r["cv_mape_pct"] for r in got)


def test_passes_have_tasks_by_cells_not_by_shuffle_partitions(spark):
    from shapecast.session import LEAST_ROWS, MOST_ROWS, even_tasks
    rows = V.numbered(rows_of(spark))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        growth = B.Growth(rows, [(3, B.HOLDOUT)], [FITS])
        assert growth.scored.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    cores = spark.sparkContext.defaultParallelism
    assert even_tasks(spark, 0) == 1 and even_tasks(spark, LEAST_ROWS * cores) == cores
    assert even_tasks(spark, MOST_ROWS * 100 * cores) == 100 * cores


def test_a_pass_is_one_job_and_frees_the_blocks_before_it(spark):
    sc, keep = spark.sparkContext, B.KEEP
    growth = B.Growth(V.numbered(rows_of(spark)), [(3, B.HOLDOUT), (2, B.HOLDOUT)], [B.Setting(leaves=2)] * 2)
    sc.setJobGroup("boosted-passes", "rounds of one pass each")
    try:
        for _ in range(2 * keep + 1):
            growth.round()
        assert len(sc.statusTracker().getJobIdsForGroup("boosted-passes")) == 2 * keep + 1
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(growth.kept) == 1 and len(growth.recent[0]) == 1 and len(growth.trees[0]) == 2 * keep + 1
    growth.close()
    assert not growth.kept[0].getStorageLevel().useMemory


def test_no_model_waits_for_another(spark):
    """Models with trees of many passes and of few share them: together they take as many as the slowest one alone."""
    rows, names, rounds = V.numbered(rows_of(spark)), [(3, B.HOLDOUT), (2, B.HOLDOUT)], 6
    settings, sc = [B.Setting(leaves=7), B.Setting(leaves=4)], spark.sparkContext

    def grown(which, group):
        growth = B.Growth(rows, [names[i] for i in which], [settings[i] for i in which])
        sc.setJobGroup(group, "boosted trees at their own pace")
        try:
            growth.grow(rounds)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        growth.close()
        return growth.trees, len(sc.statusTracker().getJobIdsForGroup(group))

    alone = [grown([i], f"boosted-alone-{i}") for i in (0, 1)]
    trees, passes = grown([0, 1], "boosted-together")
    assert passes == max(n for _, n in alone)
    for got, ((want,), _) in zip(trees, alone):
        assert len(got) == rounds and [s for s, _ in got] == [s for s, _ in want]
        assert all(v == pytest.approx(w) for (_, v), (_, w) in zip(got, want))
