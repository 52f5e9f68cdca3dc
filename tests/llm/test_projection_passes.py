import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapecast.llm import projection_passes
from shapecast.llm.projection_passes import link

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=0.93):
    ok = [e is not None and g is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e) for _, e, g in rows]
    unit = [np.array(e) / np.abs(e).max() if good else None for (_, e, _), good in zip(rows, ok)]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    out = []
    for a, (i, _, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        least_id = min(ids, default=None)
        out.append((i, links[a], least_id, i == least_id))
    return sorted(out, key=repr)


def vectors(seed, n):
    """Groups of near copies of several sizes and spreads, single vectors, odd rows."""
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for size, spread in [(1, 0), (2, 0.1), (3, 0.2), (40, 0.12), (25, 0.3)] * n:
        base, label = rng.standard_normal(16), int(rng.integers(3))
        for _ in range(size):
            rows.append((i, (base + spread * rng.standard_normal(16)).tolist(), label))
            i += 1
    same = rng.standard_normal(16)
    rows += [(5000 + k, same.tolist(), 1) for k in range(30)] + [(5100, (2 * same).tolist(), 1), (5101, same.tolist(), 2)]
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * 16, 1), (6003, [1.0, None], 1), (6004, [float("nan")] * 16, 1),
             (6005, [float("inf")] * 16, 1), (6006, same.tolist(), None), (6007, same.tolist(), None), (None, same.tolist(), 1),
             (None, [1.0, 2.0], 1), (5000, same.tolist(), 1), (6008, [1e308, 1e308], 0), (6009, [1e-300, 1e-300], 0), (None, None, None)]
    return rows


@pytest.mark.parametrize("seed,n,window,tile", [(1, 2, 512, 1024), (2, 3, 24, 16)])
def test_equals_brute_force(spark, monkeypatch, seed, n, window, tile):
    """With the module's blocks, and with blocks and tiles that groups do not fit into."""
    monkeypatch.setattr(projection_passes, "WINDOW", window)
    monkeypatch.setattr(projection_passes, "TILE", tile)
    monkeypatch.setattr(projection_passes, "BUCKET", 4 * tile)
    rows = vectors(seed, n)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("unit", F.lit("x")).withColumn("key", F.lit(1)).repartition(3)
    got = link(df, recall=0.9999)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty_and_unusable(spark):
    assert link(spark.createDataFrame([], SCHEMA)).count() == 0
    got = link(spark.createDataFrame([(1, None, 1), (2, [0.0], 1), (3, [1.0], None)], SCHEMA))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_float_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.1], 1), (2, [1.0, 0.1], 1), (3, [0.1, -1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, link(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
