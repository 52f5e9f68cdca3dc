import math
import random

import pytest
from pyspark.sql import functions as F

from shapecast.llm import pivot_search
from shapecast.llm.pivot_search import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    import numpy as np
    v = {}
    for i, e, _ in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        w = [math.floor(64 * float(np.float32(x))) for x in e]
        v[i] = min(v.get(i, w), w)
    out = []
    for q in v:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("n,block,queries", [(300, 4096, 8192), (400, 40, 3)])
def test_equals_brute_force(spark, monkeypatch, n, block, queries):
    monkeypatch.setattr(pivot_search, "BLOCK_ROWS", block)
    monkeypatch.setattr(pivot_search, "QUERY_ROWS", queries)
    monkeypatch.setattr(pivot_search, "SAMPLE", 30)
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(n)]
    same = [0.5] * 8
    rows += [(1000 + i, same, 1) for i in range(n // 2)]          # ties
    rows += [(2000, None, 0), (2020, [1.0, None] * 4, 0), (2040, [float("nan")] * 8, 0), (None, same, 0),
             (2060, [float("inf")] * 8, 0), (2080, [], 0), (2100, [3.0], 0), (20, [9.0] * 8, 0), (2120, [1e3] * 12, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("clash")).repartition(4)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, 7).collect())
    assert got == brute(rows, 7, 20)


def test_few_and_none(spark):
    rows = [(0, [1.0], 0), (1, [2.0], 0)]
    assert [tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20).collect()] == [(0, 1, 1, 8192)]
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0, 20).count() == 0
