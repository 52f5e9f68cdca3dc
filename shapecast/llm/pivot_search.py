"""Exact top-k inner product by pivot-table elimination.

Vectors are scaled to integers. Every row stores its distances to many pivots;
for a query the largest difference of two such distances is a lower bound of
the distance to the row, and with the norms an upper bound of the inner
product. Candidates are evaluated in the order of that bound until the next
bound is below the k-th score found, so the result is exact, ties included.

Rows are dealt into blocks by their nearest pivot (a crowded pivot gets several
blocks, by the hash of the id), queries into parts; a block first rules out
queries by the range of its pivot distances. Blocks and query parts meet by
their keys, a query's copies being sent only to blocks that may hold one of its
results.

Defined cases: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; rows that repeat an id count once (the
least vector in array order); components beyond the shorter of two vectors
count as zero; an empty table gives no rows; with fewer than k other rows all
are returned; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PIVOTS = 16
#: Rows looked at for pivots and for the first threshold of a query.
SAMPLE = 1024
BLOCK_ROWS, MAX_BLOCKS = 4096, 2048
QUERY_ROWS = 8192
#: Candidates evaluated first, those of the highest bounds.
FIRST = 128
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of the rows that take part."""
    v = F.col(vector_col)
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("e")).where(
        F.col("vec_id").isNotNull() & F.col("e").isNotNull()
        & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # floor() of a double is a long in Spark: far larger components keep their double value
    whole: Column = F.transform("e", lambda x: F.when(F.abs(x) < 1e15, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return good.select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, x in enumerate(column):
        out[i, :len(x)] = x
    return out


def _pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first choice among the sample."""
    chosen = [0]
    dist = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < most and dist.max() > 0:
        chosen.append(int(dist.argmax()))
        dist = np.minimum(dist, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T))


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where these are exact."""
    if x.dtype == np.float32 or not len(x) or np.sqrt((x * x).sum(1).max() * (q * q).sum()) < 2**52:
        return np.rint(x @ q.astype(x.dtype)).astype(np.int64)
    to_int = np.vectorize(int, otypes=[object])
    exact = to_int(x) @ to_int(q)
    return np.array([max(-2**63, min(2**63 - 1, int(s))) for s in exact], dtype=np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(query_id, q, dq, floor_score, ids, x, dist, norm2, slack, k):
    """The block's best for one query, evaluated in bound order. ``dist`` has a row for each pivot."""
    low, away = np.zeros(len(ids), dist.dtype), np.empty(len(ids), dist.dtype)
    for row, d in zip(dist, dq):
        np.subtract(row, d, out=away)
        np.abs(away, out=away)
        np.maximum(low, away, out=low)
    low = np.maximum(low - slack, 0)
    bound = (norm2 + (q * q).sum() - low * low) / 2 + slack
    bound[ids == query_id] = -np.inf
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    left = np.flatnonzero(bound >= floor_score)
    step = FIRST
    while len(left):
        # the next candidates in the order of their bounds
        if len(left) > step:
            some = left[np.argpartition(-bound[left], step)[:step]]
        else:
            some = left
        scores = _scores(x, q)[some] if len(some) * 4 > len(x) else _scores(x[some], q)
        good = scores >= (best[-1] if len(best) == k else floor_score)
        best_ids, best = _best(np.r_[best_ids, ids[some[good]]], np.r_[best, scores[good]], k)
        bound[some] = -np.inf
        # whatever is bounded below the k-th score is never evaluated
        left = left[bound[left] >= max(floor_score, best[-1] if len(best) == k else floor_score)]
        step = len(x)
    return best_ids, best


def top_k(rows: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest inner
    products over all other rows, ties to the smaller id. ``is_query`` is a
    condition on ``vec_id``."""
    data = written(integer_vectors(rows, id_col, vector_col, scale), "vectors")
    n, nq, dims = data.select(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first()
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    dims = max(1, dims or 0)
    seen_ids = np.array([r["vec_id"] for r in sample], np.int64)
    seen = _matrix([r["v"] for r in sample], dims)
    pivots = _pivots(seen, PIVOTS) if len(seen) else np.zeros((1, dims))
    parts = max(1, -(-nq // QUERY_ROWS))
    room = max(BLOCK_ROWS, -(-n // MAX_BLOCKS))

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(_distances(_matrix(v, dims), pivots).argmin(axis=1).astype(np.int32))

    # a crowded pivot's rows are dealt by hash over as many blocks as it needs
    near = data.withColumn("near", nearest("v"))
    crowd = {r["near"]: r["count"] for r in near.groupBy("near").count().collect()}
    split = F.element_at(F.create_map(*[x for p in range(len(pivots)) for x in (F.lit(p), F.lit(max(1, -(-crowd.get(p, 0) // room))))]), F.col("near"))
    base = np.cumsum([0] + [max(1, -(-crowd.get(p, 0) // room)) for p in range(len(pivots))])
    first = F.element_at(F.array(*[F.lit(int(b)) for b in base[:-1]]), F.col("near") + 1)
    blocked = written(near.select("vec_id", "v", (first + F.pmod(F.xxhash64("vec_id"), split)).cast("int").alias("block")), "blocks")

    def summary(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high, norm = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), 0.0
        for pdf in batches:
            x = _matrix(pdf["v"], dims)
            d = _distances(x, pivots)
            low, high, norm = np.minimum(low, d.min(0)), np.maximum(high, d.max(0)), max(norm, float((x * x).sum(1).max()))
        yield pd.DataFrame({"block": [key[0]], "low": [low.tolist()], "high": [high.tolist()], "norm": [norm]})

    # one short row per block, MAX_BLOCKS and PIVOTS of them at most
    blocks = blocked.groupBy("block").applyInPandas(
        summary, "block int, low array<double>, high array<double>, norm double").orderBy("block").collect()
    low, high = (np.array([r[c] for r in blocks]).reshape(len(blocks), len(pivots)) for c in ("low", "high"))
    norm = np.array([r["norm"] for r in blocks])
    number = [r["block"] for r in blocks]
    slack = 1e-5 * (1 + float(norm.max()) if len(norm) else 1)     # covers the rounding of 32-bit bounds

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query's threshold from the sample, and the blocks that may reach it."""
        for pdf in batches:
            out = []
            x = _matrix(pdf["v"], dims)
            dq = _distances(x, pivots)
            for i, (query, part) in enumerate(zip(pdf["vec_id"], pdf["part"])):
                got = np.sort(_scores(seen, x[i])[seen_ids != query])
                floor_score = int(got[-k]) if len(got) >= k else -2**63
                away = np.maximum(0, np.maximum(dq[i] - high, low - dq[i]).max(axis=1) - slack)
                bound = (norm + (x[i] * x[i]).sum() - away * away) / 2 + slack
                out += [(b, part, query, x[i], floor_score) for b, u in zip(number, bound) if u >= floor_score]
            yield pd.DataFrame(out, columns=["block", "part", "query_id", "q", "least"])

    queries = (blocked.where(is_query).select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
               .mapInPandas(route, "block int, part int, query_id long, q array<double>, least long"))
    targets = blocked.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "v")

    def meet(key: tuple, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(asked):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in FOUND.split(", ")})
        x = _matrix(block["v"], dims)
        ids, norm2 = block["vec_id"].to_numpy(np.int64), (x * x).sum(1)
        dist = np.ascontiguousarray(_distances(x, pivots).T, np.float32)
        small = max(norm2.max(), max(float(np.square(v).sum()) for v in asked["q"])) < 2**22
        if small:                                        # sums of such products are exact in 32 bits
            x, norm2 = x.astype(np.float32), norm2.astype(np.float32)
        found = []
        for query, v, least in zip(asked["query_id"], asked["q"], asked["least"]):
            q = np.asarray(v, float)
            got = _search(query, q, _distances(q[None], pivots)[0], least, ids, x, dist, norm2, slack, k)
            found.append((np.full(len(got[0]), query, np.int64), *got))
        return pd.DataFrame({c.split()[0]: np.concatenate(a) for c, a in zip(FOUND.split(", "), zip(*found))})

    found = (targets.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(meet, FOUND))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
