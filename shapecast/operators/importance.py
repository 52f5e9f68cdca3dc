"""Permutation importance without sorting copies (M5).

The holdout rows are numbered once. Repeat r permutes the numbers by a keyed
bijection of [0, n) - four Feistel rounds on the next power of four, walked until
the value lies below n - so a row knows its donor's number without a sort; one
join brings the donor's features for all repeats. Each task then evaluates the
model with one feature replaced at a time and keeps error sums by (repeat,
feature): no row is copied per feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .features import FEATURES
from .ordinal import sorted_position

ROUNDS = 4


def _leaves(columns: list[np.ndarray], splits: Sequence[tuple]) -> np.ndarray:
    leaf = np.zeros(len(columns[0]), np.uint8)
    for at, feature, cut, new in splits:
        leaf[(leaf == at) & (columns[feature] > cut)] = new
    return leaf


def tree_rises(base: float, trees: Sequence[tuple], x: np.ndarray, other: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By feature: the sum of how much the absolute error rises when the rows ``x`` take
    that feature from ``other``. ``trees``: (splits, values) as of ``boosting.Grown``;
    only those that read the feature are evaluated again."""
    own, foreign = list(np.ascontiguousarray(x.T)), list(np.ascontiguousarray(other.T))
    score, change = np.full(len(y), base), np.zeros((x.shape[1], len(y)))
    for splits, values in trees:
        value = np.array(values, np.float64)
        here = value[_leaves(own, splits)]
        score += here
        for f in {s[1] for s in splits}:
            change[f] += value[_leaves([*own[:f], foreign[f], *own[f + 1:]], splits)] - here
    return (np.abs(score + change - y) - np.abs(score - y)).sum(axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """32 bits of hash of a 32-bit number (in 64-bit words)."""
    low = np.uint64(0xFFFFFFFF)
    x = (x * np.uint64(2654435761)) & low
    x ^= x >> np.uint64(15)
    x = (x * np.uint64(2246822519)) & low
    return x ^ (x >> np.uint64(13))


def half_bits(n: int) -> int:
    """Bits of each half of the Feistel word: 4^half >= n."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def donors(place: np.ndarray, repeat: int, n: int) -> np.ndarray:
    """Where the values of each place come from in a repeat: a permutation of [0, n)."""
    half = half_bits(n)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = place.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> shift, x & mask
        for i in range(ROUNDS):
            key = np.uint64((repeat * 0x9E3779B9 + i * 0x7F4A7C15) % 2**32)
            left, right = right, left ^ (_mixed((right + key) & np.uint64(0xFFFFFFFF)) & mask)
        out[walk] = left << shift | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def permutation_importance(holdout: DataFrame, log_ms: Callable[[np.ndarray], np.ndarray] | None, key: str = "QUERY_ID",
                           target: str = "TARGET_MS", repeats: int = 15, boosted: tuple | None = None) -> DataFrame:
    """feature, importance: the rise of the mean absolute error of the log runtime
    when the feature is permuted, mean of ``repeats`` (4 digits). ``log_ms`` scores
    rows of the 13 features; boosted trees come as ``boosted`` = (base, trees, bins of
    such rows) instead. No holdout row: no importance."""
    spark = holdout.sparkSession
    rows = sorted_position(holdout.select(F.col(key).alias("k"), F.log(target).alias("y"),
                                          F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x")).filter("y is not null"),
                           [], [F.col("k").asc()], "p").select((F.col("p") - 1).alias("p"), "y", "x")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "feature string, importance double")
    if boosted:
        base, trees, bins = boosted

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = bins(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("y"), pa.array([r.tobytes() for r in b], pa.binary())], ["p", "y", "x"])

        # a row's bins are all that the trees read: 13 bytes pass through the join
        rows = materialize(rows.mapInArrow(coded, "p long, y double, x binary"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").to_numpy()
            for r in range(1, repeats + 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), r, np.int32)), pa.array(donors(p, r, n)), batch.column("y"), batch.column("x")],
                                                 ["r", "donor", "y", "x"])

    def rises(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(FEATURES) + 1)
        for batch in batches:
            x, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, len(FEATURES)) for c in ("x", "dx"))
            sums[:-1] += tree_rises(base, trees, x, other, batch.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["s"])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((repeats + 1, len(FEATURES) + 1))
        for batch in batches:
            r, y = batch.column("r").to_numpy(), batch.column("y").to_numpy()
            x, other = (batch.column(c).flatten().to_numpy().reshape(len(y), -1) for c in ("x", "dx"))
            off = np.abs(log_ms(x) - y)
            np.add.at(sums[:, -1], r, off)
            for f in range(len(FEATURES)):
                changed = x.copy()
                changed[:, f] = other[:, f]
                np.add.at(sums[:, f], r, np.abs(log_ms(changed) - y))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums.sum(axis=0, keepdims=True)), pa.list_(pa.float64()))], ["s"])

    kind = "binary" if boosted else "array<double>"
    pairs = rows.mapInArrow(spread, f"r int, donor long, y double, x {kind}")
    joined = pairs.join(rows.select(F.col("p").alias("donor"), F.col("x").alias("dx")), "donor").select("r", "y", "x", "dx")
    total = (joined.mapInArrow(rises if boosted else errors, "s array<double>").select(F.posexplode("s").alias("f", "v"))
             .groupBy("f").agg(F.sum("v").alias("v")).collect())         # a number for each feature
    at = {r["f"]: r["v"] / (n * repeats) for r in total}
    return spark.createDataFrame([(f, round(at[i] - at[len(FEATURES)], 4)) for i, f in enumerate(FEATURES)], "feature string, importance double")
