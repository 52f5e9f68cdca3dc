"""Least squares from mergeable moments (M2).

``moments`` sums the products of (1, x1..xk, y) - one combinable aggregate, so
moments of batches and folds add up and a fold is taken out by subtraction;
no row is read again for another model. ``coefficients`` solves the normal
equations of such a row as one column expression: Gauss-Jordan elimination
folded over the variables. A variable whose remaining pivot is below
``TOLERANCE`` of its raw sum of squares (constant, or a combination of earlier
ones) gets the coefficient 0, which leaves the fitted values unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def place(i: int, j: int, k: int) -> int:
    """Where the product of variables i and j of (1, x1..xk, y) stands among the moments."""
    i, j = min(i, j), max(i, j)
    return i * (k + 2) - i * (i - 1) // 2 + j - i


def moments(x: list[str], y: Column) -> Column:
    """The upper triangle of the sums of products of (1, x1..xk, y), row by row, as
    one array<double>; rows without a target take no part."""
    z = [F.when(y.isNotNull(), F.lit(1.0)), *[F.when(y.isNotNull(), F.col(c).cast("double")) for c in x], y]
    return F.array(*[F.coalesce(F.sum(z[i] * z[j]), F.lit(0.0)) for i in range(len(z)) for j in range(i, len(z))])


def coefficients(m: Column, k: int) -> Column:
    """array<double> (intercept, then k slopes) of moments; 0s where there are no rows."""
    rows = [F.array(*[F.get(m, F.lit(place(i, j, k))) for j in range(k + 2)]) for i in range(k + 1)]
    raw = F.array(*[F.get(m, F.lit(place(i, i, k))) for i in range(k + 1)])

    def step(state: Column, v: Column) -> Column:
        g = state["g"]
        pivot = F.get(F.get(g, v), v)
        use = pivot > F.lit(TOLERANCE) * F.get(raw, v)
        of = F.get(g, v)
        swept = F.transform(g, lambda row, i: F.transform(row, lambda x, j: F.when(i == v, x / pivot)
                            .otherwise(x - F.get(row, v) * F.get(of, j) / pivot)))
        return F.struct(F.when(use, swept).otherwise(g).alias("g"), F.concat(state["used"], F.array(use)).alias("used"))

    start = F.struct(F.array(*rows).alias("g"), F.array().cast("array<boolean>").alias("used"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(k)), start, step, lambda s: F.transform(
        s["g"], lambda row, i: F.when(F.get(s["used"], i), F.get(row, F.lit(k + 1))).otherwise(F.lit(0.0))))


def fitted(coef: Column, x: list[str]) -> Column:
    """The linear predictor of a row."""
    out = F.get(coef, F.lit(0))
    for i, c in enumerate(x):
        out = out + F.get(coef, F.lit(i + 1)) * F.col(c).cast("double")
    return out
