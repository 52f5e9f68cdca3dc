"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Joins each node's neighbours to the least of them (and it). Large stars
    move the neighbours above a node, small stars those below and itself."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = near.join(least, "u")
    if large:
        return out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    moved = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges``: u, v of one comparable type. Returns node, root (the least node
    of the component) for each node that is not a root. The table shrinks to a
    star for each component; each round is written, none passes the driver."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        state = now.select(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(state) == mark or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(state)
        now = written(_star(_star(now, True), False), "edges")
    raise RuntimeError("components did not settle")
