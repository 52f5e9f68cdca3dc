"""Row numbers without a whole group in one task agree with row_number()."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shapecast.operators.ordinal import block_position, sorted_position


def skewed(spark, n=3000):
    # one key holds a third of the rows
    return spark.range(n).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 17).cast("string"))).alias("g"),
        ((F.col("id") * 7919) % 101).cast("double").alias("v"))


def test_block_position_matches_row_number(spark):
    df = skewed(spark)
    want = df.withColumn("p", F.row_number().over(W.partitionBy("g").orderBy("seq")) - 1)
    got = block_position(df, ["g"], "seq", "p", block_size=64)
    assert want.select("seq", "p").exceptAll(got.select("seq", "p")).count() == 0
    assert got.count() == df.count()


def test_sorted_position_matches_row_number(spark):
    df = skewed(spark)
    order = [F.col("v").desc(), F.col("seq").asc()]
    want = df.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(*order)))
    got = sorted_position(df, ["g"], order, "r", partitions=7)
    assert want.select("seq", "r").exceptAll(got.select("seq", "r")).count() == 0
    assert got.count() == df.count()


def test_global_rank_without_groups(spark):
    df = skewed(spark, 500)
    got = sorted_position(df, [], [F.col("v").asc(), F.col("seq").asc()], "r", partitions=5)
    ranks = sorted(r["r"] for r in got.collect())
    assert ranks == list(range(1, 501))


def test_exact_percentile_and_rank_value_match_the_aggregates(spark):
    from shapecast.operators.ordinal import exact_percentile, rank_value
    df = skewed(spark, 1001)
    want = {r["g"]: (r["m"], r["q"]) for r in df.groupBy("g").agg(
        F.percentile("v", 0.5).alias("m"), F.percentile("v", 0.9).alias("q")).collect()}
    med = {r["g"]: r["m"] for r in exact_percentile(df, ["g"], "v", 0.5, "m").collect()}
    p90 = {r["g"]: r["q"] for r in exact_percentile(df, ["g"], "v", 0.9, "q").collect()}
    assert set(med) == set(want)
    for g, (m, q) in want.items():
        assert abs(med[g] - m) < 1e-9 and abs(p90[g] - q) < 1e-9
    upper = {r["g"]: r["u"] for r in rank_value(df, ["g"], "v", lambda n: F.floor(n / 2) + 1,
                                                "u").collect()}
    for g in want:
        vals = sorted(r["v"] for r in df.filter(F.col("g") == g).collect())
        assert upper[g] == vals[len(vals) // 2]


def test_null_group_keys_are_a_group(spark):
    from shapecast.operators.ordinal import exact_percentiles, rank_value
    df = spark.createDataFrame([(None, i, float(i)) for i in range(5)] + [("a", i, float(-i)) for i in range(4)],
                               "g string, seq long, v double")
    got = block_position(df, ["g"], "seq", "p", block_size=2)
    assert sorted((r["p"] for r in got.filter("g is null").collect())) == [0, 1, 2, 3, 4]
    got = sorted_position(df, ["g"], [F.col("v").desc()], "r", partitions=3)
    assert sorted((r["r"], r["v"]) for r in got.filter("g is null").collect()) == [(i + 1, 4.0 - i) for i in range(5)]
    assert got.columns == ["g", "seq", "v", "r"] and got.count() == 9
    med = {r["g"]: (r["m"], r["s"]) for r in exact_percentiles(df, ["g"], {"v": "m", "seq": "s"}, 0.5).collect()}
    assert med == {None: (2.0, 2.0), "a": (-1.5, 1.5)}
    assert rank_value(df, ["g"], "v", lambda n: n, "top").count() == 2


def test_a_batch_of_a_million_rows_is_many_blocks(spark):
    from shapecast.operators.ordinal import DEFAULT_BLOCK
    df = spark.range(1_000_000).select(F.col("id").alias("seq"), F.lit("hot").alias("g"))
    got = block_position(df, ["g"], "seq", "p")
    assert got.agg(F.countDistinct(F.floor(F.col("seq") / DEFAULT_BLOCK))).first()[0] == 16
    assert got.where("p <> seq").count() == 0 and got.count() == 1_000_000


def test_a_value_of_most_rows_is_sorted_as_one(spark, monkeypatch):
    from shapecast.operators import ordinal as O
    rows = [(None if i % 3 else "a", 5.0 if i % 10 else float(i), float(i % 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, u double")
    seen, plain = [], O.materialize
    monkeypatch.setattr(O, "materialize", lambda d: seen.append(plain(d)) or seen[-1])
    got = {r.g: (r.p, r.s) for r in O.exact_percentiles(df, ["g"], {"v": "p", "u": "s"}, 0.35).collect()}
    assert max(d.count() for d in seen) <= 400
    want = {r.g: (r.p, r.s) for r in df.groupBy("g").agg(F.percentile("v", 0.35).alias("p"), F.percentile("u", 0.35).alias("s")).collect()}
    assert got == {g: (pytest.approx(p), pytest.approx(s)) for g, (p, s) in want.items()}
