"""Publishing as one commit; cells typed one by one; permutation without sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapecast.operators import importance as I
from shapecast.operators.features import FEATURES
from shapecast.sources import history_io as IO
from shapecast.sources import publish as P


def tables(spark, n):
    return {"a": spark.range(n).toDF("x"), "b": spark.range(2 * n).toDF("y")}


def verdict(ok):
    def run(staged):
        assert set(staged) == {"a", "b"}
        rows = staged["a"].count()
        return staged["a"].sparkSession.createDataFrame([("rows", ok, f"{rows} rows")], "check string, ok boolean, detail string")
    return run


def test_readers_follow_the_last_complete_set(spark, tmp_path):
    root = str(tmp_path / "out")
    assert P.manifest(spark, root) is None and P.counts(spark, root).count() == 0
    with pytest.raises(KeyError):
        P.published(spark, root, "a")
    P.publish_set(tables(spark, 3), root, verdict(True))
    assert P.published(spark, root, "b").count() == 6
    old = P.published(spark, root, "a")
    # a failed check: nothing is published, the staged set stays unseen
    with pytest.raises(P.ChecksFailed, match="rows"):
        P.publish_set(tables(spark, 5), root, verdict(False))
    assert P.published(spark, root, "a").count() == 3
    # a run that breaks between two tables
    broken = tables(spark, 5) | {"c": spark.range(1).select(F.raise_error(F.lit("broken")).cast("string").alias("z"))}
    with pytest.raises(Exception, match="broken"):
        P.publish_set(broken, root, None)
    assert {r["table_name"]: r["row_count"] for r in P.counts(spark, root).collect()} == {"a": 3, "b": 6, "run_checks": 1}
    P.publish_set(tables(spark, 7), root, verdict(True))
    assert P.published(spark, root, "a").count() == 7
    assert old.count() == 3         # a reader that began before goes on with its set


def test_publishing_again_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "again")
    first, second = (P.publish_set(tables(spark, 4), root, verdict(True)) for _ in range(2))
    assert first["set"] != second["set"] and first["tables"] == second["tables"]
    assert P.manifest(spark, root) == second


def test_every_cell_has_its_own_type(spark, tmp_path):
    cells = ["", "12", " -7 ", "+5", "1_000", "3.5", "1e3", ".5", "7.", "nan", "Infinity", "x1", "1,5", "0x10", "9" * 25, "12a", "--", "1__0", " "]
    path = str(tmp_path / "cells")
    spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").coalesce(1).write.option("header", True).option(
        "emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = IO.read_csv_cells(spark, path)
    got = {int(r["i"]): (r["t"], r["v"]) for r in df.select(
        F.try_variant_get("i", "$", "int").alias("i"), F.when(F.col("c").isNotNull(), F.schema_of_variant("c")).alias("t"),
        F.try_variant_get("c", "$", "string").alias("v")).collect()}

    def coerce(value):
        if value == "":
            return None
        for kind in (int, float):
            try:
                return kind(value)
            except ValueError:
                pass
        return value

    for i, c in enumerate(cells):
        want = coerce(c)
        kind, value = got[i]
        if want is None:
            assert kind is None
        elif isinstance(want, int):
            assert kind.startswith(("BIGINT", "DECIMAL")) and int(value) == want
        elif isinstance(want, float):
            assert kind == "DOUBLE" and (float(value) == want or want != want)
        else:
            assert (kind, value) == ("STRING", want)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_each_repeat_is_a_permutation(n):
    seen = set()
    for r in range(1, 16):
        d = I.donors(np.arange(n), r, n)
        assert sorted(d.tolist()) == list(range(n))
        seen.add(tuple(d.tolist()))
    assert len(seen) > (10 if n > 15 else 0)
    if n == 4097:
        assert abs(np.corrcoef(np.arange(n), I.donors(np.arange(n), 3, n))[0, 1]) < 0.06


def test_importance_finds_the_features_that_count(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(FEATURES)))
    y = 2 + 1.5 * x[:, 0] - 0.7 * x[:, 4]
    df = spark.createDataFrame([(f"q{i}", float(np.exp(y[i])), *map(float, x[i])) for i in range(400)],
                               "QUERY_ID string, TARGET_MS double, " + ", ".join(f"{f} double" for f in FEATURES)).repartition(3)
    got = {r["feature"]: r["importance"] for r in I.permutation_importance(df, lambda v: 2 + 1.5 * v[:, 0] - 0.7 * v[:, 4]).collect()}
    order = sorted(range(400), key=lambda i: f"q{i}")
    want = np.mean([np.abs(1.5 * (x[order, 0][I.donors(np.arange(400), r, 400)] - x[order, 0])).mean() for r in range(1, 16)])
    assert got[FEATURES[0]] == pytest.approx(want, abs=1e-4)
    assert got[FEATURES[0]] > got[FEATURES[4]] > 0.1 and all(got[f] == 0 for i, f in enumerate(FEATURES) if i not in (0, 4))
    assert I.permutation_importance(df.filter("1 = 0"), lambda v: v[:, 0]).count() == 0
