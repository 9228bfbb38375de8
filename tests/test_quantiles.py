"""Exact quantiles by distributed selection, held against Spark's own exact percentile and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanewright.functions import quantiles as Q

PS = [0.0, 0.05, 0.5, 0.95, 1.0]


@pytest.fixture(autouse=True)
def selected(monkeypatch):
    """Small groups too are selected from."""
    monkeypatch.setattr(Q, "SMALL_GROUP", 0)


def test_small_groups_take_the_aggregate_and_agree(spark, monkeypatch):
    frame = frame_of(spark, 900).withColumn("g", F.when(F.col("g") != "g2", F.col("g")))
    found = {}
    for most in (0, 10_000):
        monkeypatch.setattr(Q, "SMALL_GROUP", most)
        found[most] = sorted(map(tuple, Q.quantiles(frame, {c: c for c in ("ties", "wide")}, [0.5], ["g"]).collect()))
    assert found[0] == found[10_000] and len(found[0]) == 14


def same(a, b):
    return all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))


def frame_of(spark, n=6000):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        # a third of all rows in one group, many ties, missing values, and magnitudes far apart
        g = "hot" if i % 3 == 0 else f"g{i % 7}"
        rows.append((g, float(rng.integers(0, 4)), None if i % 5 == 0 else float(rng.normal() * 10.0 ** rng.integers(-9, 9)), float(i) if g == "g1" else None))
    return spark.createDataFrame(rows, "g string, ties double, wide double, one double").repartition(5)


@pytest.mark.parametrize("accuracy,few_rows", [(5_000, 1_000_000), (40, 1_000_000), (40, 0)])
def test_quantiles_equal_the_exact_percentile(spark, monkeypatch, accuracy, few_rows):
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    frame = frame_of(spark)
    for by in ([], ["g"]):
        got = {(*(r[b] for b in by), r["column"]): (r["n"], r["q"]) for r in Q.quantiles(frame, {c: c for c in ("ties", "wide", "one")}, PS, by, few_rows).collect()}
        want = {}
        for c in ("ties", "wide", "one"):
            for r in frame.filter(F.col(c).isNotNull()).groupBy(*by).agg(F.count(c).alias("n"), F.percentile(c, F.array(*map(F.lit, PS))).alias("q")).collect():
                if r["n"]:
                    want[(*(r[b] for b in by), c)] = r["n"], r["q"]
        assert got == want


def test_few_values_stand_between_the_bounds(spark):
    values = Q.long_values(spark.range(200_000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("x")), {"x": "x"}, [])
    counts = Q.counted(values, Q.bounds_of(values, [0.5], []), [0.5], [], True)
    assert counts.count() < 200_000 * 8 / Q.ACCURACY


def test_quantiles_of_special_values(spark):
    inf, nan = math.inf, math.nan
    for values in ([inf, -inf, 1.0, 2.0], [nan, 1.0, 2.0, inf], [nan, nan], [inf, inf, 3.0], [7.0]):
        frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        got = Q.quantiles(frame, {"x": "x"}, [0.0, 0.5, 1.0]).first()["q"]
        assert same(got, frame.select(F.percentile("x", F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))).first()[0])


def test_quantiles_of_empty_tables_and_of_missing_values(spark):
    empty = spark.createDataFrame([], "g string, x double")
    missing = spark.createDataFrame([("a", None)], "g string, x double")
    for frame in (empty, missing):
        assert Q.quantiles(frame, {"x": "x"}, [0.5]).collect() == [] and Q.quantiles(frame, {"x": "x"}, [0.5], ["g"]).collect() == []
        assert Q.wide_quantiles(frame, {"x": "x"}, [0.5]).collect()[0]["x"] is None


def test_bounds_that_miss_are_opened(spark, monkeypatch):
    wrong = lambda values, ps, by: values.groupBy(*by, "column").agg(F.count("*").alias("n"), F.array(*(F.lit(1e9) for _ in ps)).alias("low"), F.array(*(F.lit(2e9) for _ in ps)).alias("high"))
    monkeypatch.setattr(Q, "bounds_of", wrong)
    frame = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert Q.quantiles(frame, {"x": "x"}, [0.25, 0.5]).first()["q"] == [25.0, 50.0]
