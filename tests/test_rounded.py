"""Rounding of results: the same doubles as Spark's round, without decimal text for most values."""

import math
import random

from pyspark.sql import functions as F

from vanewright.functions.expressions import rounded

ODD = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 0.00005, 0.00015, -0.00005, 1.00005, 2.5, 0.1 + 0.2, 1e5 - 0.00005, 123456.78905, 1e9, 1e15 + 0.5, 1e300, -1e-9, 5e-324, 0.12345, 0.49995, 1.00015]


def test_rounded_equals_round(spark):
    rng = random.Random(8)
    values = ODD + [rng.choice((1, -1)) * rng.random() * 10 ** rng.randint(-6, 14) for _ in range(4000)] + [rng.randint(-(10**9), 10**9) / 10**rng.randint(1, 7) for _ in range(4000)]
    values += [math.nextafter(k / 10**5, rng.choice((-math.inf, math.inf))) for k in range(5, 4000, 10)]
    frame = spark.createDataFrame([(x,) for x in values], "x double")
    for places in (3, 4, 6):
        for r in frame.select("x", rounded("x", places).alias("a"), (F.round("x", places) + F.lit(0.0)).alias("b")).collect():
            assert repr(r["a"]) == repr(r["b"]), (places, r)


def test_rounding_has_a_way_without_text(spark):
    plan = spark.range(10).select(F.rand(3).alias("x")).select(rounded("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "rint" in plan.lower()
