"""Medians of all earlier rows in slices: bit for bit those of one pass through a machine."""

import random

import pytest
from pyspark.sql import functions as F

from vanewright.operators import middles
from vanewright.operators import windows as W


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(8)
    value = lambda t: None if 300 <= t < 380 or t % 11 == 0 else float("nan") if t % 17 == 0 else 5.0 if rng.random() < 0.3 else rng.choice([rng.gauss(0, 1), rng.gauss(t / 40, 2), float("inf") if t % 97 == 0 else -3.0])
    rows = [("hot", t, value(t), float(t)) for t in range(700)] + [("same", t, 2.0, None) for t in range(200)]
    rows += [(f"m{m}", t, rng.random(), -float(t)) for m in range(5) for t in range(m * 7)] + [("late", None, 1.0, 1.0), ("late", 3, 2.0, 0.0), ("late", 4, 3.0, None)]
    return spark.createDataFrame(rows, "turbine_id string, timestamp long, x double, up double").repartition(4)


def plain(frame):
    return sorted((tuple(v.hex() if isinstance(v, float) else v for v in r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("slice_rows, least", [(7, 3), (64, 1), (250, 48)])
def test_slices_give_the_same_medians(frame, slice_rows, least):
    columns = {"x": "x", "up": F.col("up"), "off": F.when(F.col("up") > 100, F.col("x"))}
    want = W.with_medians(frame, columns, least)
    got = W.with_medians(frame, columns, least, slice_rows)
    assert got.columns == want.columns and plain(got) == plain(want)


def test_trailing_windows_follow_medians_of_slices(frame):
    """with_both() takes trailing statistics of rows as with_medians() leaves them."""
    from vanewright.operators import features as X

    block = {"mean": W.rolling("x", 24, "mean"), "slope": W.trailing_of("x", 12, "slope")}
    made = lambda rows: X.with_both(frame, block, lambda f: (W.with_medians(f, {"x": "x"}, 2, rows), []))[0]
    assert plain(made(40)) == plain(made(10_000))


def test_a_slice_gets_the_middle_alone(spark):
    rng = random.Random(2)
    frame = spark.createDataFrame([("hot", t, rng.gauss(0, 1)) for t in range(8000)], "turbine_id string, timestamp long, x double")
    dealt = middles.in_ranges(frame, 400)
    sent = middles.middle_values(dealt, ["x"]).groupBy("_range").agg(F.sum("_c").alias("sent"), F.max("_n").alias("before"), F.max("_base").alias("base")).collect()
    rows = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    assert len(rows) >= 12 and len(sent) == len(rows) - 1
    late = [r for r in sent if r["before"] > 4000]
    # a slice and the cells that hold its ends, of all that came before
    assert late and all(r["sent"] <= rows[r["_range"]] + 4 * 8000 / middles.LEAST_CELLS and r["base"] > r["before"] / 4 for r in late)


def test_middle_keeps_no_more_than_its_rows_need():
    middle = middles.Middle()
    middle.kept, middle.base, middle.n = [(1.0, 10_000), (2.0, 5)], 3, 10_008
    middle.begin(20)
    assert len(middle.seen) <= 24
    assert middle.medians([float("nan")] * 2, 1) == [1.0, 1.0]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "turbine_id string, timestamp long, x double")
    assert W.with_medians(empty, {"x": "x"}, 1, 1).count() == 0
    assert middles.with_long_medians(empty, {"x": "x"}, 1, 1).count() == 0
