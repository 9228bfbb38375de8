"""Trailing statistics against a loop over windows, and against Spark's own window aggregates."""

import math
import random
import statistics

import pytest

from vanewright.operators import windows as W

STATS = ("mean", "std", "min", "max", "range", "median", "slope", "off_mean")


def by_loop(values, t, rows, stat, least):
    pairs = [(i, values[i]) for i in range(max(0, t - rows + 1), t + 1) if values[i] is not None]
    x = [v for _, v in pairs]
    if len(x) < least:
        return None
    if stat == "slope":
        mi, mx = statistics.fmean(i for i, _ in pairs), statistics.fmean(x)
        return sum((i - mi) * (v - mx) for i, v in pairs) / sum((i - mi) ** 2 for i, _ in pairs)
    if stat == "off_mean":
        return None if values[t] is None else values[t] - statistics.fmean(x)
    if stat == "std":
        return statistics.stdev(x) if len(x) > 1 else None
    return {"mean": statistics.fmean, "min": min, "max": max, "range": lambda v: max(v) - min(v), "median": statistics.median}[stat](x)


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trailing_statistics_across_batches_and_machines(spark, small_batches):
    rng = random.Random(4)
    series = {m: [None if rng.random() < 0.3 else rng.choice((1e6 + rng.random(), rng.gauss(0, 3), 5.0)) for _ in range(n)] for m, n in (("a", 40), ("b", 1), ("c", 23), ("d", 2), ("e", 60))}
    series["f"] = [None] * 12
    rows = [(m, t, x) for m, values in series.items() for t, x in enumerate(values)]
    frame = spark.createDataFrame(rows, "turbine_id string, timestamp long, x double").repartition(3)
    block = {f"{s}_{n}": W.trailing_of("x", n, s) for s in STATS for n in (1, 3, 10)}
    got = {(r["turbine_id"], r["timestamp"]): r for r in W.with_trailing(frame, block).collect()}
    assert len(got) == len(rows)
    for (m, t), r in got.items():
        for name, spec in block.items():
            want = by_loop(series[m], t, spec.rows, spec.stat, spec.least)
            assert (r[name] is None) == (want is None) and (want is None or math.isclose(r[name], want, rel_tol=1e-9, abs_tol=1e-6)), (m, t, name, r[name], want)


def test_trailing_statistics_equal_window_aggregates(spark):
    rng = random.Random(5)
    rows = [(f"m{i % 3}", i, None if i % 11 == 0 else rng.random()) for i in range(300)]
    frame = W.with_position(spark.createDataFrame(rows, "turbine_id string, timestamp long, x double"))
    plain = {f"{s}_col": W.rolling("x", 12, s) for s in STATS[:6]} | {"slope_col": W.slope("x", 12)}
    block = {f"{s}_row": W.trailing_of("x", 12, s) for s in STATS[:7]}
    for r in W.with_columns(frame, plain | block).collect():
        for s in STATS[:7]:
            a, b = r[f"{s}_col"], r[f"{s}_row"]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (s, a, b)


def test_trailing_statistics_of_no_rows(spark):
    frame = spark.createDataFrame([], "turbine_id string, timestamp long, x double")
    assert W.with_trailing(frame, {"m": W.trailing_of("x", 3, "mean")}).columns == ["turbine_id", "timestamp", "x", "m"]
    assert W.with_trailing(frame, {"m": W.trailing_of("x", 3, "mean")}).count() == 0


def test_work_of_a_value_grows_with_the_logarithm_of_the_window():
    """A window of a thousand rows over 20,000 values takes some twenty passes, not a thousand."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.where(rng.random(20_000) < 0.2, np.nan, 1e6 + rng.random(20_000))
    joins, plain = [], W.joined
    try:
        W.joined = lambda *a: joins.append(1) or plain(*a)
        made = dict(W.trailing_moments(x, {1000: {"std", "slope", "mean", "max"}, 24: {"min"}}))
    finally:
        W.joined = plain
    assert len(joins) <= 20 and set(made) == {1000, 24}
    got = W.trailing_statistics(x, made[1000], {"std", "slope", "mean", "max"})
    for t in (5, 999, 1000, 12_345, 19_999):
        seen = x[max(0, t - 999) : t + 1]
        places = np.flatnonzero(~np.isnan(seen))
        values = seen[places]
        assert math.isclose(got["mean"][t], values.mean(), rel_tol=1e-14) and math.isclose(got["std"][t], values.std(ddof=1), rel_tol=1e-9) and got["max"][t] == values.max()
        assert math.isclose(got["slope"][t], np.polyfit(places - places.mean(), values - values.mean(), 1)[0], rel_tol=1e-6, abs_tol=1e-12)
