"""Slices with halo rows: as by machine, whatever the slices' size."""

import random

import pytest
from pyspark.sql import functions as F

from vanewright.operators import features as X
from vanewright.operators import slices as S
from vanewright.operators import windows as W


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(8)
    rows = [("hot", t, rng.gauss(0, 1) if t % 7 else None) for t in range(400)] + [(f"m{m}", t, rng.random()) for m in range(6) for t in range(m * 9)] + [("late", None, 1.0), ("late", 3, 2.0), ("late", 4, 3.0)]
    return spark.createDataFrame(rows, "turbine_id string, timestamp long, x double").repartition(4)


def block():
    return {"lag": W.lag("x", 5), "off": W.pct_change("x", 3), "mean_col": W.rolling("x", 24, "mean"), "median": W.trailing_of("x", 24, "median"), "slope": W.trailing_of("x", 12, "slope"), "most": W.trailing_of("x", 3, "max")}


def plain(frame):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("slice_rows", [9, 60, 10_000])
def test_blocks_in_slices_are_those_by_machine(frame, slice_rows):
    # slices of 9 rows are shorter than the halo of 24
    assert plain(X.with_bounded(frame, block(), 24, slice_rows)) == plain(W.with_columns(frame, block()))


def test_a_long_machine_spreads_and_halos_are_counted_in_rows(frame):
    rows = S.with_slices(frame, 24, 60)
    hot = rows.filter(F.col("turbine_id").endswith("hot")).groupBy("turbine_id").agg(F.count_if(~F.col("_halo")).alias("own"), F.count_if("_halo").alias("halo")).collect()
    assert len(hot) >= 5 and sum(r["own"] for r in hot) == 400 and max(r["own"] for r in hot) <= 150
    first = min(hot, key=lambda r: r["halo"])
    assert first["halo"] == 0 and all(r["halo"] == 24 for r in hot if r is not first)
    assert rows.filter(~F.col("_halo")).count() == frame.count()


def test_no_rows_and_short_machines_are_built_by_machine(frame, monkeypatch):
    monkeypatch.setattr(S, "with_slices", None)
    assert X.with_bounded(frame.limit(0), block(), 24).count() == 0
    assert X.with_bounded(frame, block(), 24).count() == frame.count()


def test_whole_feature_blocks_in_slices(spark):
    from vanewright.plans.cleaning_queries import keyed

    rows = keyed(spark, "/root/testdata/sf0.001").filter("turbine_id in ('1', '2')")
    some = ("raw", "lag", "rolling", "trend", "interaction", "time")
    whole, spec = X.failure_features(rows, some)
    sliced, _ = X.failure_features(rows, some, slice_rows=100)
    names = [n for b in spec.values() for n in b]
    key = lambda r: (r["turbine_id"], r["timestamp"], r["ordinal"])
    a, b = ({key(r): r for r in f.collect()} for f in (whole, sliced))
    assert a.keys() == b.keys() and len(a) > 200
    for k, r in a.items():
        for n in names:
            x, y = r[n], b[k][n]
            assert x == y or (isinstance(x, float) and y == pytest.approx(x, rel=1e-6, abs=1e-6)), (k, n, x, y)
