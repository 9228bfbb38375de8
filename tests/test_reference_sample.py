"""The balanced sample: the rows that ordering every stratum gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vanewright.operators import anomaly


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(1)
    rows = [("hot", "a", i, rng.random()) for i in range(3000)] + [(f"m{m}", r, i, rng.random()) for m in range(12) for r in "ab" for i in range(m * 4)]
    rows += [(None, "a", i, 0.5) for i in range(50)] + [("one key", None, 7, float(i)) for i in range(400)]
    return spark.createDataFrame(rows, "turbine_id string, regime string, timestamp long, x double").repartition(4)


def whole(frame, most_rows):
    order = F.xxhash64("turbine_id", "timestamp", F.lit(42))
    place = F.row_number().over(Window.partitionBy("turbine_id", "regime").orderBy(order, "turbine_id", "timestamp"))
    return frame.withColumn("_place", place).orderBy("_place", order, "turbine_id", "timestamp").limit(most_rows)


def keys(frame):
    return sorted(((r["turbine_id"], r["regime"], r["timestamp"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("most_rows", [5, 100, 1500, 100_000])
def test_sample_is_that_of_ordered_strata(frame, most_rows, monkeypatch):
    want = keys(whole(frame, most_rows))
    sample = lambda: anomaly.reference_sample(frame, ("turbine_id", "regime"), ("turbine_id", "timestamp"), most_rows)
    assert keys(sample()) == want
    assert sample().columns == frame.columns
    monkeypatch.setattr(anomaly, "SENT_STRATA", 0)
    assert keys(sample()) == want


def test_level_fills_strata_evenly():
    for sizes, most in (({3: 2, 10: 1, 100: 1}, 30), ({1: 5}, 3), ({1: 5}, 50), ({7: 1}, 7), ({2: 1, 9: 4}, 38)):
        level = anomaly.level_of(sizes, most)
        given = lambda k: sum(min(size, k) * n for size, n in sizes.items())
        assert given(level) >= min(most, given(10**9)) and (level == 0 or given(level - 1) < most)
    assert anomaly.level_of({}, 5) == 0


def test_no_rows(frame):
    assert anomaly.reference_sample(frame.limit(0), ("regime",), ("timestamp",)).count() == 0
