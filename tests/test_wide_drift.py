"""Drift statistics of all sensors in one pass over a machine's rows: the same numbers, and one shuffle."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from vanewright.operators import cleaning, drift
from vanewright.operators import windows as W

T0 = dt.datetime(2024, 3, 1)
SENSORS = ("vibration", "oil_pressure")


def fleet(spark, machines=3, hours=240):
    rng = np.random.default_rng(5)
    rows = []
    for m in range(machines):
        for i in range(hours + m):
            x = rng.normal(3 + (i > 120) * 2, 1, 2).tolist()
            rows.append((f"M{m}", T0 + dt.timedelta(hours=i), m * 1000 + i, None if i % 17 == 3 else x[0], float("nan") if m == 2 and i == 150 else x[1], "low_load" if i % 5 else "idle"))
    return spark.createDataFrame(rows, "turbine_id string, timestamp timestamp_ntz, ordinal long, vibration double, oil_pressure double, regime string")


def found(frame, names):
    return sorted(tuple("nan" if isinstance(v, float) and v != v else v for v in r) for r in frame.select(*names).collect())


def shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


NAMES = ("turbine_id", "sensor", "ordinal", "cusum_up", "cusum_down", "ewma", "signals")


def test_one_pass_equals_charts_of_each_series(spark):
    frame = fleet(spark)
    mask = F.col("regime") == "low_load"
    wide = drift.drift_statistics(frame, mask, SENSORS, 24, 48)
    long = drift.with_signals(drift.control_charts(drift.residuals(frame, mask, SENSORS, 24)), rows=48)
    assert found(wide, NAMES) == found(long, NAMES)
    assert found(wide, NAMES) == found(drift.drift_statistics(frame, mask, SENSORS, 24, 48, slice_rows=50), NAMES)
    assert wide.filter("signals > 0").count() > 0
    assert shuffles(wide) == 1


def test_machine_over_several_batches(spark):
    frame = fleet(spark)
    want = found(drift.drift_statistics(frame, F.lit(True), SENSORS, 24, 48), NAMES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert found(drift.drift_statistics(frame, F.lit(True), SENSORS, 24, 48), NAMES) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_block_holds_the_statistics(spark):
    frame = fleet(spark)
    block = drift.drift_block(frame, F.lit(True), SENSORS, 24, 48)
    sliced = drift.drift_block(frame, F.lit(True), SENSORS, 24, 48, slice_rows=50)
    assert block.columns == sliced.columns
    assert found(block, block.columns) == found(sliced, block.columns)
    assert shuffles(block) == 1


def test_plain_sums_run_from_the_first_row(spark):
    frame = fleet(spark)
    wide = drift.plain_statistics(frame, F.lit(True), SENSORS, 24)
    names = ("turbine_id", "sensor", "ordinal", "cusum_up", "cusum_down")
    assert found(wide, names) == found(drift.plain_cusum(drift.residuals(frame, F.lit(True), SENSORS, 24)), names)
    # a frame with a number for its start is summed again for every row
    assert "RowFrame, -" not in wide._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame, -" not in drift.plain_cusum(drift.residuals(frame, F.lit(True), SENSORS, 24))._jdf.queryExecution().optimizedPlan().toString()
    assert shuffles(wide) == 1


def test_keyed_rows_dealt_by_machine_take_one_shuffle(spark):
    frame = fleet(spark)
    twice = frame.unionByName(frame.withColumn("ordinal", F.col("ordinal") + 100000))
    want = found(cleaning.normalise_keys(twice), ("turbine_id", "timestamp", "ordinal"))
    dealt = cleaning.normalise_keys(twice, together=True)
    assert found(dealt, ("turbine_id", "timestamp", "ordinal")) == want
    assert found(cleaning.normalise_keys(twice, together=True, slice_rows=50), ("turbine_id", "timestamp", "ordinal")) == want
    assert shuffles(dealt.withColumn("d", W.diff("vibration", 1))) == 1
