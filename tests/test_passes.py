"""Passes over ordered rows: one Python process a task, and the numbers of the columns that they stand for."""

import random

import pytest

from vanewright.operators import features as X
from vanewright.operators import windows as W

DETAILED = X.DETAILED


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def telemetry(spark, machines=3, rows=60, missing=0.1):
    rng = random.Random(11)
    value = lambda: None if rng.random() < missing else 10 + rng.random()
    data = [(f"m{m}", t, t, "normal" if rng.random() < 0.8 else "idle", *(value() for _ in X.SENSORS)) for m in range(machines) for t in range(rows)]
    frame = spark.createDataFrame(data, "turbine_id string, timestamp long, ordinal long, operational_status string, " + ", ".join(f"{c} double" for c in X.SENSORS))
    return frame.withColumn("timestamp", W.F.timestamp_seconds(W.F.col("timestamp") * 3600)).repartition(3)


def in_python(frame) -> int:
    return frame._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def shown(value):
    return "nan" if isinstance(value, float) and value != value else value


def test_first_and_last_values_of_windows_equal_columns(spark, small_batches):
    rng = random.Random(4)
    odd = lambda: rng.choice((None, None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1e-9, 3.0, rng.gauss(0, 5), rng.gauss(0, 5)))
    frame = spark.createDataFrame([(m, t, odd()) for m, n in (("a", 90), ("b", 1), ("c", 33), ("d", 2)) for t in range(n)], "turbine_id string, timestamp long, x double").repartition(3)
    plain, block = {}, {}
    for n in (1, 3, 10):
        plain |= {f"lag_{n}": W.lag("x", n), f"diff_{n}": W.diff("x", n), f"rate_{n}": W.diff("x", n) / float(n), f"change_{n}": W.pct_change("x", n)}
        block |= {f"lag_{n}": W.end_of("x", n, "lag"), f"diff_{n}": W.end_of("x", n, "diff"), f"rate_{n}": W.end_of("x", n, "rate", float(n)), f"change_{n}": W.end_of("x", n, "change")}
    rows = lambda f: {(r["turbine_id"], r["timestamp"]): [shown(r[n]) for n in block] for r in f.collect()}
    assert rows(W.with_trailing(frame, block)) == rows(W.with_columns(frame, plain))


def test_failure_matrix_goes_to_python_once(spark, small_batches):
    frame = telemetry(spark)
    out, spec = X.failure_features(frame)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert in_python(out) == 1 and "lag(" not in plan
    assert len([n for names in spec.values() for n in names]) == 395 and out.count() == 180
    # what no block reads isn't dealt
    rolling, _ = X.failure_features(frame, ("rolling",))
    dealt = rolling._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "brake_temperature" not in dealt.splitlines()[1]


def test_medians_and_trailing_statistics_in_one_pass(spark, small_batches):
    frame = telemetry(spark).select("turbine_id", "timestamp", "vibration")
    block = {"mean": W.trailing_of("vibration", 5, "mean"), "lag": W.end_of("vibration", 2, "lag")}
    one = W.with_medians(frame, {"v": "vibration"}, 3, then=[W.trailing_pass(block)])
    two = W.with_trailing(W.with_medians(frame, {"v": "vibration"}, 3), block)
    cut = W.with_medians(frame, {"v": "vibration"}, 3, 20, [W.trailing_pass(block)])
    assert in_python(one) == 1 and in_python(two) == 2 and one.columns == two.columns == cut.columns
    key = lambda f: sorted(map(tuple, f.collect()), key=lambda r: r[:2])
    assert key(one) == key(two) == key(cut)


def test_health_matrix_goes_to_python_once(spark, small_batches):
    """A task of the whole matrix has one Python process, not one for each kind of statistics."""
    from vanewright.operators import regimes

    matrix, spec = X.health_features(regimes.with_regime(telemetry(spark)))
    assert in_python(matrix) == 1 and sum(map(len, spec.values())) == 239 and matrix.count() == 180
    assert not [c for c in matrix.columns if c.startswith("_")]


def test_rule_features_stay_where_flags_are(spark, small_batches):
    """Trailing statistics of each sensor without another shuffle, as windows by machine and sensor have them."""
    from vanewright.operators import rules

    flags = rules.flagged(telemetry(spark, missing=0.3).withColumns({c: W.F.col(c) * 9 for c in rules.SENSORS}), rules.rule_table(spark)).drop("alarm")
    made = rules.rule_features(flags, 6)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    span, x = W.trailing(6, "turbine_id", "sensor"), W.F.col("exceedance")
    want = flags.select("turbine_id", "timestamp", "ordinal", "sensor", "exceedance", *(W.F.when(W.F.count(x).over(span) >= 3, f(x).over(span)) for f in (W.F.avg, W.F.max)))
    near = lambda f: {tuple(r[:4]): [v if v is None else pytest.approx(v, abs=1e-9) for v in r[4:]] for r in f.collect()}
    assert near(made) == {k: [v if v is None else v.expected for v in r] for k, r in near(want).items()} and made.count() == 1800


def test_windows_of_lanes_across_batches(spark, small_batches):
    rng = random.Random(2)
    rows = [(m, t, lane, rng.choice((None, rng.random()))) for m, n in (("a", 25), ("b", 2), ("c", 9)) for t in range(n) for lane in ("x", "y", "z") if lane != "y" or rng.random() < 0.4]
    frame = spark.createDataFrame(rows, "turbine_id string, timestamp long, lane string, v double").repartition("turbine_id").sortWithinPartitions("turbine_id", "timestamp")
    got = W.with_passes(frame, [W.trailing_pass({"m": W.trailing_of("v", 4, "mean", 1), "l": W.end_of("v", 1, "lag")}, "lane")])
    span, one = W.trailing(4, "turbine_id", "lane"), W.order("turbine_id", "lane")
    want = frame.withColumns({"m": W.F.avg("v").over(span), "l": W.F.lag("v", 1).over(one)})
    plain = lambda f: sorted((tuple(None if v is None else round(v, 12) if isinstance(v, float) else v for v in r) for r in f.collect()), key=str)
    assert plain(got) == plain(want)


def test_anomaly_matrix_deals_what_it_reads_and_goes_to_python_once(spark):
    from vanewright.operators import regimes

    frame = regimes.with_regime(telemetry(spark).withColumn("degradation_level", W.F.rand(1)))
    out, names = X.anomaly_features(frame)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert in_python(out) == 1 and "lag(" not in plan and "degradation_level" not in plan.split("RepartitionByExpression")[1].splitlines()[1]
    assert len(names) == 130 and out.count() == 180


def test_signal_shape_goes_to_python_once(spark, small_batches):
    frame = telemetry(spark).select("turbine_id", "timestamp", *X.SHAPED)
    out, names = X.with_shape(frame)
    assert in_python(out) == 1 and out.columns == [*frame.columns, *names] and out.count() == 180
