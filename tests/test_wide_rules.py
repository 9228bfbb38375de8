"""Rule flags of sensors side by side: one shuffle of narrow rows, with missing and NaN readings as they were."""

import datetime as dt

from pyspark.sql import functions as F

from vanewright.operators import rules

T0 = dt.datetime(2024, 3, 1)
NAN = float("nan")


def toy(spark):
    odd = {0: 5.0, 1: None, 2: 5.0, 3: 20.0, 10: NAN, 20: 12.0}
    rows = [(m, T0 + dt.timedelta(hours=h), h, *(odd.get(h, 5.0) if s == "vibration" else 50.0 for s in rules.SENSORS)) for m in ("A", "B") for h in range(30 if m == "A" else 4)]
    return spark.createDataFrame(rows, "turbine_id string, timestamp timestamp_ntz, ordinal long, " + ", ".join(f"{s} double" for s in rules.SENSORS))


def test_flags_of_odd_readings_and_one_shuffle(spark):
    flags = rules.flagged(toy(spark), rules.rule_table(spark))
    assert flags._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    seen = flags.filter("turbine_id = 'A' and sensor = 'vibration'")
    hours = lambda c: sorted(r[0] for r in seen.filter(c).select("ordinal").collect())
    # NaN is greater than any rate; what follows a missing reading has none
    assert hours("rate") == [3, 4, 10, 11]
    assert hours("stuck") == [9, 16, 17, 18, 19, 26, 27, 28, 29]
    other = flags.filter("turbine_id = 'B' and sensor = 'oil_temperature'")
    assert other.filter("stuck").count() == 0 and other.count() == 4


def test_wide_counts_equal_the_long_ones(spark):
    names = ("turbine_id", "ordinal", "warnings", "alarms", "invalid")
    wide = rules.with_row_flags(toy(spark)).select("turbine_id", "ordinal", *(F.col(c).cast("long") for c in names[2:]))
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, rules.row_flags(rules.flagged(toy(spark), rules.rule_table(spark))).select(*names).collect()))


def test_health_matrix_shuffles_telemetry_and_not_the_matrix(spark):
    from vanewright.operators import features, regimes
    from vanewright.sources.telemetry import SENSORS

    frame = toy(spark).withColumns({c: F.lit(5.0) for c in SENSORS if c not in rules.SENSORS}).withColumn("operational_status", F.lit("normal"))
    matrix, spec = features.health_features(regimes.with_regime(frame))
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert "vibration_mean_exceedance" in spec["rule"] and "vibration_signals" in spec["drift"]
