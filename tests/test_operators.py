"""Hand-checkable telemetry: labels, leakage, windows, rules, drift, thresholds, fusion, models, and the stream."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanewright.functions.expressions import half_even_steps
from vanewright.operators import anomaly, cleaning, drift, features, fusion, health, labels, metrics, nested, regimes, rules, validation
from vanewright.operators import windows as W
from vanewright.sources import files, telemetry
from vanewright.streaming import drift_monitor

START = datetime(2024, 3, 1)
STEADY = {"wind_speed": 8.0, "rotor_speed": 12.0, "generator_speed": 1200.0, "power_output": 700.0, "generator_temperature": 70.0, "gearbox_temperature": 54.0, "bearing_temperature": 50.0, "oil_temperature": 50.0, "oil_pressure": 5.0, "vibration": 3.0, "ambient_temperature": 10.0, "nacelle_temperature": 20.0, "hydraulic_pressure": 180.0, "brake_temperature": 40.0}
SCHEMA = "turbine_id string, timestamp timestamp_ntz, ordinal long, " + ", ".join(f"{c} double" for c in telemetry.SENSORS) + ", operational_status string, failure_event int, degradation_level double"


def rows(hours=160, change=None):
    out = []
    for machine in ("A", "B"):
        for h in range(hours):
            r = {"turbine_id": machine, "timestamp": START + timedelta(hours=h), "ordinal": len(out), **STEADY, "operational_status": "normal", "failure_event": int(machine == "A" and h == 100), "degradation_level": 0.0}
            r["vibration"] += 0.01 * math.sin(h)
            if change:
                r = change(machine, h, r)
            if r:
                out.append(r)
    return out


def toy(spark, **kw):
    made = rows(**kw)
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in made], SCHEMA)


def test_labels(spark):
    out = labels.failure_target(toy(spark)).collect()
    hits = sorted((r["timestamp"] - START).total_seconds() / 3600 for r in out if r["turbine_id"] == "A" and r["target"])
    assert hits == list(range(52, 100))
    assert not any(r["target"] for r in out if r["turbine_id"] == "B")
    assert sum(not r["label_reliable"] for r in out if r["turbine_id"] == "B") == 48


def test_repair_rows_are_left_out(spark):
    frame = toy(spark, change=lambda m, h, r: r | {"operational_status": "maintenance"} if m == "B" and h in (20, 21) else r)
    out = labels.eligible(labels.failure_target(frame), 6)
    left = {(r["timestamp"] - START).total_seconds() / 3600 for r in out.filter("turbine_id = 'B' and not modelling_eligible").collect()}
    assert left == set(range(20, 28)) | set(range(112, 160))


def test_splits_and_their_errors(spark):
    frame = toy(spark, hours=600)
    bounds = labels.split_bounds(frame)
    b = labels.check_bounds(bounds)
    assert b["valid_start"] - b["train_end"] == 48 * labels.HOUR
    gaps = labels.split_gaps(labels.assign_splits(frame, bounds)).first()
    assert gaps["ok"] and set(labels.temporal_split(frame, bounds)) == {"train", "valid", "test"}
    with pytest.raises(labels.BadSplit):
        labels.check_bounds(labels.split_bounds(toy(spark, hours=20)))
    with pytest.raises(labels.BadSplit):
        labels.check_bounds(bounds, 48, 12)


def test_no_feature_looks_ahead(spark):
    """A change at hour 90 may change nothing before it, nor anything of the other machine."""
    before = toy(spark)
    after = toy(spark, change=lambda m, h, r: r | {c: r[c] + 1000 for c in ("vibration", "oil_pressure", "gearbox_temperature")} if m == "A" and h >= 90 else r)
    for blocks in (("lag", "rolling", "trend"), ("relative",)):
        x, spec = features.failure_features(before, blocks)
        y, _ = features.failure_features(after, blocks)
        changed = W.future_change(x, y, [n for b in spec.values() for n in b])
        assert changed.filter("turbine_id = 'B'").count() == 0
        assert changed.count() > 0 and changed.agg(F.min("timestamp")).first()[0] == START + timedelta(hours=90)


def test_window_primitives(spark):
    frame = toy(spark, hours=12, change=lambda m, h, r: r | {"vibration": None if h == 3 else float(h * h)})
    made = W.with_position(frame).withColumns({"lag": W.lag("vibration", 1), "mean": W.rolling("vibration", 4, "mean"), "range": W.rolling("vibration", 4, "range"), "past": W.expanding("vibration", "median", 2), "slope": W.slope("vibration", 4)})
    out = {(r["timestamp"] - START).seconds // 3600: r for r in made.filter("turbine_id = 'A'").collect()}
    assert out[0]["lag"] is None and out[4]["lag"] is None and out[6]["lag"] == 25
    assert out[0]["mean"] is None and out[4]["mean"] == pytest.approx((1 + 4 + 16) / 3) and out[6]["range"] == 20
    assert out[1]["past"] is None and out[5]["past"] == 2.5  # 0 1 4 16
    assert out[6]["slope"] == pytest.approx(np.polyfit([5, 6, 7], [16, 25, 36], 1)[0])
    assert half_even_steps(2.5, 1) == 2 and half_even_steps(0.1, 1) == 1


def test_cleaning_keeps_the_first_of_repeated_keys(spark):
    frame = toy(spark, hours=5)
    late = frame.withColumns({"ordinal": F.col("ordinal") + 1000, "vibration": F.lit(99.0)})
    both = frame.unionByName(late).unionByName(frame.limit(1).withColumn("turbine_id", F.lit(None).cast("string")))
    counts = cleaning.key_counts(both).first()
    assert tuple(counts) == (21, 1, 10, 10)
    clean = cleaning.preprocess(both)
    assert clean.count() == 10 and clean.filter("vibration > 50").count() == 0
    assert cleaning.infer_step(frame) == 1.0
    with pytest.raises(cleaning.NoStep):
        cleaning.infer_step(toy(spark, hours=1))


def test_gaps_are_filled_in_order(spark):
    def change(m, h, r):
        return r | {"oil_pressure": None if h in (2, 3, 4, 5, 6) else 5.0 + h, "wind_speed": -9.0 if h == 1 else 8.0 + h}

    out = {(r["timestamp"] - START).seconds // 3600: r for r in cleaning.preprocess(toy(spark, hours=10, change=change)).filter("turbine_id = 'A'").collect()}
    assert [out[h]["oil_pressure"] for h in (2, 3, 4)] == [6.0, 6.0, 6.0]  # carried for three rows
    assert out[5]["oil_pressure"] == pytest.approx(np.median([5, 6, 6, 6, 6, 12, 13, 14]))
    assert out[1]["wind_speed"] == np.median([8, 10, 11, 12, 13, 14, 15, 16, 17])


def test_gaps_are_filled_within_the_machine(spark, monkeypatch):
    """Odd columns give what medians by joins give; the fleet's are taken of columns alone that a machine has none of."""
    rng = np.random.default_rng(3)
    rows = []
    for m, n in (("A", 1), ("B", 2), ("C", 30_001), ("D", 8), (None, 3)):
        for h in range(n):
            value = lambda p: None if rng.random() < p else float(rng.choice([rng.normal(), 0.0, float("nan") if h % 50 == 7 else 1.0]))  # noqa: B023,E731
            rows.append((m, START + timedelta(hours=h), h, value(0.3), None if m == "B" else value(0.6), value(0.0), None, "x" if h else None))
    frame = spark.createDataFrame(rows, "turbine_id string, timestamp timestamp, ordinal long, vibration double, oil_pressure double, power_output double, wind_speed float, operational_status string")
    sensors = ("vibration", "oil_pressure", "power_output", "wind_speed")
    asked, quantiles = [], cleaning.wide_quantiles
    monkeypatch.setattr(cleaning, "wide_quantiles", lambda rows, columns, *more: asked.append(sorted(columns.values())) or quantiles(rows, columns, *more))
    fills = [cleaning.fill_gaps(frame, sensors, slice_rows=most) for most in (10**6, 10)]
    bare = ["oil_pressure", "vibration", "wind_speed"]
    assert asked == [bare, sorted(sensors), bare]
    a, b = ({(r["turbine_id"], r["ordinal"]): tuple(map(str, r)) for r in out.collect()} for out in fills)
    assert a == b and len(a) == len(rows) and fills[0].schema.simpleString() == fills[1].schema.simpleString()
    assert cleaning.fill_gaps(frame.filter("turbine_id = 'C'"), ("vibration",), carried=(), whole=True).filter("vibration is null").count() == 0
    assert len(asked) == 3  # a machine with readings needs no fleet


def test_validation_findings(spark):
    def change(m, h, r):
        return r | {"vibration": None if h % 5 == 0 else 99.0, "operational_status": "odd" if h == 1 else "normal", "failure_event": 0}

    found = {r["check"]: r for r in validation.validate(toy(spark, hours=20, change=change)).collect()}
    assert {"missing_excessive", "range_vibration", "unexpected_status", "no_failures", "few_rows", "no_machine_failures"} <= set(found)
    assert found["range_vibration"]["count"] == 32 and "duplicate_keys" not in found and "unsorted_times" not in found
    with pytest.raises(validation.InvalidTelemetry):
        validation.raise_for_errors(validation.validate(toy(spark, hours=5, change=change)))
    assert [r["check"] for r in validation.validate(toy(spark, hours=3).drop("vibration")).collect()] == ["required_columns"]


def test_regimes(spark):
    cases = [(8.0, 700.0, "maintenance", "offline"), (2.0, 700.0, "normal", "idle"), (8.0, 10.0, "normal", "idle"), (12.0, 300.0, "normal", "curtailed"), (5.0, 100.0, "normal", "low_load"), (9.0, 900.0, "normal", "medium_load"), (13.0, 1900.0, "normal", "high_load"), (None, 700.0, "normal", "medium_load"), (26.0, 700.0, "normal", "idle")]
    frame = spark.createDataFrame(cases, "wind_speed double, power_output double, operational_status string, want string")
    assert frame.filter(regimes.regime() != F.col("want")).count() == 0


def test_rules(spark):
    table = rules.rule_table(spark)
    frame = spark.createDataFrame([("vibration", 7.5), ("vibration", 11.0), ("vibration", None), ("oil_pressure", 3.2), ("oil_pressure", 9.0)], "sensor string, value double").join(table, "sensor")
    got = {(r["sensor"], r["value"]): (r["e"], r["s"]) for r in frame.select("sensor", "value", rules.exceedance().alias("e"), rules.severity().alias("s")).collect()}
    assert got[("vibration", 7.5)] == (0.0, "none") and got[("vibration", 11.0)] == (1.0, "alarm") and got[("vibration", None)] == (None, "none")
    assert got[("oil_pressure", 3.2)][0] == pytest.approx(0.5) and got[("oil_pressure", 3.2)][1] == "warning" and got[("oil_pressure", 9.0)] == (0.0, "none")
    stuck = rules.flag_counts(rules.flagged(toy(spark, hours=10), table)).filter("check = 'stuck' and sensor = 'oil_pressure'").first()
    assert stuck["n"] == 2 * 5  # a full window only
    with pytest.raises(rules.BadRules):
        rules.rule_table(spark, [(*rules.RULES[0][:6], 12.0, 11.0, *rules.RULES[0][8:])])


def residuals(spark, values):
    return spark.createDataFrame([("A", "vibration", START + timedelta(hours=i), i, v) for i, v in enumerate(values)] + [("B", "vibration", START + timedelta(hours=i), i, 0.1) for i in range(4)], "turbine_id string, sensor string, timestamp timestamp, ordinal long, z double")


def test_charts_restart_carry_and_forget_nothing(spark):
    values = [0.4, 3.0, 3.0, None, 2.0, -4.0, -3.0, 1.0]
    out = sorted(drift.control_charts(residuals(spark, values)).filter("turbine_id = 'A'").collect(), key=lambda r: r["ordinal"])
    assert [r["cusum_up"] for r in out] == [0.0, 2.5, 5.0, 0.0, 1.5, 0.0, 0.0, 0.5]
    assert [r["cusum_down"] for r in out][5:] == [3.5, 6.0, 0.0]
    mean, want = None, []
    for v in values:
        mean = mean if v is None else v if mean is None else 0.1 * v + 0.9 * mean
        want.append(mean)
    assert [r["ewma"] for r in out] == pytest.approx(want)
    free = sorted(drift.control_charts(residuals(spark, values), decision=None).filter("turbine_id = 'A'").collect(), key=lambda r: r["ordinal"])
    plain = sorted(drift.plain_cusum(residuals(spark, values)).filter("turbine_id = 'A'").collect(), key=lambda r: r["ordinal"])
    assert [r["cusum_up"] for r in free] == pytest.approx([r["cusum_up"] for r in plain])


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    z = residuals(spark, [float(v) for v in rng.normal(0.4, 2, 60)])
    for part in range(3):
        z.filter((F.col("ordinal") >= part * 20) & (F.col("ordinal") < part * 20 + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(z.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = drift_monitor.monitor(stream).writeStream.format("memory").queryName("charts").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["turbine_id"], r["ordinal"]): (r["cusum_up"], r["cusum_down"], r["ewma"]) for r in spark.sql("select * from charts").collect()}
    want = {(r["turbine_id"], r["ordinal"]): (r["cusum_up"], r["cusum_down"], r["ewma"]) for r in drift.control_charts(z).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_penalty_is_bounded_and_rows_agree_with_the_report(spark):
    frame = toy(spark, hours=120, change=lambda m, h, r: r | {c: r[c] + (0.1 * math.sin(7 * h + len(c))) + (5 * (h - 80) if m == "A" and h > 80 else 0) for c in drift.SENSORS})
    stats = drift.drift_statistics(frame, F.lit(True), least=24, rows=48)
    total = {r["turbine_id"]: r["penalty"] for r in drift.drift_penalty(drift.drift_report(stats)).collect()}
    assert total["A"] == drift.MOST_POINTS
    last = {r["turbine_id"]: r["penalty"] for r in health.latest_per_machine(drift.row_penalties(stats)).collect()}
    assert all(last[m] == total.get(m, 0.0) for m in ("A", "B"))


def test_health_classes_and_metrics(spark):
    frame = spark.createDataFrame([(80.0,), (79.9,), (60.0,), (40.0,), (39.9,), (None,)], "s double")
    assert [r[0] for r in frame.select(health.health_class("s")).collect()] == ["healthy", "monitor", "monitor", "degraded", "critical", "critical"]
    with pytest.raises(ValueError):
        health.health_class("s", {"healthy": 50.0, "monitor": 60.0, "degraded": 40.0})
    m = health.regression_metrics(spark.createDataFrame([(10.0, 12.0), (90.0, 80.0), (50.0, 50.0)], "truth double, predicted double")).first()
    assert m["mae"] == pytest.approx(4) and m["spearman"] == pytest.approx(1) and m["mae_degraded"] == pytest.approx(1)
    assert health.regression_metrics(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "truth double, predicted double")).first()["spearman"] is None


def test_thresholds_and_areas(spark):
    frame = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.2), (0, 0.2)], "y int, p double")
    assert metrics.roc_auc(frame).first()[0] == pytest.approx(8 / 9)
    assert metrics.pr_auc(frame).first()[0] == pytest.approx((1 + 1 + 3 / 4) / 3)
    points = metrics.threshold_curve(frame)
    assert points.count() == metrics.GRID_SIZE
    row = points.filter("threshold = 0.5").first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (3, 1, 0, 2) and row["cost"] == 5.0
    best = metrics.choose_threshold(points).first()
    assert best["least_cost"] == pytest.approx(0.205) and best["cost"] == 5.0
    with pytest.raises(ValueError):
        metrics.choose_threshold(points, "test")


def test_fusion(spark):
    schema = "turbine_id string, failure_probability double, prediction int, anomaly_score double, anomaly_severity string, anomaly_quality double, health_score double, health_class string, health_quality double, operational_status string"
    cases = [
        ("all", 0.8, 0, 0.5, "normal", 1.0, 50.0, "healthy", 1.0, "normal"), ("two", 0.4, 0, 0.2, "normal", 1.0, None, None, None, None), ("severe", 0.1, 1, 0.1, "alarm", 1.0, 90.0, "healthy", 0.5, "normal"),
        ("lifted", 0.0, 0, 0.0, "warning", 1.0, 100.0, "healthy", 1.0, "normal"), ("none", None, None, None, None, None, None, None, None, None), ("fault", 0.0, 0, 0.0, "normal", 1.0, 100.0, "healthy", 1.0, "fault"),
    ]
    got = {r["turbine_id"]: r for r in fusion.queue(fusion.fused(spark.createDataFrame(cases, schema))).collect()}
    assert "none" not in got
    assert got["all"]["score"] == pytest.approx(0.5 * 0.8 + 0.3 * 0.5 + 0.2 * 0.5) and got["all"]["confidence"] == "high" and got["all"]["risk"] == "high"
    assert got["two"]["score"] == pytest.approx((0.5 * 0.4 + 0.3 * 0.2) / 0.8) and got["two"]["missing"] == ["health"] and got["two"]["confidence"] == "medium"
    assert got["severe"]["action"] == "immediate_engineering_review" and got["severe"]["confidence"] == "low" and "low data quality" in got["severe"]["reasons"]
    assert got["lifted"]["risk"] == "medium" and got["lifted"]["action"] == "plan_inspection" and got["fault"]["within_hours"] == 8
    assert next(iter(got)) in ("severe", "fault")


def test_nested_windows(spark):
    frame = toy(spark, hours=6, change=lambda m, h, r: r | {"vibration": 99.0 if m == "B" and h == 2 else 3.0})
    windows = nested.to_windows(frame)
    assert windows.count() == 2 and nested.to_rows(windows).count() == 12
    assert {(r["turbine_id"], r["violation"]) for r in nested.violations(windows).collect()} == {("B", "bounds_vibration")}
    assert nested.history(frame, 6.0).filter("accepted").count() == 0 and nested.history(frame, 5.0).filter("accepted").count() == 2
    with pytest.raises(nested.TooManyWindows):
        nested.limit_batch(windows, 1)


def test_detectors_rank_outliers_first(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(0, 1, 4).tolist()) for i in range(400)] + [(1000 + i, (rng.normal(0, 1, 4) + 9).tolist()) for i in range(5)]
    frame = spark.createDataFrame(data, "id long, x array<double>")
    forest = anomaly.fit_isolation_forest(frame, "x", "id", trees=40)
    factor = anomaly.fit_outlier_factor(frame.filter("id < 1000"), "x", 20)
    for model in (forest, factor):
        top = anomaly.score_with(frame, model, "x").orderBy(F.desc("novelty")).limit(5).collect()
        assert {r["id"] for r in top} == set(range(1000, 1005))
    sample = anomaly.reference_sample(frame.withColumn("s", F.col("id") >= 1000), ("s",), ("id",), 10)
    assert sample.filter("s").count() == 5


def test_files(spark, tmp_path):
    frame = toy(spark, hours=3)
    for kind in ("parquet", "csv"):
        path = files.write_table(frame, str(tmp_path / f"t.{kind}"))
        assert files.read_table(spark, path).count() == 6
    with pytest.raises(ValueError):
        files.read_table(spark, str(tmp_path / "t.xlsx"))
    with pytest.raises(files.MissingColumns):
        files.require(frame.drop("vibration"))
    assert files.read_document(spark, files.write_document(spark, {"a": [1, 2]}, str(tmp_path / "d"))) == {"a": [1, 2]}
    assert not files.model_available(spark, str(tmp_path / "nothing"))
    assert files.expect_columns(frame, ["vibration", "new"], fill=True).columns == ["vibration", "new"]
