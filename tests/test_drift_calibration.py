"""Charts of a long series in chains, novelty limits, and calibrations that are kept and loaded."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanewright.operators import drift

START = datetime(2024, 1, 1)
SERIES = "turbine_id string, sensor string, timestamp timestamp, ordinal long, z double"


def long_series(n, seed):
    """Values with gaps and NaN, runs that drive an arm over its limit again and again, and a stretch without any."""
    rng = random.Random(seed)
    value = lambda i: None if 500 <= i < 620 or rng.random() < 0.05 else float("nan") if rng.random() < 0.02 else rng.gauss(1.5 if 200 <= i < 320 else -1.2 if i % 400 > 330 else 0, 1)
    return [(i, value(i)) for i in range(n)]


def state_rows(frame):
    cell = lambda v: None if v is None else "nan" if math.isnan(v) else v.hex()
    return sorted((r["turbine_id"], r["sensor"], r["ordinal"], cell(r["cusum_up"]), cell(r["cusum_down"]), cell(r["ewma"])) for r in frame.collect())


@pytest.fixture(scope="module")
def series(spark):
    rows = [("hot", s, START + timedelta(hours=i // 2), i, z) for k, s in enumerate(("vibration", "oil_pressure")) for i, z in long_series(3000, k)]
    rows += [("short", "vibration", START, 1, 7.0), ("empty", "vibration", START, 1, None), ("odd", "vibration", START, 1, float("inf")), ("odd", "vibration", START, 2, 1.0)]
    return spark.createDataFrame(rows, SERIES)


@pytest.mark.parametrize("slice_rows", [25, 200, 900])
def test_chains_give_the_same_bits(series, slice_rows):
    # slices of 25 rows are too short for the mean to meet, and some lie wholly within the stretch without values
    got = state_rows(drift.control_charts(series, slice_rows=slice_rows))
    assert got == state_rows(drift.control_charts(series))


def test_a_long_series_is_folded_in_many_chains(spark):
    rng = random.Random(3)
    series = spark.createDataFrame([("hot", "vibration", START + timedelta(hours=i), i, rng.gauss(0, 1)) for i in range(8000)], SERIES)
    chains = drift.with_chains(series, drift.SLACK, drift.DECISION, drift.LAMBDA, 1000)
    assert chains.select("_chain").distinct().count() >= 5
    assert chains.count() == 8000
    assert state_rows(drift.control_charts(series, slice_rows=1000)) == state_rows(drift.control_charts(series))


def test_no_series_no_charts(spark):
    assert drift.control_charts(spark.createDataFrame([], SERIES)).count() == 0


def test_a_meeting_holds_for_every_start():
    rng = random.Random(5)
    values = np.array([rng.gauss(0, 1) for _ in range(1200)])
    meeting = drift.Meeting(drift.SLACK, drift.DECISION, drift.LAMBDA, 2 * float(np.abs(values).max()))
    meeting.take(values[:5])
    assert meeting.state() is None
    meeting.take(values[5:])
    ends = {drift.fold((a, b, m), values, drift.SLACK, drift.DECISION, drift.LAMBDA)[0] for a in (0.0, 1.7, 4.99) for b in (0.0, 4.99) for m in (None, -2.0, 3.0)}
    assert ends == {meeting.state()}


def residual_rows(spark, n=600):
    rng = random.Random(4)
    rows = [("A", START + timedelta(hours=i), i, [rng.gauss(0, 1) for _ in drift.SENSORS]) for i in range(n)]
    rows[-1] = ("A", *rows[-1][1:3], [25.0] * len(drift.SENSORS))
    return spark.createDataFrame(rows, "turbine_id string, timestamp timestamp, ordinal long, x array<double>")


def test_novelty_is_bounded_and_finds_the_odd_row(spark):
    rows = residual_rows(spark)
    model = drift.fit_novelty(rows.filter("ordinal < 599"), trees=50)
    got = {r["ordinal"]: r["novelty"] for r in drift.novelty_scores(rows, model).collect()}
    assert len(got) == 600 and all(0 <= v <= 1 for v in got.values())
    assert max(got, key=got.get) == 599 and np.median(list(got.values())) == pytest.approx(0.5, abs=0.01)
    # a row's score does not depend on what else is scored
    assert drift.novelty_scores(rows.filter("ordinal = 599"), model).first()["novelty"] == got[599]
    assert drift.fit_novelty(rows.limit(49)) is None


@pytest.fixture(scope="module")
def stats(spark):
    rows = [(t, START + timedelta(hours=i), i, s, 0.0, 0.0, 0.0, float(i % 4), i / 100) for t in "AB" for i in range(200) for s in drift.SENSORS]
    return spark.createDataFrame(rows, "turbine_id string, timestamp timestamp, ordinal long, sensor string, z double, cusum_up double, cusum_down double, signals double, ewma double")


def test_limits_come_from_healthy_rows_and_survive_keeping(spark, stats, tmp_path):
    healthy = stats.filter("turbine_id = 'A'").select("turbine_id", "timestamp").distinct()
    novel = stats.select("turbine_id", "timestamp", "ordinal").distinct().withColumn("novelty", F.when(F.col("ordinal") == 7, F.lit(float("nan"))).when(F.col("ordinal") == 8, F.lit(float("inf"))).when(F.col("turbine_id") == "A", F.col("ordinal") / 300).otherwise(F.lit(0.999)))
    limits = drift.calibrate_novelty(novel, healthy).first()
    values = [i / 300 for i in range(200) if i not in (7, 8)]
    assert limits["novelty_warning"] == pytest.approx(np.quantile(values, 0.95), abs=1e-6)
    assert limits["novelty_alarm"] == pytest.approx(np.quantile(values, 0.99), abs=1e-6)
    assert drift.calibrate_novelty(novel.filter("ordinal = 7"), healthy).count() == 0

    table = drift.calibration_table(drift.calibrate(stats, healthy, 200), drift.calibrate_novelty(novel, healthy))
    path = drift.save_calibration(table, str(tmp_path / "limits"), 1)
    assert drift.load_calibration(spark, path).exceptAll(table).count() == 0
    assert drift.load_calibration(spark, path).count() == len(drift.SENSORS) + 1
    drift.save_calibration(table.filter("sensor <> 'multivariate'"), path, 2)
    assert drift.load_calibration(spark, path).count() == len(drift.SENSORS)
    assert drift.load_calibration(spark, path, 1).count() == len(drift.SENSORS) + 1
    with pytest.raises(Exception, match="(?i)exists"):
        drift.save_calibration(table, path, 2)
    with pytest.raises(ValueError, match="version 9"):
        drift.load_calibration(spark, path, 9)
    with pytest.raises(drift.TooFewHealthyRows):
        drift.calibrate(stats, healthy, 201)  # 200 rows of telemetry, whatever the number of sensors


def test_marked_rows_calibrate_as_a_table_of_keys(spark, monkeypatch):
    """A mark is carried with the rows, whether machines pass whole or not; charts are made once for count and limits."""
    rng = random.Random(9)
    rows = [(t, START + timedelta(hours=i), i, *(rng.gauss(50, 5) for _ in drift.SENSORS), i % 3 == 0) for t in "AB" for i in range(300)]
    frame = spark.createDataFrame(rows, f"turbine_id string, timestamp timestamp, ordinal long, {', '.join(f'{c} double' for c in drift.SENSORS)}, good boolean")
    keys = frame.filter("good").select("turbine_id", "timestamp")
    shown = lambda out: sorted(map(str, out.collect()))
    want, wanted = None, None
    for most in (500, 100):
        made = drift.drift_statistics(frame, F.lit(True), slice_rows=most, carry=("good",))
        calls = spark.sparkContext.accumulator(0)
        counted = made.mapInArrow(lambda batches: (calls.add(b.num_rows) or b for b in batches), made.schema)
        limits = shown(drift.calibrate(counted, "good", 200))
        assert calls.value == 600 * len(drift.SENSORS)  # made twice before
        assert limits == shown(drift.calibrate(made, keys, 200)) and limits == (want := want or limits)
        stats, complete = drift.statistics_and_residuals(frame, F.lit(True), slice_rows=most, carry=("good",))
        assert shown(stats.select(*made.columns)) == shown(made)
        assert shown(complete) == shown(drift.complete_residuals(made, carry=("good",))) and len(shown(complete)) > 400
        assert shown(complete) == (wanted := wanted or shown(complete))
        with pytest.raises(drift.TooFewHealthyRows):
            drift.calibrate(made, "good", 201)


def test_the_report_reads_statistics_once(spark, stats):
    calls = spark.sparkContext.accumulator(0)
    counted = stats.mapInArrow(lambda batches: (calls.add(b.num_rows) or b for b in batches), stats.schema)
    novel = spark.createDataFrame([("A", START + timedelta(hours=199), 0.9)], "turbine_id string, timestamp timestamp, novelty double")
    methods = {r["method"] for r in drift.drift_report(counted, None, novel=novel).collect()}
    assert methods == {"ewma", "cusum", "isolation_forest"} and calls.value == stats.count()  # three times before


def test_report_and_penalties_with_novelty(spark, stats):
    last = START + timedelta(hours=199)
    novel = spark.createDataFrame([("A", last, 0.9), ("A", START, 0.99), ("B", last, 0.7), ("B", START, None)], "turbine_id string, timestamp timestamp, novelty double")
    fixed = {r["turbine_id"]: r["severity"] for r in drift.drift_report(stats, None, novel=novel).filter("sensor = 'multivariate'").collect()}
    assert fixed == {"A": "alarm", "B": "warning"}
    limits = drift.calibration_table(drift.calibrate(stats), spark.createDataFrame([(0.8, 0.95)], "novelty_warning double, novelty_alarm double"))
    report = drift.drift_report(stats, limits, novel=novel)
    fired = report.filter("sensor = 'multivariate'").collect()
    assert [(r["turbine_id"], r["severity"], r["direction"], r["method"], r["statistic"], r["first_detected"]) for r in fired] == [("A", "warning", "none", "isolation_forest", 0.9, None)]
    placed = [r for r in drift.in_order(report).collect() if r["turbine_id"] == "A"]
    ranks = [(-{"alarm": 2, "warning": 1}[r["severity"]], -r["statistic"]) for r in sorted(placed, key=lambda r: r["place"])]
    assert ranks == sorted(ranks) and [r["place"] for r in sorted(placed, key=lambda r: r["place"])] == list(range(1, len(placed) + 1))
    whole = {r["turbine_id"]: r["penalty"] for r in drift.drift_penalty(report).collect()}
    rows = {r["turbine_id"]: r["penalty"] for r in drift.row_penalties(stats, limits, novel).filter(F.col("timestamp") == last).collect()}
    assert whole == {k: v for k, v in rows.items() if v}
    one = drift.drift_penalty(report.filter("sensor = 'multivariate' or sensor = 'vibration'").filter("turbine_id = 'A'")).first()["penalty"]
    alone = drift.drift_penalty(report.filter("sensor = 'vibration' and turbine_id = 'A'")).first()["penalty"]
    assert one == alone + drift.NOVELTY_POINTS


def test_every_feature_of_the_matrices_has_a_name_to_read(spark):
    from vanewright.operators import explain
    from vanewright.operators import features as X

    names = {*X.lags(), *X.rollings(), *X.trends(), *X.interactions(), *X.health_rollings(), *X.health_trends(), *X.physical(), *X.anomaly_physical()}
    names |= {f"{c}_{x}" for c in drift.SENSORS for x in ("z", "cusum_up", "cusum_down", "signals", "ewma", "exceedance", "mean_exceedance", "max_exceedance", "regime_z", "robust_z", "off_past", "off_median", "rms", "p2p", "crest", "skew", "kurtosis", "fast", "crossings")}
    rows = spark.createDataFrame([(n,) for n in sorted(names)], "feature string").withColumn("label", explain.feature_label("feature")).collect()
    assert not [r["feature"] for r in rows if r["label"] == r["feature"].replace("_", " ")]
    labels = {r["feature"]: r["label"] for r in rows}
    assert labels["vibration_range_24h"] == "range of vibration over 24 hours" and labels["vibration_off_mean_168h"] == "vibration against its 168 hour mean"
    assert labels["power_residual"] == "power against the reference curve" and labels["oil_pressure_max_exceedance"] == "most of how far oil pressure is into its alarm band"
