"""Sensor rules: one row per sensor with its hard limits, envelope and dynamics. Telemetry is taken to long form
(turbine_id, timestamp, ordinal, sensor, value) so that one code path serves all sensors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import holds
from . import windows as W

SCHEMA = "sensor string, component string, unit string, hard_min double, hard_max double, direction string, warn double, alarm double, max_rate double, stuck_tolerance double, source string"
#: The rules (limits above for high_is_bad, below for low_is_bad).
RULES = (
    ("vibration", "drivetrain", "mm/s RMS", 0.0, 25.0, "high_is_bad", 7.5, 11.0, 8.0, 0.02, "industry_standard"),
    ("gearbox_temperature", "gearbox", "degC", -30.0, 160.0, "high_is_bad", 75.0, 90.0, 15.0, 0.05, "expert_judgement"),
    ("bearing_temperature", "drivetrain", "degC", -30.0, 160.0, "high_is_bad", 70.0, 85.0, 12.0, 0.05, "expert_judgement"),
    ("generator_temperature", "generator", "degC", -30.0, 200.0, "high_is_bad", 115.0, 135.0, 25.0, 0.05, "industry_standard"),
    ("oil_temperature", "lubrication", "degC", -30.0, 130.0, "high_is_bad", 70.0, 85.0, 12.0, 0.05, "expert_judgement"),
    ("oil_pressure", "lubrication", "bar", 0.0, 12.0, "low_is_bad", 3.6, 2.8, 3.0, 0.01, "data_analysis"),
    ("hydraulic_pressure", "hydraulic", "bar", 0.0, 300.0, "low_is_bad", 150.0, 120.0, 60.0, 0.1, "data_analysis"),
    ("brake_temperature", "brake", "degC", -30.0, 400.0, "high_is_bad", 180.0, 260.0, 120.0, 0.05, "expert_judgement"),
    ("rotor_speed", "rotor", "rpm", 0.0, 25.0, "high_is_bad", 17.0, 19.5, 20.0, 0.01, "expert_judgement"),
    ("generator_speed", "generator", "rpm", 0.0, 2200.0, "high_is_bad", 1850.0, 2000.0, 1500.0, 0.5, "expert_judgement"),
)
STUCK_HOURS = 6
SENSORS = tuple(r[0] for r in RULES)
CHECKS = ("out_of_range", "warning", "alarm", "stuck", "rate")


class BadRules(ValueError):
    """A rule table that contradicts itself."""


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """The rules as a frame, if limits are in order, directions known and sources given."""
    for r in rules:
        name, low, high, direction, warn, alarm, source = r[0], r[3], r[4], r[5], r[6], r[7], r[10]
        if direction not in ("high_is_bad", "low_is_bad"):
            raise BadRules(f"{name}: direction {direction}")
        if not (low < high and (alarm > warn if direction == "high_is_bad" else alarm < warn)):
            raise BadRules(f"{name}: limits out of order")
        if not source:
            raise BadRules(f"{name}: no source")
    return spark.createDataFrame(list(rules), SCHEMA)


def to_long(frame: DataFrame, sensors=SENSORS, keys=("turbine_id", "timestamp", "ordinal")) -> DataFrame:
    return frame.select(*keys, *(F.col(c).cast("double").alias(c) for c in sensors)).unpivot(list(keys), list(sensors), "sensor", "value")


def sign(direction: Column | None = None) -> Column:
    return F.when((F.col("direction") if direction is None else direction) == "high_is_bad", 1.0).otherwise(-1.0)


def exceedance(value: Column | str = "value", limits: tuple[Column, Column, Column] | None = None) -> Column:
    """0 within the envelope, 1 at the alarm limit, linear past it; missing values exceed nothing. limits: (direction,
    warn, alarm), the columns of the rule unless given."""
    v = F.col(value) if isinstance(value, str) else value
    direction, warn, alarm = limits or (F.col("direction"), F.col("warn"), F.col("alarm"))
    past = sign(direction) * (v - warn) / F.abs(alarm - warn)
    return F.when(past > 0, past).when(v.isNotNull(), 0.0)


def severity(value: Column | str = "value") -> Column:
    """alarm at or past the alarm limit, warning strictly past the warning limit."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(holds(sign() * (v - F.col("alarm")) >= 0), "alarm").when(holds(sign() * (v - F.col("warn")) > 0), "warning").otherwise("none")


def moves_pass(sensors=SENSORS, stuck_rows: int = STUCK_HOURS, step_hours: float = 1.0) -> W.Pass:
    """Of each sensor what its flags need of earlier rows: _span_<sensor>, the distance of the last rows where all are
    there, and _rate_<sensor>."""
    lead = max(stuck_rows, 2) - 1
    names = [f"_{k}_{c}" for c in sensors for k in ("span", "rate")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, before = None, {}
        for batch in batches:
            n, extra = batch.num_rows, []
            if n == 0:
                continue
            owner = batch.column(W.ENTITY)
            codes = owner.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            first = np.concatenate([[True], np.diff(codes) != 0])
            starts = np.flatnonzero(first)
            place = np.arange(n) - np.repeat(starts, np.diff([*starts, n]))
            if machine is not None and owner[0].as_py() == machine[0]:
                place[: starts[1] if len(starts) > 1 else n] += machine[1]
            for c in sensors:
                x, there = W.floats(batch, c), batch.column(c).is_valid().to_numpy(zero_copy_only=False)
                past = before.get(c, (np.zeros(lead), np.zeros(lead, bool)))
                x, there = np.concatenate([past[0], x]), np.concatenate([past[1], there])
                before[c] = x[-lead:], there[-lead:]
                seen = np.lib.stride_tricks.sliding_window_view(x, stuck_rows)[-n:]
                whole = np.lib.stride_tricks.sliding_window_view(there, stuck_rows)[-n:].all(1) & (place >= stuck_rows - 1)
                with np.errstate(invalid="ignore"):
                    span, rate = seen.max(1) - seen.min(1), np.abs(x[lead:] - x[lead - 1 : -1]) / step_hours
                extra += [pa.array(span, mask=~whole), pa.array(rate, mask=~(there[lead:] & there[lead - 1 : -1] & (place > 0)))]
            machine = owner[n - 1].as_py(), int(place[-1]) + 1
            yield W.with_added(batch, dict(zip(names, extra)))

    return W.Pass(names, run)


def moves(frame: DataFrame, sensors=SENSORS, stuck_rows: int = STUCK_HOURS, step_hours: float = 1.0, dealt: bool = False) -> DataFrame:
    """Adds what moves_pass() makes. Sensors stay side by side, so a row is shuffled once and narrow. `dealt`: the rows
    are in order by machine and time already."""
    rows = frame if dealt else frame.repartition(W.ENTITY).sortWithinPartitions(W.ENTITY, W.TIME)
    return W.with_passes(rows, [moves_pass(sensors, stuck_rows, step_hours)])


def flags_of(stuck_rows: int = STUCK_HOURS) -> dict[str, Column]:
    """The flags of a reading `value` with its `_span`, `_rate` and `exceedance` beside the limits of its rule."""
    return {
        "out_of_range": holds(~F.col("value").between(F.col("hard_min"), F.col("hard_max"))),
        "warning": holds(F.col("exceedance") > 0),
        "alarm": holds(F.col("exceedance") >= 1),
        "stuck": (F.lit(stuck_rows) > 1) & holds(F.col("_span") <= F.col("stuck_tolerance")),
        "rate": holds(F.col("_rate") > F.col("max_rate")),
    }


def flagged(frame: DataFrame, rules: DataFrame, stuck_rows: int = STUCK_HOURS, step_hours: float = 1.0) -> DataFrame:
    """Long rows with exceedance, severity and the five flags of each sensor's rule."""
    keys = ("turbine_id", "timestamp", "ordinal")
    wide = moves(frame.select(*keys, *SENSORS), SENSORS, stuck_rows, step_hours)
    stacked = F.array(*(F.struct(F.lit(c).alias("sensor"), F.col(c).cast("double").alias("value"), F.col(f"_span_{c}").alias("_span"), F.col(f"_rate_{c}").alias("_rate")) for c in SENSORS))
    long = wide.select(*keys, F.inline(stacked)).join(F.broadcast(rules), "sensor")  # a rule for each sensor at most
    return long.withColumns({"exceedance": exceedance(), "severity": severity()}).withColumns(flags_of(stuck_rows)).drop("_span", "_rate")


def with_exceedances(frame: DataFrame, rules=RULES) -> DataFrame:
    """Adds <sensor>_exceedance of every rule, and warnings and alarms as row_flags() counts them."""
    limits = {r[0]: tuple(map(F.lit, (r[5], r[6], r[7]))) for r in rules}
    out = frame.withColumns({f"{c}_exceedance": exceedance(F.col(c).cast("double"), x) for c, x in limits.items()})
    count = lambda least: reduce(lambda a, b: a + b, (holds(least(F.col(f"{c}_exceedance"))).cast("double") for c in limits))
    return out.withColumns({"warnings": count(lambda e: e > 0), "alarms": count(lambda e: e >= 1)})


def invalid_pass(rules=RULES, stuck_rows: int = STUCK_HOURS) -> W.Pass:
    """invalid, as row_flags() counts it, of rows with what moves_pass() adds. NaN lies outside any limits and is above
    any rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for r in rules:
                x, span, rate = (W.floats(batch, n) for n in (r[0], f"_span_{r[0]}", f"_rate_{r[0]}"))
                there, moved = (batch.column(n).is_valid().to_numpy(zero_copy_only=False) for n in (r[0], f"_rate_{r[0]}"))
                with np.errstate(invalid="ignore"):
                    total += (there & ~((x >= r[3]) & (x <= r[4]))) | ((stuck_rows > 1) & (span <= r[9])) | (moved & ~(rate <= r[8]))
            yield W.with_added(batch, {"invalid": pa.array(total)})

    return W.Pass(["invalid"], run)


def with_row_flags(frame: DataFrame, rules=RULES, stuck_rows: int = STUCK_HOURS, step_hours: float = 1.0, dealt: bool = False) -> DataFrame:
    """Adds what with_exceedances() and invalid_pass() make; rows stay as wide as they are, and nothing is stacked or
    grouped. `dealt`: the rows are in order by machine and time already."""
    sensors = tuple(r[0] for r in rules)
    rows = frame if dealt else frame.repartition(W.ENTITY).sortWithinPartitions(W.ENTITY, W.TIME)
    moved = moves_pass(sensors, stuck_rows, step_hours)
    return W.with_passes(with_exceedances(rows, rules), [moved, invalid_pass(rules, stuck_rows)], moved.added)


def flag_counts(flags: DataFrame) -> DataFrame:
    """(sensor, check, n)."""
    counts = flags.groupBy("sensor").agg(*(F.count_if(c).alias(c) for c in CHECKS))
    return counts.unpivot(["sensor"], list(CHECKS), "check", "n")


def row_flags(flags: DataFrame) -> DataFrame:
    """Per row of telemetry: counts of warnings, alarms and validity flags over its sensors."""
    invalid = F.col("out_of_range") | F.col("stuck") | F.col("rate")
    return flags.groupBy("turbine_id", "timestamp", "ordinal").agg(F.count_if("warning").alias("warnings"), F.count_if("alarm").alias("alarms"), F.count_if(invalid).alias("invalid"))


def data_quality(flags: DataFrame) -> DataFrame:
    """One row: share of rows without a validity flag. The envelope does not count."""
    return row_flags(flags).agg((1 - F.avg((F.col("invalid") > 0).cast("double"))).alias("data_quality"))


def rule_features(flags: DataFrame, rows: int = 24) -> DataFrame:
    """(key, sensor, exceedance, its trailing mean and maximum), of rows as flagged() gives them: in order by machine and
    time, a row's sensors together. They stay where they are."""
    least = max(rows // 2, 1)
    block = {f"{s}_exceedance": W.trailing_of("exceedance", rows, s, least) for s in ("mean", "max")}
    return W.with_passes(flags.select("turbine_id", "timestamp", "ordinal", "sensor", "exceedance"), [W.trailing_pass(block, "sensor")])


def window_violations(flags: DataFrame) -> DataFrame:
    """(turbine_id, sensor, kind, share): the last row's severity with the share of rows at that level, and validity
    checks that fired anywhere."""
    by = flags.groupBy("turbine_id", "sensor").agg(
        F.max_by(F.when(F.col("severity") == "alarm", 2).when(F.col("severity") == "warning", 1).otherwise(0), "timestamp").alias("severity"), F.count("*").alias("n"), F.count_if("warning").alias("warnings"), F.count_if("alarm").alias("alarms"), *(F.count_if(c).alias(c) for c in ("out_of_range", "stuck", "rate"))
    )
    # a text in an aggregate's buffer would have all rows sorted
    by = by.withColumn("severity", F.when(F.col("severity") == 2, "alarm").when(F.col("severity") == 1, "warning").otherwise("none"))
    level = F.when(F.col("severity") == "alarm", F.col("alarms")).otherwise(F.col("warnings"))
    kinds = [F.struct(F.col("severity").alias("kind"), (level / F.col("n")).alias("share"), (F.col("severity") != "none").alias("_fired"))]
    kinds += [F.struct(F.lit(c).alias("kind"), (F.col(c) / F.col("n")).alias("share"), (F.col(c) > 0).alias("_fired")) for c in ("out_of_range", "stuck", "rate")]
    return by.select("turbine_id", "sensor", F.inline(F.array(*kinds))).filter("_fired").drop("_fired")


def rule_records(rules: DataFrame, frame: DataFrame) -> DataFrame:
    """Every rule as a record, with the readings that it watches and those that its warning limit lies below (or above);
    a rule whose sensor has no reading keeps its record."""
    watched = to_long(frame).join(F.broadcast(rules.select("sensor", "direction", "warn")), "sensor")
    past = holds(sign() * (F.col("value") - F.col("warn")) > 0)
    counts = watched.groupBy("sensor").agg(F.count("value").alias("readings"), F.count_if(past).alias("past_warning"))
    # one row a sensor
    return rules.join(F.broadcast(counts), "sensor", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("readings", "past_warning")})


def with_limits(frame: DataFrame, rules: DataFrame) -> DataFrame:
    """Sensor history with its limits beside it."""
    return to_long(frame).join(F.broadcast(rules.select("sensor", "unit", "warn", "alarm", "direction")), "sensor")
