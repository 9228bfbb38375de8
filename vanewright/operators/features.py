"""Feature blocks. Each is a projection over the cleaned table, all on one partitioning and ordering; wide matrices are
built block by block and joined by key only where one is needed."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import TINY, clip, cyclical, each, floor_of, one_hot, ratio
from ..sources.telemetry import SENSORS, STATUSES
from . import drift, rules
from . import windows as W
from .slices import SLICE_ROWS, in_slices
from .regimes import RATED_POWER, REGIMES, producing, reference_power

#: Channels by use, and windows in hours.
DYNAMIC = ("vibration", "gearbox_temperature", "bearing_temperature", "oil_pressure", "generator_temperature", "oil_temperature", "power_output", "rotor_speed", "hydraulic_pressure")
DETAILED = DYNAMIC[:4]
LAGS, WINDOWS, DIFFS, CHANGES, SLOPES = (1, 3, 6, 12, 24), (3, 6, 12, 24, 48), (1, 6, 24), (6, 24), (6, 12, 24)
HEALTH_WINDOWS, HEALTH_SLOPES, HEALTH_DIFF, HEALTH_BASE = (6, 24, 72), (24, 72), 24, 168
CONDITION = ("vibration", "gearbox_temperature", "bearing_temperature", "generator_temperature", "oil_temperature", "oil_pressure", "hydraulic_pressure", "brake_temperature", "nacelle_temperature")
SHAPED = ("vibration", "gearbox_temperature", "oil_pressure")
RELATIVE = ("vibration", "gearbox_temperature", "bearing_temperature", "generator_temperature", "oil_temperature", "oil_pressure")
TRUTH = ("failure_event", "maintenance_event", "degradation_level", "failure_mode", "episode_id", "hours_to_failure", "target", "health_score")

#: Names to columns, or to trailing statistics that are taken all at once (windows.with_columns).
Block = dict[str, Column | W.Trailing]


def raw(frame: DataFrame) -> Block:
    out = {c: F.col(c) for c in SENSORS if c in frame.columns}
    return out | {f"status_{s}": c for s, c in zip(STATUSES, one_hot("operational_status", STATUSES))}


def lags(sensors=DYNAMIC, hours=LAGS, steps=int) -> Block:
    return {f"{c}_lag_{h}h": W.end_of(c, steps(h), "lag") for c in sensors for h in hours}


def rollings(sensors=DYNAMIC, detailed=DETAILED, hours=WINDOWS, steps=int) -> Block:
    """Six statistics of the detailed channels, mean and std of the others; half of a window must be there."""
    out = {}
    for c in sensors:
        for h in hours:
            n = steps(h)
            for stat in ("mean", "std", "min", "max", "median", "range") if c in detailed else ("mean", "std"):
                out[f"{c}_{stat}_{h}h"] = W.trailing_of(c, n, stat, max(int(n * 0.5), 1))
    return out


def trends(sensors=DYNAMIC, diffs=DIFFS, changes=CHANGES, slopes=SLOPES, base: int = 24, steps=int) -> Block:
    """Differences and rates, relative changes, slopes, and the deviation from a trailing mean."""
    out = {}
    for c in sensors:
        for h in diffs:
            out[f"{c}_diff_{h}h"] = W.end_of(c, steps(h), "diff")
            out[f"{c}_rate_{h}h"] = W.end_of(c, steps(h), "rate", float(h))
        out |= {f"{c}_change_{h}h": W.end_of(c, steps(h), "change") for h in changes}
        out |= {f"{c}_slope_{h}h": W.trailing_of(c, steps(h), "slope") for h in slopes}
        out[f"{c}_off_mean_{base}h"] = W.trailing_of(c, steps(base), "off_mean")
    return out


def mean_of(columns) -> Column:
    """Mean over columns that are there; missing if none is."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)), n.cast("double"))


WARM = ("generator_temperature", "gearbox_temperature", "bearing_temperature", "oil_temperature", "nacelle_temperature")


def interactions() -> Block:
    c = F.col
    power, expected, load = c("power_output"), reference_power(), clip(c("power_output") / RATED_POWER, 0, 1.5)
    above = {f"{x}_above_ambient": c(x) - c("ambient_temperature") for x in (*WARM, "brake_temperature")}
    spread = F.greatest(*(c(x) for x in WARM)) - F.least(*(c(x) for x in WARM))
    return above | {
        "speed_ratio": clip(ratio("generator_speed", floor_of(F.abs("rotor_speed"), TINY)), 0, 400),
        "expected_power": expected,
        "power_ratio": F.when(expected > 1, clip(power / floor_of(expected, 1.0), -2, 3)),
        "power_residual": power - expected,
        "power_per_wind3": clip(power / F.pow(floor_of("wind_speed", 0.5), 3), -50, 200),
        "load": load,
        "vibration_per_load": c("vibration") / (load + 0.1),
        "vibration_per_rotor": c("vibration") / floor_of("rotor_speed", 0.5),
        "oil_pressure_per_temperature": c("oil_pressure") / floor_of(F.abs("oil_temperature"), 1.0),
        "oil_pressure_by_temperature": c("oil_pressure") * c("oil_temperature"),
        "oil_pressure_per_load": c("oil_pressure") / (load + 0.1),
        "warmth": mean_of(WARM) - c("ambient_temperature"),
        "warm_spread": spread,
        "hydraulic_per_load": c("hydraulic_pressure") / (load + 0.1),
    }


def with_relative(frame: DataFrame, sensors=DYNAMIC, normal_sensors=DETAILED[:3], least: int = 48, then: Iterable[W.Pass] = ()) -> tuple[DataFrame, list[str]]:
    """Against the machine's own past: medians, means, robust z, and medians over rows of normal status. `then`: further
    passes over the same rows."""
    normal = {f"{c}_normal": F.when(F.col("operational_status") == "normal", F.col(c)) for c in normal_sensors}
    past = {f"{c}_off_past": F.col(c) - W.expanding(c, "mean", least) for c in sensors}
    frame = W.with_medians(frame.withColumns(past), {c: c for c in sensors} | normal, least, then=then)
    block = {f"{c}_off_median": F.col(c) - F.col(f"_median_{c}") for c in sensors}
    block |= {f"{c}_off_normal": F.col(c) - F.col(f"_median_{c}_normal") for c in normal_sensors}
    block |= {f"{c}_robust_z": W.robust_z(c, c) for c in sensors}
    return frame.withColumns(block), [*past, *block]


TIME_PARTS = {"hour": lambda t: F.hour(t), "day_of_week": lambda t: F.weekday(t), "month": lambda t: F.month(t)}


def time_parts(parts=("hour",)) -> Block:
    unknown = [p for p in parts if p not in TIME_PARTS]
    if unknown:
        raise ValueError(f"no time part {unknown[0]}")
    out = {p: TIME_PARTS[p](F.col(W.TIME)) for p in parts}
    if "hour" in parts:
        out["hour_sin"], out["hour_cos"] = cyclical(out["hour"], 24)
    return out


def finalise(frame: DataFrame, names: list[str], key=(W.ENTITY, W.TIME, "ordinal"), carry: tuple[str, ...] = ()) -> DataFrame:
    """Keys and features in order: no truth column, no repeated name, no infinite value. The columns of `carry` follow as
    they are; they are no features."""
    if len(set(names)) < len(names):
        raise ValueError("repeated feature names")
    held = [n for n in names if n in TRUTH]
    if held:
        raise ValueError(f"truth as a feature: {held[0]}")
    kinds = dict(frame.dtypes)
    floats = [n for n in names if kinds[n] in ("double", "float")]
    finite = dict(zip(floats, each(floats, lambda x: F.when(F.abs(x) < float("inf"), x))))
    return frame.select(*(k for k in key if k in frame.columns), *(finite.get(n, F.col(n)) for n in names), *carry)


BLOCKS = ("raw", "lag", "rolling", "trend", "interaction", "relative", "time")
#: What each block reads of a row besides its key.
INPUTS = {"raw": (*SENSORS, "operational_status"), "lag": DYNAMIC, "rolling": DYNAMIC, "trend": DYNAMIC, "interaction": SENSORS, "relative": (*DYNAMIC, "operational_status"), "time": ()}


def with_both(frame: DataFrame, block: Block, relative=None) -> tuple[DataFrame, list[str]]:
    """A block and, if asked for, one that with_medians() makes: its rows are in order, so trailing statistics follow
    without another shuffle."""
    if relative is None:
        return W.with_columns(frame, block), []
    plain = {n: x for n, x in block.items() if not isinstance(x, W.Trailing)}
    rest = {n: x for n, x in block.items() if n not in plain}
    out, names = relative(frame.withColumns(plain))
    return W.with_trailing(out, rest, dealt=True) if rest else out, names


def look_back(block: Block, plain: int) -> int:
    """Rows that a block looks back: its trailing windows', and so many for its plain columns."""
    return max([plain, *(x.rows for x in block.values() if isinstance(x, W.Trailing))])


def with_bounded(frame: DataFrame, block: Block, plain: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """A block whose plain columns look back at most `plain` rows, built in slices of long machines."""
    return in_slices(frame, look_back(block, plain), lambda f: W.with_columns(f, block), slice_rows)


def failure_features(frame: DataFrame, blocks=BLOCKS, steps=int, slice_rows: int = SLICE_ROWS, carry: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, list[str]]]:
    """The feature matrix of these blocks and its specification (block -> names in order). `carry`: columns of the frame
    that go along behind the features, such as labels."""
    needed = {W.ENTITY, W.TIME, "ordinal", *carry}.union(*(INPUTS[b] for b in blocks))
    frame = frame.select(*(c for c in frame.columns if c in needed))
    made = {"raw": raw(frame), "lag": lags(steps=steps), "rolling": rollings(steps=steps), "trend": trends(steps=steps), "interaction": interactions(), "time": time_parts()}
    spec: dict[str, list[str]] = {}
    every = {n: x for b in blocks if b != "relative" for n, x in made[b].items()}
    trailing = {n: x for n, x in every.items() if isinstance(x, W.Trailing)}
    if "relative" in blocks:
        out, relative = with_relative(frame, then=[W.trailing_pass(trailing)] if trailing else [])
    else:
        # all windows are bounded, so a long machine is built in slices
        out, relative = with_bounded(frame, trailing, 0, slice_rows) if trailing else frame, []
    out = out.withColumns({n: x for n, x in every.items() if n not in trailing})
    for b in blocks:
        spec[b] = relative if b == "relative" else list(made[b])
    return finalise(out, [n for names in spec.values() for n in names], carry=carry), spec


def required_rows(hours=(LAGS, WINDOWS, SLOPES, DIFFS), steps=int) -> int:
    """The longest look back of a configuration, in rows."""
    return max(steps(h) for group in hours for h in group)


def history_status(frame: DataFrame, required: int) -> DataFrame:
    """(turbine_id, rows, required, enough): whether each machine has the rows that features look back over."""
    return frame.groupBy(W.ENTITY).agg(F.count("*").alias("rows")).select(W.ENTITY, "rows", F.lit(required).cast("long").alias("required"), (F.col("rows") >= required).alias("enough"))


def health_rollings(sensors=CONDITION, hours=HEALTH_WINDOWS, steps=int) -> Block:
    return {f"{c}_{s}_{h}h": W.trailing_of(c, steps(h), s) for c in sensors for h in hours for s in ("mean", "std", "max")}


def health_trends(sensors=CONDITION, slopes=HEALTH_SLOPES, diff: int = HEALTH_DIFF, base: int = HEALTH_BASE, steps=int) -> Block:
    out = {f"{c}_slope_{h}h": W.trailing_of(c, steps(h), "slope") for c in sensors for h in slopes}
    out |= {f"{c}_diff_{diff}h": W.end_of(c, steps(diff), "diff") for c in sensors}
    return out | {f"{c}_off_mean_{base}h": W.trailing_of(c, steps(base), "off_mean") for c in sensors}


def shape_inputs(sensors=SHAPED) -> Block:
    """Powers of each sensor and its distance from 0, of which shape_passes() take trailing statistics."""
    return {f"_{c}_p{k}": F.pow(F.col(c), k) for c in sensors for k in (2, 3, 4)} | {f"_{c}_abs": F.abs(F.col(c)) for c in sensors}


#: Working columns of the shape that nothing reads after the passes.
SHAPE_INNER = tuple(f"_{c}_{k}" for c in SHAPED for k in ("p2", "p3", "p4", "abs", "d", "side", "turn", "cross"))


def shape_passes(sensors=SHAPED, hours: int = 24, steps=int) -> list[W.Pass]:
    """Raw moments, peaks, changes and crossings of the mean over a trailing window, of rows with shape_inputs()."""
    n = steps(hours)
    least = max(n // 2, 3)
    before = {}
    for c in sensors:
        before |= {f"_{c}_m{k}": W.trailing_of(f"_{c}_p{k}" if k > 1 else c, n, "mean", least) for k in (1, 2, 3, 4)}
        before |= {f"_{c}_p2p": W.trailing_of(c, n, "range", least), f"_{c}_peak": W.trailing_of(f"_{c}_abs", n, "max", 1), f"_{c}_sd": W.trailing_of(f"_{c}_d", n, "std", 1)}
    # the side of the mean, to nine decimals; two rows' sides have a range where they differ
    side = lambda x, mean: np.where(np.abs(x - mean) < 5e-10, 0.0, np.sign(x - mean))
    cross = lambda turn: (turn > 0).astype(float)
    return [
        W.trailing_pass({f"_{c}_d": W.end_of(c, 1, "diff") for c in sensors}),
        W.trailing_pass(before),
        W.made_pass({f"_{c}_side": side for c in sensors}, {f"_{c}_side": (c, f"_{c}_m1") for c in sensors}),
        W.trailing_pass({f"_{c}_turn": W.trailing_of(f"_{c}_side", 2, "range", 2) for c in sensors}),
        W.made_pass({f"_{c}_cross": cross for c in sensors}, {f"_{c}_cross": (f"_{c}_turn",) for c in sensors}),
        W.trailing_pass({f"_{c}_crossings": W.trailing_of(f"_{c}_cross", n, "mean", 1) for c in sensors}),
    ]


def with_shape(frame: DataFrame, sensors=SHAPED, hours: int = 24, steps=int) -> tuple[DataFrame, list[str]]:
    """Shape of the signal over a trailing window, from raw moments: rms, peak to peak, crest, skewness, excess
    kurtosis, share of fast changes, and rate of crossings of the mean."""
    rows = frame.repartition(W.ENTITY).sortWithinPartitions(W.ENTITY, W.TIME).withColumns(shape_inputs(sensors))
    inner = [n for n in SHAPE_INNER if any(n.startswith(f"_{c}_") for c in sensors)]
    return with_shape_of(W.with_passes(rows, shape_passes(sensors, hours, steps), inner), sensors)


def with_shape_of(frame: DataFrame, sensors=SHAPED) -> tuple[DataFrame, list[str]]:
    """The shape from what shape_passes() have added."""
    after = {}
    var = {c: F.col(f"_{c}_m2") - F.col(f"_{c}_m1") * F.col(f"_{c}_m1") for c in sensors}
    frame = frame.withColumns({f"_{c}_s": F.sqrt(F.when(var[c] < 0, F.lit(0.0)).otherwise(var[c])) for c in sensors} | {f"_{c}_r": F.sqrt(f"_{c}_m2") for c in sensors})
    for c in sensors:
        m1, m2, m3, m4 = (F.col(f"_{c}_m{k}") for k in (1, 2, 3, 4))
        sd, rms = F.col(f"_{c}_s"), F.col(f"_{c}_r")
        wide = lambda num, den: F.when(den > TINY, num / den)
        after |= {
            f"{c}_rms": rms,
            f"{c}_p2p": F.col(f"_{c}_p2p"),
            f"{c}_crest": F.when(F.col(f"_{c}_m1").isNotNull(), wide(F.col(f"_{c}_peak"), rms)),
            f"{c}_skew": wide(m3 - 3 * m1 * m2 + 2 * F.pow(m1, 3), F.pow(sd, 3)),
            f"{c}_kurtosis": wide(m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * F.pow(m1, 4), F.pow(sd, 4)) - 3,
            f"{c}_fast": wide(F.col(f"_{c}_sd"), sd),
            f"{c}_crossings": F.col(f"_{c}_crossings"),
        }
    working = ("m1", "m2", "m3", "m4", "p2p", "peak", "sd", "crossings", "s", "r")
    return frame.withColumns(after).drop(*(f"_{c}_{k}" for c in sensors for k in working)), list(after)


def with_regime_relative(frame: DataFrame, mask: Column, sensors=RELATIVE, least: int = 72, then: Iterable[W.Pass] = (), drop: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """Against the machine's own past while it was producing. `then`, `drop`: as with_medians() has them."""
    masked = {c: F.when(mask, F.col(c)) for c in sensors}
    block = {f"{c}_off_producing": F.col(c) - F.col(f"_median_{c}") for c in sensors} | {f"{c}_producing_z": W.robust_z(m, c) for c, m in masked.items()}
    frame = W.with_medians(frame, masked, least, then=then, drop=drop).withColumns(block)
    return frame.drop(*(f"_{kind}_{c}" for c in sensors for kind in ("median", "mad"))), list(block)


def physical() -> Block:
    c = F.col
    power, expected, load = c("power_output"), reference_power(), clip(c("power_output") / RATED_POWER, 0, 1.5)
    hot = WARM[:3]
    return {f"{x}_above_ambient": c(x) - c("ambient_temperature") for x in WARM} | {
        "power_residual": power - expected,
        "power_ratio": F.when(expected > 1, clip(power / floor_of(expected, 1.0), -2, 3)),
        "load": load,
        "vibration_per_load": c("vibration") / (load + 0.1),
        "oil_pressure_per_load": c("oil_pressure") / (load + 0.1),
        "oil_pressure_per_temperature": c("oil_pressure") / floor_of(F.abs("oil_temperature"), 1.0),
        "thermal_stress": mean_of(hot) - c("ambient_temperature"),
        "thermal_spread": F.greatest(*(c(x) for x in hot)) - F.least(*(c(x) for x in hot)),
    }


def rule_block(hours: int = 24, steps=int) -> Block:
    """Exceedance of each rule with its trailing mean and maximum, and counts of flags with their trailing means, of a
    frame with what rules.with_row_flags() makes."""
    out, n = {}, steps(hours)
    for c in rules.SENSORS:
        out |= {f"{c}_exceedance": F.col(f"{c}_exceedance")} | {f"{c}_{s}_exceedance": W.trailing_of(f"{c}_exceedance", n, s) for s in ("mean", "max")}
    counts = ("warnings", "alarms", "invalid")
    return out | {c: F.col(c) for c in counts} | {f"{c}_mean_{hours}h": W.trailing_of(c, n, "mean") for c in counts}


def health_features(frame: DataFrame, sensors=DYNAMIC, steps=int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, list[str]]]:
    """The whole health matrix and its specification (block -> names in order), of a frame with regimes. All blocks are
    made over one dealing of the rows by machine: windows first, then medians, flags, trailing statistics and charts in
    one Python process a task, so what is shuffled is the telemetry and not the matrix. `carry`: as failure_features() has it."""
    made = {"condition": {c: F.col(c) for c in sensors} | {f"regime_{r}": c for r, c in zip(REGIMES, one_hot("regime", REGIMES))}, "rolling": health_rollings(sensors, steps=steps), "trend": health_trends(sensors, steps=steps), "physical": physical(), "rule": rule_block(steps=steps)}
    needed = {W.ENTITY, W.TIME, "ordinal", "regime", *SENSORS, *carry}
    out = frame.select(*(c for c in frame.columns if c in needed)).repartition(W.ENTITY).sortWithinPartitions(W.ENTITY, W.TIME, "ordinal")
    out = W.with_masked_z(out, {c: c for c in drift.SENSORS}, producing(frame), drift.LEAST_PAST, suffix="_z")
    out = rules.with_exceedances(out.withColumns(shape_inputs()))
    # the plain columns of the rule block are there before the windows; invalid readings are counted after moves
    trailing = {n: x for block in made.values() for n, x in block.items() if isinstance(x, W.Trailing)}
    moved = rules.moves_pass()
    passes = [moved, rules.invalid_pass(), W.trailing_pass(trailing), *shape_passes(steps=steps), drift.charts_pass({c: f"{c}_z" for c in drift.SENSORS})]
    out, relative = with_regime_relative(out, producing(out), least=48, then=passes, drop=(*moved.added, *SHAPE_INNER))
    out = out.withColumns({n: x for b, block in made.items() if b != "rule" for n, x in block.items() if n not in trailing})
    out, shape = with_shape_of(out)
    spec = {b: list(made[b]) for b in ("condition", "rolling", "trend")} | {"shape": shape, "relative": relative, "rule": list(made["rule"])}
    spec["drift"] = [f"{s}_{c}" for s in drift.SENSORS for c in drift.BLOCK]
    spec["physical"] = list(made["physical"])
    return finalise(out, [n for names in spec.values() for n in names], carry=carry), spec


def anomaly_physical() -> Block:
    """Where a reading lies for its operating point, unclipped: a detector is to see how far off it is. Wind that is
    missing counts as none."""
    c = F.col
    power, expected = c("power_output"), reference_power(F.coalesce("wind_speed", F.lit(0.0)))
    return {f"{x}_above_ambient": c(x) - c("ambient_temperature") for x in (*WARM, "brake_temperature")} | {
        "power_residual": power - expected,
        "power_ratio": F.when(expected > 1, power / floor_of(expected, 1.0)),
        "generator_rotor_ratio": c("generator_speed") / floor_of(F.abs("rotor_speed"), 0.5),
        "vibration_per_load": c("vibration") / (floor_of(power, 0.0) / RATED_POWER + 0.1),
        "oil_pressure_per_temperature": c("oil_pressure") / floor_of(F.abs("oil_temperature"), 1.0),
    }


def anomaly_features(frame: DataFrame, sensors=DYNAMIC, steps=int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Raw channels and regimes, rolling means and deviations, differences, slopes, readings by operating point, and z
    scores within machine and regime: 130 features of the nine dynamic sensors. `carry`: as failure_features() has it."""
    block: Block = {c: F.col(c) for c in SENSORS}
    block |= {f"regime_{r}": c for r, c in zip(REGIMES, one_hot("regime", REGIMES))}
    block |= {f"{c}_{s}_{h}h": W.trailing_of(c, steps(h), s) for c in sensors for h in HEALTH_WINDOWS for s in ("mean", "std")}
    block |= {f"{c}_diff_{h}h": W.end_of(c, steps(h), "diff") for c in sensors for h in (6, 24)}
    block |= {f"{c}_slope_{h}h": W.trailing_of(c, steps(h), "slope") for c in sensors for h in HEALTH_SLOPES}
    block |= anomaly_physical()
    needed = {W.ENTITY, W.TIME, "ordinal", "regime", *SENSORS, *carry}
    frame = frame.select(*(c for c in frame.columns if c in needed))
    frame = W.with_masked_z(frame, {c: c for c in sensors}, F.col("regime") != "offline", 24, W.ENTITY, "regime", suffix="_regime_z")
    trailing = {n: x for n, x in block.items() if isinstance(x, W.Trailing)}
    frame = W.with_trailing(frame, trailing).withColumns({n: x for n, x in block.items() if n not in trailing})
    names = [*block, *(f"{c}_regime_z" for c in sensors)]
    return finalise(frame, names, carry=carry), names
