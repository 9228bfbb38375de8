"""Window primitives and feature blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import cyclical, each, one_hot, rounded
from ..operators import features as X
from ..operators import regimes as G
from ..operators import windows as W
from ..sources import telemetry as T
from . import sql as S
from .cleaning_queries import ID, keyed, keyed_events
from .registry import query

ROWS = f"x AS (SELECT *, CAST(row_number() OVER ({S.BY}) AS DOUBLE) AS _row FROM m)"


def shown(frame: DataFrame, names, places: int = 4) -> DataFrame:
    kinds = dict(frame.dtypes)
    floats = [c for c in names if kinds[c] in ("double", "float")]
    made = dict(zip(floats, each(floats, lambda x: rounded(x, places))))
    return frame.select(*ID, *(made.get(c, F.col(c)) for c in names))


def listed(block: dict[str, str], places: int = 4) -> str:
    return ", ".join(f"{S.r(e, places)} AS {n}" for n, e in block.items())


_v = "vibration"


@query("a12_required_history", f"WITH {S.MACHINES} SELECT turbine_id, count(*) AS rows, CAST({X.required_rows()} AS BIGINT) AS required, count(*) >= {X.required_rows()} AS enough FROM m GROUP BY 1")
def a12(spark, d):
    return X.history_status(keyed(spark, d), X.required_rows())


@query("e1_lag", f"WITH {S.EVENTS} SELECT turbine_id, ordinal, {listed({f'lag_{n}': f'lag({_v}, {n}) {S.LAG}' for n in X.LAGS})} FROM m")
def e1(spark, d):
    return shown(keyed_events(spark, d).withColumns({f"lag_{n}": W.lag(_v, n) for n in X.LAGS}), [f"lag_{n}" for n in X.LAGS])


@query("e2_diff", f"WITH {S.EVENTS} SELECT turbine_id, ordinal, {listed({f'diff_{n}': f'{_v} - lag({_v}, {n}) {S.LAG}' for n in X.DIFFS})} FROM m")
def e2(spark, d):
    return shown(keyed_events(spark, d).withColumns({f"diff_{n}": W.diff(_v, n) for n in X.DIFFS}), [f"diff_{n}" for n in X.DIFFS])


def pct_sql(c: str, n: int) -> str:
    before = f"lag({c}, {n}) {S.LAG}"
    return S.clip(f"({c} - {before}) / ({S.at_least(f'abs({before})', 1e-06)})", -50.0, 50.0)


@query("e3_pct_change", f"WITH {S.EVENTS} SELECT turbine_id, ordinal, {listed({f'change_{n}': f'({pct_sql(_v, n)}) * pi()' for n in (1, 6)})} FROM m")
def e3(spark, d):
    return shown(keyed_events(spark, d).withColumns({f"change_{n}": W.pct_change(_v, n) * F.pi() for n in (1, 6)}), ["change_1", "change_6"])


_stats = ("mean", "std", "min", "max", "median", "sum", "range")


@query("e4_rolling", f"WITH {S.EVENTS} SELECT turbine_id, ordinal, {listed({f'{s}_{n}': S.rolling(_v, n, s) for s in _stats for n in (6, 24)})} FROM m")
def e4(spark, d):
    made = {f"{s}_{n}": W.rolling(_v, n, s) for s in _stats for n in (6, 24)}
    return shown(X.with_bounded(keyed_events(spark, d), made, 24), made)


@query("e5_rolling_slope", f"WITH {S.EVENTS}, {ROWS} SELECT turbine_id, ordinal, {listed({f'slope_{n}': S.slope(_v, n) for n in X.SLOPES})} FROM x")
def e5(spark, d):
    made = {f"slope_{n}": W.slope(_v, n) for n in X.SLOPES}
    return shown(W.with_position(keyed_events(spark, d)).withColumns(made), made)


@query("e6_expanding_baseline", f"WITH {S.EVENTS} SELECT turbine_id, ordinal, {listed({s: S.expanding(_v, s, 5) for s in ('mean', 'median', 'std')})} FROM m")
def e6(spark, d):
    made = {s: W.expanding(_v, s, 5) for s in ("mean", "median", "std")}
    return shown(keyed_events(spark, d).withColumns(made), made)


def robust_sql(columns, least: int, source: str = "m", suffix: str = "_z") -> str:
    med = ", ".join(f"{S.expanding(c, 'median', least)} AS _m_{c}" for c in columns)
    dev = ", ".join(f"abs({c} - _m_{c}) AS _d_{c}" for c in columns)
    z = ", ".join(f"{S.r('(' + c + ' - _m_' + c + ') / nullif(' + S.at_least(f'1.4826 * ({mad})', 1e-06) + ', 0)')} AS {c}{suffix}" for c in columns for mad in [S.expanding(f"_d_{c}", "median", least)])
    return f"z1 AS (SELECT *, {med} FROM {source}), z2 AS (SELECT *, {dev} FROM z1), z3 AS (SELECT turbine_id, timestamp, ordinal, {z} FROM z2)"


@query("e7_robust_z", f"WITH {S.EVENTS}, {robust_sql([_v], 10)} SELECT * EXCLUDE (timestamp) FROM z3")
def e7(spark, d):
    return shown(W.with_robust_z(keyed_events(spark, d), {_v: _v}, 10), ["vibration_z"])


@query("e8_cyclical", "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS s, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS c FROM events")
def e8(spark, d):
    s, c = cyclical(F.hour("ts"), 24)
    return T.read(spark, d, "events").select("event_id", rounded(s, 6).alias("s"), rounded(c, 6).alias("c"))


@query("e9_one_hot", f"WITH {S.EVENTS} SELECT turbine_id, ordinal, {', '.join(f'''(operational_status = '{s}')::INT AS is_{s}''' for s in T.STATUSES)} FROM m")
def e9(spark, d):
    return keyed_events(spark, d).select(*ID, *one_hot("operational_status", T.STATUSES))


@query("e10_leakage_check", f"WITH {S.MACHINES}, l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp DESC) > 1) SELECT count(*) AS rows, 0 AS leaking FROM l")
def e10(spark, d):
    """Features of all rows before a machine's last one, with that last row changed by 1000: none may change."""
    frame = keyed(spark, d)
    made = lambda f: f.withColumns({f"{c}_m": W.rolling(c, 6, "mean") for c in ("vibration", "oil_pressure")} | {f"{c}_p": W.expanding(c, "mean", 3) for c in ("vibration", "oil_pressure")})
    last = F.row_number().over(W.Window.partitionBy("turbine_id").orderBy(F.desc("timestamp"))) == 1
    marked = frame.withColumn("_last", last)
    moved = marked.withColumns({c: F.when(F.col("_last"), F.col(c) + 1000).otherwise(F.col(c)) for c in ("vibration", "oil_pressure")})
    names = ["vibration_m", "vibration_p", "oil_pressure_m", "oil_pressure_p"]
    before, after = made(marked).filter("not _last"), made(moved).filter("not _last")
    leaks = W.future_change(before, after, names).agg(F.count("*").cast("int").alias("leaking"))
    return before.agg(F.count("*").alias("rows")).join(F.broadcast(leaks))


_hot = {f"status_{s}": f"(operational_status = '{s}')::INT" for s in T.STATUSES}


@query("f1_raw", f"WITH {S.MACHINES} SELECT turbine_id, ordinal, {listed({c: c for c in T.SENSORS})}, {', '.join(f'{e} AS {n}' for n, e in _hot.items())} FROM m")
def f1(spark, d):
    made = X.raw(keyed(spark, d))
    return shown(keyed(spark, d).withColumns(made), made)


@query("f2_lags", f"WITH {S.MACHINES} SELECT turbine_id, ordinal, {listed({f'{c}_lag_{h}h': f'lag({c}, {h}) {S.LAG}' for c in X.DYNAMIC for h in X.LAGS})} FROM m")
def f2(spark, d):
    frame, spec = X.failure_features(keyed(spark, d), ("lag",))
    return shown(frame, spec["lag"])


_roll = {f"{c}_{s}_{h}h": S.rolling(c, h, s, max(int(h * 0.5), 1)) for c in X.DYNAMIC for h in X.WINDOWS for s in (("mean", "std", "min", "max", "median", "range") if c in X.DETAILED else ("mean", "std"))}


@query("f3_rollings", f"WITH {S.MACHINES} SELECT turbine_id, ordinal, {listed(_roll)} FROM m")
def f3(spark, d):
    frame, spec = X.failure_features(keyed(spark, d), ("rolling",))
    return shown(frame, spec["rolling"])


_trend: dict[str, str] = {}
for _c in X.DYNAMIC:
    for _h in X.DIFFS:
        _trend[f"{_c}_diff_{_h}h"] = f"{_c} - lag({_c}, {_h}) {S.LAG}"
        _trend[f"{_c}_rate_{_h}h"] = f"({_c} - lag({_c}, {_h}) {S.LAG}) / {_h}.0"
    _trend |= {f"{_c}_change_{_h}h": pct_sql(_c, _h) for _h in X.CHANGES}
    _trend |= {f"{_c}_slope_{_h}h": S.slope(_c, _h) for _h in X.SLOPES}
    _trend[f"{_c}_off_mean_24h"] = f"{_c} - ({S.rolling(_c, 24, 'mean')})"


@query("f4_trends", f"WITH {S.MACHINES}, {ROWS} SELECT turbine_id, ordinal, {listed(_trend)} FROM x")
def f4(spark, d):
    frame, spec = X.failure_features(keyed(spark, d), ("trend",))
    return shown(frame, spec["trend"])


POWER = "CASE WHEN wind_speed IS NULL THEN NULL WHEN wind_speed >= 3 AND wind_speed < 12.5 THEN 2000.0 * pow((wind_speed - 3) / 9.5, 3) WHEN wind_speed >= 12.5 AND wind_speed <= 25 THEN 2000.0 ELSE 0.0 END"
_load = S.clip("power_output / 2000.0", 0, 1.5)
_warm = ", ".join(X.WARM)
_there = " + ".join(f"({c} IS NOT NULL)::INT" for c in X.WARM)
_heat = f"({' + '.join(f'coalesce({c}, 0.0)' for c in X.WARM)}) / nullif({_there}, 0)"
INTERACTIONS = {f"{c}_above_ambient": f"{c} - ambient_temperature" for c in (*X.WARM, "brake_temperature")} | {
    "speed_ratio": S.clip(f"generator_speed / ({S.at_least('abs(rotor_speed)', 1e-06)})", 0, 400), "expected_power": "e", "power_ratio": f"CASE WHEN e > 1 THEN {S.clip('power_output / (' + S.at_least('e', 1.0) + ')', -2, 3)} END",
    "power_residual": "power_output - e", "power_per_wind3": S.clip(f"power_output / pow({S.at_least('wind_speed', 0.5)}, 3)", -50, 200), "load": _load, "vibration_per_load": f"vibration / (({_load}) + 0.1)",
    "vibration_per_rotor": f"vibration / ({S.at_least('rotor_speed', 0.5)})", "oil_pressure_per_temperature": f"oil_pressure / ({S.at_least('abs(oil_temperature)', 1.0)})", "oil_pressure_by_temperature": "oil_pressure * oil_temperature",
    "oil_pressure_per_load": f"oil_pressure / (({_load}) + 0.1)", "warmth": f"{_heat} - ambient_temperature", "warm_spread": f"greatest({_warm}) - least({_warm})", "hydraulic_per_load": f"hydraulic_pressure / (({_load}) + 0.1)",
}


@query("f5_interactions", f"WITH {S.MACHINES}, x AS (SELECT *, {POWER} AS e FROM m) SELECT turbine_id, ordinal, {listed(INTERACTIONS)} FROM x")
def f5(spark, d):
    frame, spec = X.failure_features(keyed(spark, d), ("interaction",))
    return shown(frame, spec["interaction"])


_rel = {f"{c}_off_median": f"{c} - {S.expanding(c, 'median', 48)}".replace("- CASE", "- (CASE").replace("END", "END)") for c in X.DYNAMIC}
_rel |= {f"{c}_off_past": f"{c} - ({S.expanding(c, 'mean', 48)})" for c in X.DYNAMIC}
_rel |= {f"{c}_off_normal": f"{c} - ({S.expanding('_n_' + c, 'median', 48)})" for c in X.DETAILED[:3]}
_norm = ", ".join(f"CASE WHEN operational_status = 'normal' THEN {c} END AS _n_{c}" for c in X.DETAILED[:3])


@query("f6_relative", f"WITH {S.MACHINES}, x AS (SELECT *, {_norm} FROM m), {robust_sql(X.DYNAMIC, 48, suffix='_robust_z')} SELECT a.* EXCLUDE (timestamp), z3.* EXCLUDE (turbine_id, ordinal, timestamp) FROM (SELECT turbine_id, timestamp, ordinal, {listed(_rel)} FROM x) a JOIN z3 ON a.turbine_id = z3.turbine_id AND a.timestamp = z3.timestamp")
def f6(spark, d):
    frame, spec = X.failure_features(keyed(spark, d), ("relative",))
    return shown(frame, spec["relative"])


@query("f7_time_parts", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month FROM events")
def f7(spark, d):
    parts = X.time_parts(("hour", "day_of_week", "month"))
    return T.read(spark, d, "events").withColumnRenamed("ts", "timestamp").select("event_id", *(parts[c].alias(c) for c in ("hour", "day_of_week", "month")))


_hours = "CAST(hour(timestamp) AS INTEGER)"
_whole = listed({c: c for c in T.SENSORS} | {f"{c}_lag_{h}h": f"lag({c}, {h}) {S.LAG}" for c in X.DYNAMIC for h in X.LAGS} | _roll | _trend | INTERACTIONS | _rel | {f"hour_{f}": f"{f}({_hours} * (2 * pi() / 24))" for f in ("sin", "cos")})


@query(
    "f8_failure_matrix",
    f"WITH {S.MACHINES}, x AS (SELECT *, CAST(row_number() OVER ({S.BY}) AS DOUBLE) AS _row, {POWER} AS e, {_norm} FROM m), {robust_sql(X.DYNAMIC, 48, suffix='_robust_z')}, "
    f"a AS (SELECT turbine_id, timestamp, ordinal, {_whole}, {', '.join(f'{e} AS {n}' for n, e in _hot.items())}, {_hours} AS hour FROM x) SELECT a.* EXCLUDE (timestamp), z3.* EXCLUDE (turbine_id, ordinal, timestamp) FROM a JOIN z3 ON a.turbine_id = z3.turbine_id AND a.timestamp = z3.timestamp",
)
def f8(spark, d):
    """All 395 columns of the failure models."""
    frame, spec = X.failure_features(keyed(spark, d))
    return shown(frame, [n for names in spec.values() for n in names])


_hroll = {f"{c}_{s}_{h}h": S.rolling(c, h, s) for c in X.CONDITION for h in X.HEALTH_WINDOWS for s in ("mean", "std", "max")}


@query("i2_health_rollings", f"WITH {S.MACHINES} SELECT turbine_id, ordinal, {listed(_hroll)} FROM m")
def i2(spark, d):
    made = X.health_rollings()
    return shown(X.with_bounded(keyed(spark, d), made, 0), made)


_htrend = {f"{c}_slope_{h}h": S.slope(c, h) for c in X.CONDITION for h in X.HEALTH_SLOPES}
_htrend |= {f"{c}_diff_24h": f"{c} - lag({c}, 24) {S.LAG}" for c in X.CONDITION} | {f"{c}_off_mean_168h": f"{c} - ({S.rolling(c, 168, 'mean')})" for c in X.CONDITION}


@query("i3_health_trends", f"WITH {S.MACHINES}, {ROWS} SELECT turbine_id, ordinal, {listed(_htrend)} FROM x")
def i3(spark, d):
    made = X.health_trends()
    return shown(X.with_bounded(keyed(spark, d), made, X.HEALTH_DIFF), made)


def shape_sql(sensors, n: int = 24) -> str:
    w, least = S.last(n), max(n // 2, 3)
    one = ", ".join(f"CASE WHEN count({c}) {w} >= {least} THEN avg(pow({c}, {k})) {w} END AS {c}_m{k}" for c in sensors for k in (1, 2, 3, 4))
    one += ", " + ", ".join(f"{c} - lag({c}, 1) {S.LAG} AS {c}_d, {S.rolling(c, n, 'range', least)} AS {c}_pp, max(abs({c})) {w} AS {c}_pk" for c in sensors)
    two = ", ".join(f"sign(round({c} - {c}_m1, 9)) AS {c}_side, stddev_samp({c}_d) {w} AS {c}_sdd, sqrt(greatest({c}_m2 - {c}_m1 * {c}_m1, CASE WHEN {c}_m1 IS NOT NULL THEN 0.0 END)) AS {c}_sd, sqrt({c}_m2) AS {c}_r" for c in sensors)
    three = ", ".join(f"coalesce(({c}_side <> lag({c}_side, 1) {S.LAG})::DOUBLE, 0.0) AS {c}_x" for c in sensors)
    wide = lambda num, den: f"CASE WHEN {den} > 1e-6 THEN ({num}) / {den} END"
    out = {}
    for c in sensors:
        m1, m2, m3, m4 = (f"{c}_m{k}" for k in (1, 2, 3, 4))
        out |= {
            f"{c}_rms": f"{c}_r", f"{c}_p2p": f"{c}_pp", f"{c}_crest": f"CASE WHEN {m1} IS NOT NULL THEN {wide(f'{c}_pk', f'{c}_r')} END", f"{c}_skew": wide(f"{m3} - 3 * {m1} * {m2} + 2 * pow({m1}, 3)", f"pow({c}_sd, 3)"),
            f"{c}_kurtosis": f"({wide(f'{m4} - 4 * {m1} * {m3} + 6 * {m1} * {m1} * {m2} - 3 * pow({m1}, 4)', f'pow({c}_sd, 4)')}) - 3", f"{c}_fast": wide(f"{c}_sdd", f"{c}_sd"), f"{c}_crossings": f"avg({c}_x) {w}",
        }
    return f"s1 AS (SELECT *, {one} FROM m), s2 AS (SELECT *, {two} FROM s1), s3 AS (SELECT *, {three} FROM s2) SELECT turbine_id, ordinal, {listed({n: f'({e}) * pi()' for n, e in out.items()})} FROM s3"


@query("i4_signal_shape", f"WITH {S.MACHINES}, {shape_sql(X.SHAPED)}")
def i4(spark, d):
    frame, names = X.with_shape(keyed(spark, d).select(*ID, "timestamp", *X.SHAPED))
    return shown(frame.withColumns({c: F.col(c) * F.pi() for c in names}), names)  # by pi: ratios of few values have decimal ties


REGIME = f"""CASE WHEN operational_status IN ('maintenance', 'fault') THEN 'offline' WHEN coalesce(wind_speed < 3, false) OR coalesce(wind_speed > 25, false) OR coalesce(power_output <= 25, false) THEN 'idle'
WHEN coalesce(e > 1 AND power_output / greatest(e, 1.0) < 0.55, false) THEN 'curtailed' WHEN coalesce(wind_speed < 7, false) THEN 'low_load' WHEN coalesce(wind_speed >= 11, false) THEN 'high_load' ELSE 'medium_load' END"""
WITH_REGIME = f"{S.MACHINES}, g0 AS (SELECT *, {POWER} AS e FROM m), g AS (SELECT *, {REGIME} AS regime FROM g0)"


_states = ", ".join(f"(regime = '{r}')::INT AS regime_{r}" for r in G.REGIMES)


@query("i1_condition", f"WITH {WITH_REGIME} SELECT turbine_id, ordinal, {listed({c: c for c in X.DYNAMIC})}, {_states} FROM g")
def i1(spark, d):
    made = {f"regime_{r}": c for r, c in zip(G.REGIMES, one_hot("regime", G.REGIMES))}
    return shown(with_regime(spark, d).withColumns(made), [*X.DYNAMIC, *made])


_three = X.WARM[:3]
_physical = {f"{c}_above_ambient": f"{c} - ambient_temperature" for c in X.WARM} | {n: INTERACTIONS[n] for n in ("power_residual", "power_ratio", "load", "vibration_per_load", "oil_pressure_per_load", "oil_pressure_per_temperature")}
_physical |= {
    "thermal_stress": f"({' + '.join(f'coalesce({c}, 0.0)' for c in _three)}) / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in _three)}, 0) - ambient_temperature",
    "thermal_spread": f"greatest({', '.join(_three)}) - least({', '.join(_three)})",
}


@query("i8_physical", f"WITH {S.MACHINES}, x AS (SELECT *, {POWER} AS e FROM m) SELECT turbine_id, ordinal, {listed(_physical)} FROM x")
def i8(spark, d):
    made = X.physical()
    return shown(keyed(spark, d).withColumns(made), made)


def with_regime(spark, d):
    return G.with_regime(keyed(spark, d))


_prod = ", ".join(f"CASE WHEN regime IN ('low_load', 'medium_load', 'high_load') THEN {c} END AS _p_{c}" for c in X.RELATIVE)
_offp = ", ".join(f"{S.r(f'{c} - ({e})')} AS {c}_off_producing" for c in X.RELATIVE for e in [S.expanding(f"_p_{c}", "median", 72)])


@query("i5_regime_relative", f"WITH {WITH_REGIME}, pr AS (SELECT *, {_prod} FROM g), {robust_sql([f'_p_{c}' for c in X.RELATIVE], 72, 'pr')} SELECT a.* EXCLUDE (timestamp), {', '.join(f'z3._p_{c}_z AS {c}_producing_z' for c in X.RELATIVE)} FROM (SELECT turbine_id, timestamp, ordinal, {_offp} FROM pr) a JOIN z3 ON a.turbine_id = z3.turbine_id AND a.timestamp = z3.timestamp")
def i5(spark, d):
    frame = with_regime(spark, d)
    out, names = X.with_regime_relative(frame, G.producing(frame))
    return shown(out, names)


_zpast = "OVER (PARTITION BY turbine_id, regime ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_rz = {f"{c}_regime_z": f"({c} - ({S.expanding('_o_' + c, 'mean', 24, _zpast)})) / nullif({S.at_least('(' + S.expanding('_o_' + c, 'std', 24, _zpast) + ')', 1e-06)}, 0)" for c in X.CONDITION}
_on = ", ".join(f"CASE WHEN regime <> 'offline' THEN {c} END AS _o_{c}" for c in X.CONDITION)


@query("l1_regime_z", f"WITH {WITH_REGIME}, o AS (SELECT *, {_on} FROM g) SELECT turbine_id, ordinal, {listed(_rz, 3)} FROM o")
def l1(spark, d):
    frame = W.with_masked_z(with_regime(spark, d), {c: c for c in X.CONDITION}, F.col("regime") != "offline", 24, "turbine_id", "regime", suffix="_regime_z")
    return shown(frame, [f"{c}_regime_z" for c in X.CONDITION], 3)


@query("l1_anomaly_features")
def l1b(spark, d):
    """The whole matrix of the detectors; its parts are held against SQL one by one."""
    return X.anomaly_features(with_regime(spark, d))[0]
