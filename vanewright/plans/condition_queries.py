"""Regimes, sensor rules, drift, health scores and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import clip, rounded
from ..operators import cleaning, drift, health, labels
from ..operators import features as X
from ..operators import regimes as G
from ..operators import rules as R
from ..sources import telemetry as T
from ..sources.shared import new_path, written
from . import sql as S
from .cleaning_queries import ID, SPLIT, keyed, machines
from .feature_queries import POWER, WITH_REGIME, shown, with_regime
from .registry import query


@query("g1_power_curve", f"WITH {S.MACHINES} SELECT turbine_id, ordinal, {S.r(POWER)} AS expected_power FROM m")
def g1(spark, d):
    return shown(keyed(spark, d).withColumn("expected_power", G.reference_power()), ["expected_power"])


@query("g2_regimes", f"WITH {WITH_REGIME} SELECT turbine_id, ordinal, regime FROM g")
def g2(spark, d):
    return with_regime(spark, d).select(*ID, "regime")


@query("g3_kmeans_regimes")
def g3(spark, d):
    return G.with_regime(keyed(spark, d), "kmeans").groupBy("regime").agg(F.count("*").alias("n"), F.round(F.avg("power_output"), 3).alias("mean_power"))


_names = S.values([(r, i) for i, r in enumerate(G.REGIMES)], "regime, rank")


@query("g5_regime_summary", f"WITH {WITH_REGIME} SELECT t.regime, t.rank, count(g.regime) AS n, {S.r('count(g.regime) / (SELECT count(*) FROM g)::DOUBLE', 6)} AS share FROM {_names} LEFT JOIN g ON g.regime = t.regime GROUP BY 1, 2")
def g5(spark, d):
    return G.regime_summary(with_regime(spark, d)).withColumn("share", rounded("share", 6))


@query("g6_producing", f"WITH {WITH_REGIME} SELECT turbine_id, count(*) FILTER (regime IN ('low_load', 'medium_load', 'high_load')) AS producing FROM g GROUP BY 1")
def g6(spark, d):
    frame = with_regime(spark, d)
    return frame.groupBy("turbine_id").agg(F.count_if(G.producing(frame)).alias("producing"))


_rules = S.values(R.RULES, "sensor, component, unit, hard_min, hard_max, direction, warn, alarm, max_rate, stuck_tolerance, source").replace(") t(", ") ru(")
_sensors = ", ".join(R.SENSORS)
SIGN = "CASE WHEN direction = 'high_is_bad' THEN 1.0 ELSE -1.0 END"
_w6 = "OVER (PARTITION BY turbine_id, sensor ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
FLAGS = f"""{S.MACHINES}, long AS (UNPIVOT (SELECT turbine_id, timestamp, ordinal, {_sensors} FROM m) ON {_sensors} INTO NAME sensor VALUE value),
grid AS (SELECT m.turbine_id, m.timestamp, m.ordinal, ru.* FROM m, {_rules}),
lr AS (SELECT grid.*, long.value, ({SIGN}) * (value - warn) / abs(alarm - warn) AS past FROM grid LEFT JOIN long USING (turbine_id, timestamp, ordinal, sensor)),
l2 AS (SELECT *, CASE WHEN past > 0 THEN past WHEN value IS NOT NULL THEN 0.0 END AS exceedance FROM lr),
fl AS (SELECT *, coalesce(value < hard_min OR value > hard_max, false) AS out_of_range, coalesce(exceedance > 0, false) AS warning, coalesce(exceedance >= 1, false) AS alarm_flag,
CASE WHEN coalesce(({SIGN}) * (value - alarm) >= 0, false) THEN 'alarm' WHEN coalesce(({SIGN}) * (value - warn) > 0, false) THEN 'warning' ELSE 'none' END AS severity,
count(value) {_w6} = 6 AND coalesce(max(value) {_w6} - min(value) {_w6} <= stuck_tolerance, false) AS stuck, coalesce(abs(value - lag(value) OVER (PARTITION BY turbine_id, sensor ORDER BY timestamp)) > max_rate, false) AS rate FROM l2)"""


def flags(spark, d):
    """Flags of all rows. The rule table's `alarm` limit and the flag share a name in what the operator returns, the
    flag being the later one, so limits are used before."""
    return R.flagged(keyed(spark, d), R.rule_table(spark))


@query("h3_severity", f"WITH {FLAGS} SELECT turbine_id, ordinal, sensor, {S.r('exceedance')} AS exceedance, severity FROM fl")
def h3(spark, d):
    return flags(spark, d).select(*ID, "sensor", rounded("exceedance").alias("exceedance"), "severity")


@query("h7_flag_counts", f"WITH {FLAGS}, c AS (SELECT sensor, count(*) FILTER (out_of_range) AS out_of_range, count(*) FILTER (warning) AS warning, count(*) FILTER (alarm_flag) AS alarm, count(*) FILTER (stuck) AS stuck, count(*) FILTER (rate) AS rate FROM fl GROUP BY 1) UNPIVOT c ON out_of_range, warning, alarm, stuck, rate INTO NAME \"check\" VALUE n")
def h7(spark, d):
    return R.flag_counts(flags(spark, d))


@query("h7_data_quality", f"WITH {FLAGS}, q AS (SELECT turbine_id, timestamp, bool_or(out_of_range OR stuck OR rate) AS bad FROM fl GROUP BY 1, 2) SELECT {S.r('1 - avg(bad::INT)', 6)} AS data_quality FROM q")
def h7b(spark, d):
    return R.data_quality(flags(spark, d)).select(rounded("data_quality", 6).alias("data_quality"))


_viol = " UNION ALL ".join(
    [f"SELECT turbine_id, sensor, sev AS kind, {S.r('(CASE WHEN sev = ' + chr(39) + 'alarm' + chr(39) + ' THEN al ELSE wa END) / n::DOUBLE', 6)} AS share FROM by WHERE sev <> 'none'"]
    + [f"SELECT turbine_id, sensor, '{c}', {S.r(f'n_{c} / n::DOUBLE', 6)} FROM by WHERE n_{c} > 0" for c in ("out_of_range", "stuck", "rate")]
).replace("FROM by", "FROM byk")


@query("h9_window_violations", f"WITH {FLAGS}, byk AS (SELECT turbine_id, sensor, max_by(severity, timestamp) AS sev, count(*) AS n, count(*) FILTER (warning) AS wa, count(*) FILTER (alarm_flag) AS al, count(*) FILTER (out_of_range) AS n_out_of_range, count(*) FILTER (stuck) AS n_stuck, count(*) FILTER (rate) AS n_rate FROM fl GROUP BY 1, 2) {_viol}")
def h9(spark, d):
    return R.window_violations(flags(spark, d)).withColumn("share", rounded("share", 6))


_w24 = "OVER (PARTITION BY turbine_id, sensor ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


@query("i6_rule_features", f"WITH {FLAGS} SELECT turbine_id, ordinal, sensor, {S.r('exceedance')} AS exceedance, {S.r(f'CASE WHEN count(exceedance) {_w24} >= 12 THEN avg(exceedance) {_w24} END')} AS mean_exceedance, {S.r(f'CASE WHEN count(exceedance) {_w24} >= 12 THEN max(exceedance) {_w24} END')} AS max_exceedance FROM fl")
def i6(spark, d):
    return R.rule_features(flags(spark, d)).select(*ID, "sensor", *(rounded(c).alias(c) for c in ("exceedance", "mean_exceedance", "max_exceedance")))


LEAST, SPAN = drift.LEAST_PAST, drift.WINDOW
_masked = {c: f"CASE WHEN regime IN ('low_load', 'medium_load', 'high_load') THEN {c} END" for c in drift.SENSORS}
_zs = ", ".join(f"({c} - ({S.expanding('_k_' + c, 'mean', LEAST)})) / nullif({S.at_least('(' + S.expanding('_k_' + c, 'std', LEAST) + ')', 1e-06)}, 0) AS {c}" for c in drift.SENSORS)
_d = ", ".join(drift.SENSORS)
_zz = f"""{WITH_REGIME}, k AS (SELECT *, {', '.join(f'{e} AS _k_{c}' for c, e in _masked.items())} FROM g), zw AS (SELECT turbine_id, timestamp, ordinal, {_zs} FROM k),
zg AS (SELECT turbine_id, timestamp, ordinal, s.sensor FROM m, {S.values([(c,) for c in drift.SENSORS], 'sensor').replace(') t(', ') s(')}), zu AS (UNPIVOT zw ON {_d} INTO NAME sensor VALUE z),
zl AS (SELECT zg.*, zu.z FROM zg LEFT JOIN zu USING (turbine_id, timestamp, ordinal, sensor))"""
# a recursion over each series in order, all series at once
CHARTS = f"""RECURSIVE {_zz}, n AS (SELECT *, row_number() OVER (PARTITION BY turbine_id, sensor ORDER BY timestamp, ordinal) AS i FROM zl),
ch AS (SELECT turbine_id, sensor, timestamp, ordinal, i, z, greatest(0.0, coalesce(z - 0.5, 0.0)) AS up, greatest(0.0, coalesce(-z - 0.5, 0.0)) AS down, z AS ewma FROM n WHERE i = 1
UNION ALL SELECT n.turbine_id, n.sensor, n.timestamp, n.ordinal, n.i, n.z, CASE WHEN n.z IS NULL THEN pu ELSE greatest(0.0, pu + n.z - 0.5) END, CASE WHEN n.z IS NULL THEN pd ELSE greatest(0.0, pd - n.z - 0.5) END,
CASE WHEN n.z IS NULL THEN p.ewma WHEN p.ewma IS NULL THEN n.z ELSE 0.1 * n.z + 0.9 * p.ewma END
FROM (SELECT *, CASE WHEN up >= 5 THEN 0.0 ELSE up END AS pu, CASE WHEN down >= 5 THEN 0.0 ELSE down END AS pd FROM ch) p JOIN n ON n.turbine_id = p.turbine_id AND n.sensor = p.sensor AND n.i = p.i + 1)"""
_sw = f"OVER (PARTITION BY turbine_id, sensor ORDER BY timestamp ROWS BETWEEN {SPAN - 1} PRECEDING AND CURRENT ROW)"
STATS = f"{CHARTS}, st AS (SELECT *, sum((up >= 5 OR down >= 5)::INT) {_sw} AS signals FROM ch)"


def statistics(spark, d):
    frame = with_regime(spark, d)
    return drift.drift_statistics(frame, G.producing(frame), least=LEAST, rows=SPAN)


@query("j1_regime_conditioned_z", f"WITH {_zz} SELECT turbine_id, ordinal, sensor, {S.r('z', 3)} AS z FROM zl")
def j1(spark, d):
    frame = with_regime(spark, d)
    return drift.residuals(frame, G.producing(frame), least=LEAST).select(*ID, "sensor", rounded("z", 3).alias("z"))


@query("j2_cusum_restart", f"WITH {STATS} SELECT turbine_id, ordinal, sensor, {S.r('up', 3)} AS cusum_up, {S.r('down', 3)} AS cusum_down, {S.r('ewma', 3)} AS ewma, CAST(signals AS DOUBLE) AS signals FROM st")
def j2(spark, d):
    return statistics(spark, d).select(*ID, "sensor", *(rounded(c, 3).alias(c) for c in ("cusum_up", "cusum_down", "ewma")), "signals")


_wide = ", ".join(f"{S.r(f'max({v}) FILTER (sensor = {chr(39)}{s}{chr(39)})', 3)} AS {s}_{n}" for s in drift.SENSORS for n, v in (("z", "z"), ("cusum_up", "up"), ("cusum_down", "down"), ("signals", "signals::DOUBLE"), ("ewma", "ewma")))


@query("i7_drift_block", f"WITH {STATS} SELECT turbine_id, ordinal, {_wide} FROM st GROUP BY turbine_id, timestamp, ordinal")
def i7(spark, d):
    frame = with_regime(spark, d)
    wide = drift.drift_block(frame, G.producing(frame), least=LEAST, rows=SPAN)
    return shown(wide, [c for c in wide.columns if c not in ("turbine_id", "timestamp", "ordinal")], 3)


@query("i9_health_matrix")
def i9(spark, d):
    """All 239 columns of the health models; tests hold its blocks against the queries of each."""
    return X.health_features(with_regime(spark, d))[0]


_sums = "OVER (PARTITION BY turbine_id, sensor ORDER BY timestamp ROWS UNBOUNDED PRECEDING)"


@query("j2_cusum_plain", f"WITH {_zz}, p AS (SELECT *, sum(coalesce(z - 0.5, 0.0)) {_sums} AS u, sum(coalesce(-z - 0.5, 0.0)) {_sums} AS v FROM zl) SELECT turbine_id, ordinal, sensor, {S.r(f'u - least(0.0, min(u) {_sums})', 2)} AS cusum_up, {S.r(f'v - least(0.0, min(v) {_sums})', 2)} AS cusum_down FROM p")
def j2b(spark, d):
    frame = with_regime(spark, d)
    return drift.plain_statistics(frame, G.producing(frame), least=LEAST).select(*ID, "sensor", rounded("cusum_up", 2).alias("cusum_up"), rounded("cusum_down", 2).alias("cusum_down"))


_lim = drift.ewma_limit()
# healthy rows of the training part: what calibration learns from
_healthy = f"""{SPLIT}, he AS (SELECT turbine_id, timestamp FROM s WHERE split = 'train' AND 100.0 * (1.0 - coalesce(degradation_level, 0.0)) >= {drift.HEALTHY_SCORE})"""
_cal = f"""{_healthy}, hs AS (SELECT st.* FROM st SEMI JOIN he USING (turbine_id, timestamp)),
c0 AS (SELECT sensor, quantile_cont(signals::DOUBLE, 0.95) AS s95, quantile_cont(signals::DOUBLE, 0.99) AS s99, quantile_cont(abs(ewma), 0.95) AS e95, quantile_cont(abs(ewma), 0.99) AS e99 FROM hs GROUP BY 1),
cal AS (SELECT sensor, round_even(greatest(s95, 1.0), 3) AS signals_warning, round_even(greatest(s99, greatest(s95, 1.0) + 1), 3) AS signals_alarm, round_even(greatest(e95, {_lim}), 4) AS ewma_warning, round_even(greatest(e99, 1.05 * greatest(e95, {_lim})), 4) AS ewma_alarm FROM c0)"""


def marked(spark, d):
    """Rows with regimes and `_healthy`, which is true of healthy rows of the training part, and whether machines pass
    whole. Rows without a key never count, so times and sizes are those of the table as it comes."""
    came = machines(spark, d).filter("turbine_id is not null and timestamp is not null")
    bounds = written(labels.split_bounds(came), "split-bounds")
    rows = labels.assign_splits(labels.health_target(with_regime(spark, d)), bounds)
    healthy = (F.col("split") == "train") & (F.col("health_score") >= drift.HEALTHY_SCORE)
    return rows.withColumn("_healthy", F.coalesce(healthy, F.lit(False))), cleaning.passes_whole(came)


def marked_statistics(spark, d):
    frame, whole = marked(spark, d)
    return drift.drift_statistics(frame, G.producing(frame), least=LEAST, rows=SPAN, carry=("_healthy",), whole=whole)


@query("j7_calibration", f"WITH {STATS}, {_cal} SELECT * FROM cal")
def j7(spark, d):
    """Limits of every sensor from healthy rows of the training part, of which the operator wants 500."""
    return drift.calibrate(marked_statistics(spark, d), "_healthy", drift.LEAST_HEALTHY)


_graded = f"""{STATS}, gr AS (SELECT *, CASE WHEN signals < 1 THEN 'none' WHEN signals >= {drift.ALARM_SIGNALS} THEN 'alarm' ELSE 'warning' END AS cs,
CASE WHEN coalesce(abs(ewma) >= {_lim * drift.ALARM_RATIO}, false) THEN 'alarm' WHEN coalesce(abs(ewma) >= {_lim}, false) THEN 'warning' ELSE 'none' END AS es FROM st)"""


@query("j9_severity", f"WITH {_graded} SELECT cs AS cusum_severity, es AS ewma_severity, count(*) AS n FROM gr GROUP BY 1, 2")
def j9(spark, d):
    return drift.graded(statistics(spark, d)).groupBy("cusum_severity", "ewma_severity").agg(F.count("*").alias("n"))


_rep = f"""{_graded}, br AS (SELECT turbine_id, sensor, max_by(cs, timestamp) AS c, max_by(es, timestamp) AS e, max_by(ewma, timestamp) AS w, max(up) AS u, max(down) AS v, min(timestamp) FILTER (up >= 5) AS ut, min(timestamp) FILTER (down >= 5) AS vt, min(timestamp) FILTER (abs(ewma) >= {_lim}) AS et FROM gr GROUP BY 1, 2),
rep AS (SELECT turbine_id, sensor, 'cusum' AS method, c AS severity, CASE WHEN u >= v THEN 'upward' ELSE 'downward' END AS direction, greatest(u, v) AS statistic, CASE WHEN u >= v THEN ut ELSE vt END AS first_detected FROM br WHERE c <> 'none'
UNION ALL SELECT turbine_id, sensor, 'ewma', e, CASE WHEN w >= 0 THEN 'upward' ELSE 'downward' END, abs(w), et FROM br WHERE e <> 'none')"""


@query("j10_drift_report", f"WITH {_rep} SELECT turbine_id, sensor, method, severity, direction, {S.r('statistic', 3)} AS statistic, epoch_us(first_detected) AS first_detected FROM rep")
def j10(spark, d):
    return drift.drift_report(statistics(spark, d)).select("turbine_id", "sensor", "method", "severity", "direction", rounded("statistic", 3).alias("statistic"), T.micros("first_detected").alias("first_detected"))


_pts = "CASE max(CASE severity WHEN 'alarm' THEN 2 ELSE 1 END) WHEN 2 THEN 5.0 ELSE 2.5 END"
_pen = f"{_rep}, pp AS (SELECT turbine_id, sensor, {_pts} AS p FROM rep GROUP BY 1, 2)"


@query("j11_drift_penalty", f"WITH {_pen} SELECT turbine_id, CAST(least(sum(p), 15.0) AS DOUBLE) AS penalty FROM pp GROUP BY 1")
def j11(spark, d):
    return drift.drift_penalty(drift.drift_report(statistics(spark, d)))


# novelty in SQL's reach, in place of the forest's: the largest residual of a row that has all, as a probability
_novel = f"""nv AS (SELECT turbine_id, timestamp, 1 / (1 + exp(3.0 - max(abs(z)))) AS novelty FROM st GROUP BY 1, 2 HAVING count(z) = {len(drift.SENSORS)}),
hn AS (SELECT nv.* FROM nv SEMI JOIN he USING (turbine_id, timestamp)), nl AS (SELECT round_even(quantile_cont(novelty, 0.95), 6) AS nw, round_even(greatest(quantile_cont(novelty, 0.95), quantile_cont(novelty, 0.99)), 6) AS na FROM hn)"""
_calrep = f"""{STATS}, {_cal}, {_novel}, gc AS (SELECT st.*, ewma_warning, CASE WHEN signals < 1 THEN 'none' WHEN signals >= signals_alarm THEN 'alarm' WHEN signals >= signals_warning THEN 'warning' ELSE 'none' END AS cs,
CASE WHEN coalesce(abs(ewma) >= ewma_alarm, false) THEN 'alarm' WHEN coalesce(abs(ewma) >= ewma_warning, false) THEN 'warning' ELSE 'none' END AS es FROM st JOIN cal USING (sensor)),
bc AS (SELECT turbine_id, sensor, max_by(cs, timestamp) AS c, max_by(es, timestamp) AS e, max_by(ewma, timestamp) AS w, max(up) AS u, max(down) AS v, min(timestamp) FILTER (up >= 5) AS ut, min(timestamp) FILTER (down >= 5) AS vt, min(timestamp) FILTER (abs(ewma) >= ewma_warning) AS et FROM gc GROUP BY 1, 2),
la AS (SELECT turbine_id, max(timestamp) AS timestamp FROM st GROUP BY 1),
rc AS (SELECT turbine_id, sensor, 'cusum' AS method, c AS severity, CASE WHEN u >= v THEN 'upward' ELSE 'downward' END AS direction, greatest(u, v) AS statistic, CASE WHEN u >= v THEN ut ELSE vt END AS first_detected FROM bc WHERE c <> 'none'
UNION ALL SELECT turbine_id, sensor, 'ewma', e, CASE WHEN w >= 0 THEN 'upward' ELSE 'downward' END, abs(w), et FROM bc WHERE e <> 'none'
UNION ALL SELECT turbine_id, 'multivariate', 'isolation_forest', CASE WHEN novelty >= na THEN 'alarm' ELSE 'warning' END, 'none', round_even(novelty, 4), NULL FROM nv JOIN la USING (turbine_id, timestamp), nl WHERE novelty >= nw)"""


def report_of_kept_limits(spark, d):
    """The report by limits, novelty's among them, that were fitted on healthy training rows, kept, and loaded again."""
    frame, whole = marked(spark, d)
    stats, rows = drift.statistics_and_residuals(frame, G.producing(frame), least=LEAST, rows=SPAN, carry=("_healthy",), whole=whole)
    most = F.array_max(F.transform("x", F.abs))
    novel = rows.select("turbine_id", "timestamp", "_healthy", (1 / (1 + F.exp(3.0 - most))).alias("novelty"))
    fitted = drift.calibration_table(drift.calibrate(stats, "_healthy"), drift.calibrate_novelty(novel, "_healthy"))
    kept = drift.save_calibration(fitted, new_path(spark, "calibration"), 1)
    return drift.drift_report(stats, drift.load_calibration(spark, kept), novel=novel)


@query("j15_report_of_kept_limits", f"WITH {_calrep} SELECT turbine_id, sensor, method, severity, direction, {S.r('statistic', 3)} AS statistic, epoch_us(first_detected) AS first_detected FROM rc")
def j15(spark, d):
    return report_of_kept_limits(spark, d).select("turbine_id", "sensor", "method", "severity", "direction", rounded("statistic", 3).alias("statistic"), T.micros("first_detected").alias("first_detected"))


_cpts = "CASE WHEN sensor = 'multivariate' THEN 5.0 ELSE CASE max(CASE severity WHEN 'alarm' THEN 2 ELSE 1 END) WHEN 2 THEN 5.0 ELSE 2.5 END END"


@query("j15_penalty_of_kept_limits", f"WITH {_calrep}, pc AS (SELECT turbine_id, sensor, {_cpts} AS p FROM rc GROUP BY 1, 2) SELECT turbine_id, CAST(least(sum(p), 15.0) AS DOUBLE) AS penalty FROM pc GROUP BY 1")
def j15_penalty(spark, d):
    return drift.drift_penalty(report_of_kept_limits(spark, d))


_worst = "CASE greatest(CASE cs WHEN 'alarm' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END, CASE es WHEN 'alarm' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 5.0 WHEN 1 THEN 2.5 ELSE 0.0 END"


@query("j12_row_penalties", f"WITH {_graded} SELECT turbine_id, ordinal, CAST(least(sum({_worst}), 15.0) AS DOUBLE) AS penalty FROM gr GROUP BY turbine_id, ordinal, timestamp")
def j12(spark, d):
    return drift.row_penalties(statistics(spark, d)).select(*ID, "penalty")


# the health view: what a regressor would say of each row, and a deduction; scores by expressions over the telemetry
RAW = "(100.0 - 6.0 * vibration - oil_temperature / 10 + oil_pressure)"
CLASS = "CASE WHEN coalesce({x} >= 80, false) THEN 'healthy' WHEN coalesce({x} >= 60, false) THEN 'monitor' WHEN coalesce({x} >= 40, false) THEN 'degraded' ELSE 'critical' END"
_raw = f"({S.clip(RAW, 0, 100)})"
_score = f"({S.clip('raw - CASE WHEN penalty > 0 THEN penalty ELSE 0.0 END', 0, 100)})"
SCORED = f"{WITH_REGIME}, h0 AS (SELECT *, {_raw} AS raw, coalesce(degradation_level, 0.0) * 15 AS penalty, 100.0 * (1.0 - coalesce(degradation_level, 0.0)) AS truth FROM g), h1 AS (SELECT *, {_score} AS score FROM h0), h AS (SELECT *, {CLASS.format(x='score')} AS health_class FROM h1)"


def scored(spark, d):
    frame = with_regime(spark, d)
    level = F.coalesce("degradation_level", F.lit(0.0))
    raw = clip(100.0 - 6.0 * F.col("vibration") - F.col("oil_temperature") / 10 + F.col("oil_pressure"), 0, 100)
    frame = frame.withColumns({"raw": raw, "penalty": level * 15, "truth": 100.0 * (1.0 - level)})
    return frame.withColumn("score", health.published("raw", "penalty")).withColumn("health_class", health.health_class("score"))


@query("k3_class_distribution", f"WITH {SCORED} SELECT t.health_class, t.rank, count(h.health_class) AS n FROM {S.values([(c, i) for i, c in enumerate(health.CLASSES)], 'health_class, rank')} LEFT JOIN h ON h.health_class = t.health_class GROUP BY 1, 2")
def k3(spark, d):
    return health.class_distribution(scored(spark, d))


@query("k2_adaptive_bands", f"WITH {SCORED}, s AS (SELECT {S.clip('quantile_cont(score, 0.5) - 70', -10, 10)} AS shift FROM h) SELECT {S.r('shift')} AS shift, {', '.join(f'{S.r(S.clip(f'{v} + shift', 1, 99))} AS {n}' for n, v in health.BANDS.items())} FROM s")
def k2(spark, d):
    bands = health.adaptive_bands(scored(spark, d))
    return bands.select(*(rounded(c).alias(c) for c in bands.columns))


@query("k9_scored_rows", f"WITH {SCORED} SELECT turbine_id, ordinal, regime, {S.r('raw')} AS raw, {S.r('score')} AS score, health_class FROM h")
def k9(spark, d):
    return scored(spark, d).select(*ID, "regime", rounded("raw").alias("raw"), rounded("score").alias("score"), "health_class")


LATEST = "lt AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp DESC, ordinal DESC) = 1)"


def latest(spark, d):
    return health.latest_per_machine(scored(spark, d))


@query("k10_latest_per_machine", f"WITH {SCORED}, {LATEST} SELECT turbine_id, ordinal, {S.r('score')} AS score, health_class FROM lt")
def k10(spark, d):
    return latest(spark, d).select(*ID, rounded("score").alias("score"), "health_class")


@query("k8_as_of", f"WITH {SCORED}, lt AS (SELECT * FROM h WHERE timestamp <= TIMESTAMP '1998-06-30' QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp DESC, ordinal DESC) = 1) SELECT turbine_id, ordinal, {S.r('score')} AS score FROM lt")
def k8(spark, d):
    rows = scored(spark, d).filter(F.col("timestamp") <= F.lit("1998-06-30").cast("timestamp_ntz"))
    return health.latest_per_machine(rows).select(*ID, rounded("score").alias("score"))


@query("k11_fleet_summary", f"WITH {SCORED}, {LATEST} SELECT count(*) AS machines, {S.r('avg(score)')} AS mean_score, {S.r('min(score)')} AS least_score, count(*) FILTER (raw - score > 1e-6) AS drift_alerts, (SELECT string_agg(health_class || '=' || n, ',' ORDER BY health_class) FROM (SELECT health_class, count(*) AS n FROM lt GROUP BY 1)) AS health_class_counts, (SELECT string_agg(regime || '=' || n, ',' ORDER BY regime) FROM (SELECT regime, count(*) AS n FROM lt GROUP BY 1)) AS regime_counts, (SELECT string_agg(turbine_id, ',' ORDER BY score NULLS FIRST, turbine_id) FROM (SELECT turbine_id, score FROM lt ORDER BY score NULLS FIRST, turbine_id LIMIT 5)) AS worst FROM lt")
def k11(spark, d):
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    s = health.fleet_summary(latest(spark, d))
    return s.select("machines", rounded("mean_score").alias("mean_score"), rounded("least_score").alias("least_score"), "drift_alerts", text("health_class_counts").alias("health_class_counts"), text("regime_counts").alias("regime_counts"), F.array_join("worst", ",").alias("worst"))


_judged = f"{SCORED}, j AS (SELECT truth AS y, score AS p FROM h WHERE score IS NOT NULL)"


def judged(spark, d):
    return scored(spark, d).filter("score is not null").select("truth", F.col("score").alias("predicted"))


@query("k12_regression_metrics", f"""WITH {_judged}, r AS (SELECT y, p, p - y AS e, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM j)
SELECT count(*) AS n, {S.r('avg(abs(e))')} AS mae, {S.r('sqrt(avg(e * e))')} AS rmse, {S.r('quantile_cont(abs(e), 0.5)')} AS median_ae, {S.r('1 - sum(e * e) / (var_pop(y) * count(*))')} AS r2, {S.r('corr(ry, rp)')} AS spearman, {S.r('avg(e)')} AS bias,
{S.r('avg(abs(e)) FILTER (y < 80)')} AS mae_degraded, {S.r('avg((abs(e) <= 5)::INT)', 6)} AS within_5, {S.r('avg((abs(e) <= 10)::INT)', 6)} AS within_10 FROM r""")
def k12(spark, d):
    m = health.regression_metrics(judged(spark, d))
    return m.select("n", *(rounded(c, 6 if c.startswith("within") else 4).alias(c) for c in m.columns if c != "n"))


_rank = "(CASE {c} WHEN 'healthy' THEN 0 WHEN 'monitor' THEN 1 WHEN 'degraded' THEN 2 ELSE 3 END)"
_classes = f"{_judged}, cc AS (SELECT {CLASS.format(x='y')} AS t, {CLASS.format(x='p')} AS q, abs(p - y) AS e FROM j)"


@query("k13_class_metrics", f"WITH {_classes} SELECT {S.r('avg((t = q)::INT)', 6)} AS agreement, {S.r(f'avg((abs({_rank.format(c="t")} - {_rank.format(c="q")}) <= 1)::INT)', 6)} AS within_one, {S.r(f'avg(({_rank.format(c="q")} < {_rank.format(c="t")})::INT)', 6)} AS optimistic FROM cc")
def k13(spark, d):
    m = health.class_metrics(judged(spark, d))
    return m.select(*(rounded(c, 6).alias(c) for c in m.columns))


@query("k14_band_errors", f"WITH {_classes} SELECT v.health_class, v.rank, count(t) AS n, {S.r('avg(e)')} AS mae, {S.r('avg((t = q)::INT)', 6)} AS agreement FROM {S.values([(c, i) for i, c in enumerate(health.CLASSES)], 'health_class, rank').replace(') t(', ') v(')} LEFT JOIN cc ON cc.t = v.health_class GROUP BY 1, 2")
def k14(spark, d):
    return health.band_errors(judged(spark, d)).withColumns({"mae": rounded("mae"), "agreement": rounded("agreement", 6)})


@query("k15_class_confusion", f"WITH {_classes} SELECT t AS true_class, {', '.join(f'''count(*) FILTER (q = '{c}') AS {c}''' for c in health.CLASSES)} FROM cc GROUP BY 1")
def k15(spark, d):
    return health.confusion(judged(spark, d))


EVIDENCE = f"""{FLAGS}, last AS (SELECT *, ({SIGN}) * ((value - mu) / nullif(sd, 0)) AS bd FROM (SELECT *, avg(value) OVER (PARTITION BY turbine_id, sensor) AS mu, stddev_samp(value) OVER (PARTITION BY turbine_id, sensor) AS sd FROM fl) QUALIFY row_number() OVER (PARTITION BY turbine_id, sensor ORDER BY timestamp DESC) = 1),
ev AS (SELECT *, coalesce(exceedance, 0.0) AS exceed, CASE WHEN coalesce(bd > 0, false) THEN bd ELSE 0.0 END AS dev FROM last), ei AS (SELECT *, greatest(exceed, dev / 4) AS impact FROM ev)"""


def evidence_rows(spark, d):
    """The last reading of every sensor with its rule and its z score over the machine's record."""
    long = R.to_long(keyed(spark, d))
    by = long.groupBy("turbine_id", "sensor").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"), F.max_by(F.struct("value"), "timestamp").alias("last"))
    z = F.try_divide(F.col("last.value") - F.col("mu"), F.col("sd"))
    return by.select("turbine_id", "sensor", F.col("last.value").alias("value"), z.alias("z")).join(F.broadcast(R.rule_table(spark)), "sensor")


@query("k4_component_health", f"""WITH {EVIDENCE}, dr AS (SELECT turbine_id, component, -exceed AS o, sensor || ':limit' AS w FROM ei WHERE exceed > 0 UNION ALL SELECT turbine_id, component, -dev / 4, sensor || ':baseline' FROM ei WHERE dev / 4 > 0.25),
top AS (SELECT turbine_id, component, string_agg(w, ',' ORDER BY o, w) AS drivers FROM (SELECT * FROM dr QUALIFY row_number() OVER (PARTITION BY turbine_id, component ORDER BY o, w) <= 3) GROUP BY 1, 2),
sc AS (SELECT turbine_id, component, round_even(100 * (1 - least(max(impact), 1.0)), 2) AS score FROM ei GROUP BY 1, 2) SELECT turbine_id, component, score, {CLASS.format(x='score')} AS health_class, coalesce(drivers, '') AS drivers FROM sc LEFT JOIN top USING (turbine_id, component)""")
def k4(spark, d):
    return health.component_health(evidence_rows(spark, d)).withColumn("drivers", F.array_join("drivers", ","))


@query("k5_worst_component", f"WITH {EVIDENCE}, sc AS (SELECT turbine_id, component, round_even(100 * (1 - least(max(impact), 1.0)), 2) AS score FROM ei GROUP BY 1, 2) SELECT turbine_id, component, score FROM sc QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY score, component) = 1")
def k5(spark, d):
    return health.worst_component(health.component_health(evidence_rows(spark, d)))


@query("k6_top_factors", f"WITH {EVIDENCE} SELECT turbine_id, CAST(row_number() OVER (PARTITION BY turbine_id ORDER BY round(impact, 9) DESC, sensor) AS INTEGER) AS rank, sensor, CASE WHEN exceed >= dev / 4 THEN 'limit' ELSE 'baseline' END AS kind, {S.r('impact')} AS impact FROM ei WHERE impact > 0.05 QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY round(impact, 9) DESC, sensor) <= 5")
def k6(spark, d):
    return health.top_factors(evidence_rows(spark, d)).withColumn("impact", rounded("impact"))


@query("k7_assessment", f"WITH {SCORED}, {LATEST}, ass AS (SELECT turbine_id, raw, score, health_class, regime, penalty FROM lt) SELECT turbine_id, {S.r('raw')} AS raw, {S.r('penalty')} AS penalty, {S.r('score')} AS score, health_class, regime, abs(score - greatest(raw - penalty, 0.0)) < 1e-9 AS consistent FROM ass")
def k7(spark, d):
    rows = latest(spark, d)
    same = F.abs(F.col("score") - F.when(F.col("raw") - F.col("penalty") > 0, F.col("raw") - F.col("penalty")).when(F.col("raw").isNotNull(), 0.0)) < 1e-9
    return rows.select("turbine_id", rounded("raw").alias("raw"), rounded("penalty").alias("penalty"), rounded("score").alias("score"), "health_class", "regime", same.alias("consistent"))


@query("q21_history_with_limits", f"WITH {S.MACHINES}, long AS (UNPIVOT (SELECT turbine_id, timestamp, ordinal, {_sensors} FROM m) ON {_sensors} INTO NAME sensor VALUE value) SELECT sensor, direction, warn, alarm, count(value) AS n, {S.r('avg(value)')} AS mean FROM long JOIN {_rules} USING (sensor) GROUP BY ALL")
def q21(spark, d):
    rows = R.with_limits(keyed(spark, d), R.rule_table(spark))
    return rows.groupBy("sensor", "direction", "warn", "alarm").agg(F.count("value").alias("n"), rounded(F.avg("value")).alias("mean"))


_limits = ", ".join(f"{c}::DOUBLE AS {c}" for c in ("hard_min", "hard_max", "warn", "alarm", "max_rate", "stuck_tolerance"))


@query("h8_rule_records", f"WITH {S.MACHINES}, long AS (UNPIVOT (SELECT {_sensors} FROM m) ON {_sensors} INTO NAME sensor VALUE value), n AS (SELECT sensor, count(value) AS readings, count(*) FILTER (({SIGN}) * (value - warn) > 0) AS past_warning FROM long JOIN {_rules} USING (sensor) GROUP BY 1) SELECT sensor, component, unit, direction, source, {_limits}, coalesce(readings, 0) AS readings, coalesce(past_warning, 0) AS past_warning FROM {_rules} LEFT JOIN n USING (sensor)")
def h8(spark, d):
    return R.rule_records(R.rule_table(spark), keyed(spark, d))


@query("q22_calibrated_limits", f"WITH {STATS}, {_cal}, e AS (SELECT sensor, ewma_warning FROM cal WHERE ewma_warning > {_lim}) SELECT coalesce(cal.sensor, e.sensor) AS sensor, cal.signals_alarm, e.ewma_warning FROM cal FULL JOIN e ON cal.sensor = e.sensor")
def q22(spark, d):
    cal = written(drift.calibrate(marked_statistics(spark, d), "_healthy"), "calibration")
    raised = cal.filter(F.col("ewma_warning") > drift.ewma_limit()).select("sensor", "ewma_warning")
    return cal.select("sensor", "signals_alarm").join(raised.hint("merge"), "sensor", "full_outer")


@query("h10_quality_document", f"""WITH {FLAGS}, q AS (SELECT turbine_id, timestamp, bool_or(out_of_range OR stuck OR rate) AS bad FROM fl GROUP BY 1, 2), c AS (SELECT sensor, count(*) FILTER (out_of_range) AS out_of_range, count(*) FILTER (warning) AS warning, count(*) FILTER (alarm_flag) AS alarm, count(*) FILTER (stuck) AS stuck, count(*) FILTER (rate) AS rate FROM fl GROUP BY 1),
u AS (UNPIVOT c ON out_of_range, warning, alarm, stuck, rate INTO NAME "check" VALUE n) SELECT 'rules' AS section, sensor || '.' || "check" AS item, n::DOUBLE AS value FROM u
UNION ALL SELECT 'quality', 'sensor_validity', {S.r('1 - avg(bad::INT)', 6)} FROM q UNION ALL SELECT 'cleaning', 'rows_kept', count(*)::DOUBLE FROM m UNION ALL SELECT 'cleaning', 'rows_read', (SELECT count(*) FROM raw)::DOUBLE""")
def h10(spark, d):
    """The data-quality document as rows: cleaning counts, flags by rule, and the share of valid rows."""
    f = flags(spark, d)
    row = lambda frame, section, item, value: frame.select(F.lit(section).alias("section"), item.alias("item"), value.cast("double").alias("value"))
    out = row(R.flag_counts(f), "rules", F.concat_ws(".", "sensor", "check"), F.col("n"))
    out = out.unionByName(row(R.data_quality(f), "quality", F.lit("sensor_validity"), rounded("data_quality", 6)))
    counts = cleaning.key_counts(machines(spark, d))
    return out.unionByName(row(counts, "cleaning", F.lit("rows_kept"), F.col("output"))).unionByName(row(counts, "cleaning", F.lit("rows_read"), F.col("input")))
