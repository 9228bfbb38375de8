"""Sources, validation, cleaning, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import cleaning, labels, nested, validation
from ..operators.rules import rule_table
from ..operators import rules as rules_op
from ..sources import files, telemetry as T
from . import sql as S
from .registry import query

ID = ("turbine_id", "ordinal")


def machines(spark, d):
    return T.machines(spark, d)


def keyed(spark, d):
    return cleaning.normalise_keys(T.machines(spark, d), together=True)


def keyed_events(spark, d):
    return cleaning.normalise_keys(T.events(spark, d), together=True)


# one row in fifty arrives twice, some keys are missing, some rows late: what the driver's events do not have by themselves
def rough_events(spark, d):
    e = T.events(spark, d)
    extra = e.filter("ordinal % 50 = 0").withColumn("ordinal", F.col("ordinal") + 1000000000)
    lost = e.filter("ordinal % 97 = 0").withColumns({"turbine_id": F.lit(None).cast("string"), "ordinal": F.col("ordinal") + 2000000000})
    return e.unionByName(extra).unionByName(lost)


ROUGH = (
    f"raw AS (WITH e AS ({T.events_sql()}) SELECT * FROM e UNION ALL SELECT * REPLACE (ordinal + 1000000000 AS ordinal) FROM e WHERE ordinal % 50 = 0 "
    "UNION ALL SELECT * REPLACE (NULL AS turbine_id, ordinal + 2000000000 AS ordinal) FROM e WHERE ordinal % 97 = 0)"
)


@query("a3_loaded_table", "SELECT event_type, count(*) AS rows, count(*) AS ordinals FROM events GROUP BY 1")
def a3(spark, d):
    """A table loaded by its path with its columns checked; every row has an ordinal of its own."""
    rows = files.load_telemetry(spark, f"{d}/events.parquet", ("event_id", "user_id", "ts", "event_type", "value"))
    return rows.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("ordinal").alias("ordinals"))


@query("a4_first_rows", f"WITH {S.EVENTS} SELECT turbine_id, ordinal FROM raw QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp, ordinal) <= greatest(600 // (SELECT count(DISTINCT turbine_id) FROM raw), 1)")
def a4(spark, d):
    e = T.events(spark, d)
    return files.first_rows(e, 600, e.select("turbine_id").distinct().count()).select(*ID)


@query("a8_windows_round_trip", f"WITH {S.MACHINES} SELECT turbine_id, CAST(row_number() OVER ({S.BY}) - 1 AS INTEGER) AS ordinal, {S.r('vibration')} AS vibration, {S.r('power_output')} AS power_output, operational_status FROM m QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp DESC) <= 97".replace("CAST(row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp) - 1 AS INTEGER)", "CAST(least(count(*) OVER (PARTITION BY turbine_id), 97) - row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp DESC) AS INTEGER)"))
def a8(spark, d):
    rows = nested.to_rows(nested.to_windows(nested.last_rows(keyed(spark, d), 97)))
    return rows.select("turbine_id", "ordinal", rounded("vibration").alias("vibration"), rounded("power_output").alias("power_output"), "operational_status")


_bounds = " UNION ALL ".join(f"SELECT DISTINCT turbine_id, 'bounds_{c}' AS violation FROM w WHERE {c} < {lo} OR {c} > {hi}" for c, (lo, hi) in T.RANGES.items())


@query("a10_window_contract", f"WITH {S.MACHINES}, w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp DESC) <= 97) {_bounds}")
def a10(spark, d):
    return nested.violations(nested.to_windows(nested.last_rows(keyed(spark, d), 97)))


@query("a11_history_gate", f"WITH {S.EVENTS}, h AS (SELECT turbine_id, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9 AS s, count(*) AS n FROM m GROUP BY 1) SELECT turbine_id, {S.r('s')} AS span_hours, n AS rows, s >= 600 AND n >= 2 AS accepted FROM h")
def a11(spark, d):
    return nested.history(keyed_events(spark, d), 600.0).withColumn("span_hours", rounded("span_hours"))


_missing = " UNION ALL ".join(f"SELECT '{c}' AS sensor, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM raw" for c in T.SENSORS)


@query("b5_missing_shares", f"WITH {S.MACHINES} {_missing}")
def b5(spark, d):
    return validation.missing_shares(machines(spark, d))


_findings = " UNION ALL ".join(
    [f"SELECT 'range_{c}' AS \"check\", 'warning' AS severity, count(*) AS n FROM raw WHERE {c} < {lo} OR {c} > {hi} HAVING count(*) > 0" for c, (lo, hi) in T.RANGES.items()]
    + [f"SELECT CASE WHEN avg(({c} IS NULL)::INT) > 0.15 THEN 'missing_excessive' ELSE 'missing_elevated' END, CASE WHEN avg(({c} IS NULL)::INT) > 0.15 THEN 'error' ELSE 'warning' END, count(*) FILTER ({c} IS NULL) FROM raw HAVING avg(({c} IS NULL)::INT) > 0.05" for c in T.SENSORS]
    + ["SELECT 'duplicate_keys', 'warning', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM raw GROUP BY turbine_id, timestamp) HAVING sum(n - 1) > 0"]
    + ["SELECT 'unsorted_times', 'warning', count(DISTINCT turbine_id) FROM (SELECT turbine_id, timestamp < lag(timestamp) OVER (PARTITION BY turbine_id ORDER BY ordinal) AS late FROM raw) WHERE late HAVING count(*) > 0"]
    + ["SELECT 'few_rows', 'warning', count(*) FROM (SELECT turbine_id FROM raw GROUP BY 1 HAVING count(*) < 720) HAVING count(*) > 0"]
    + ["SELECT 'no_machine_failures', 'warning', count(*) FROM (SELECT turbine_id FROM raw GROUP BY 1 HAVING sum(failure_event) = 0) HAVING count(*) > 0"]
)


@query("b11_validation_findings", f"WITH {S.MACHINES} {_findings}")
def b11(spark, d):
    return validation.validate(machines(spark, d)).select("check", "severity", F.col("count").alias("n"))


@query("b2_rough_findings", f"WITH {ROUGH} SELECT 'null_turbine_id' AS \"check\", count(*) AS n FROM raw WHERE turbine_id IS NULL UNION ALL SELECT 'duplicate_keys', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM raw WHERE turbine_id IS NOT NULL GROUP BY turbine_id, timestamp) UNION ALL SELECT 'unsorted_times', count(DISTINCT turbine_id) FROM (SELECT turbine_id, timestamp < lag(timestamp) OVER (PARTITION BY turbine_id ORDER BY ordinal) AS late FROM raw WHERE turbine_id IS NOT NULL) WHERE late UNION ALL SELECT 'few_rows', count(*) FROM (SELECT turbine_id FROM raw WHERE turbine_id IS NOT NULL GROUP BY 1 HAVING count(*) < 720)")
def b2(spark, d):
    e = rough_events(spark, d)
    parts = [validation.key_findings(validation.row_counts(e, ("vibration",))), validation.duplicate_findings(e), validation.order_findings(e), validation.machine_findings(e).filter("check = 'few_rows'")]
    return nested.union_all(parts).select("check", F.col("count").alias("n"))


@query("b7_unexpected_status", f"WITH {S.EVENTS} SELECT operational_status AS details, count(*) AS n FROM raw WHERE operational_status NOT IN ('normal', 'idle') GROUP BY 1")
def b7(spark, d):
    return validation.status_findings(T.events(spark, d), ("normal", "idle")).select("details", F.col("count").alias("n"))


@query("b10_summary", f"WITH {S.MACHINES} SELECT count(*) AS rows, count(DISTINCT turbine_id) AS machines, min(epoch_us(timestamp)) AS first, max(epoch_us(timestamp)) AS last, CAST(sum(failure_event) AS BIGINT) AS failures FROM raw")
def b10(spark, d):
    return validation.summary(machines(spark, d))


@query("b12_target_findings", "SELECT 'target_rate' AS \"check\", 'warning' AS severity, count(*) FILTER (quality = 1) AS n FROM labels HAVING count(*) FILTER (quality = 1) * 2 > count(*)")
def b12(spark, d):
    return validation.target_findings(T.read(spark, d, "labels"), "quality").select("check", "severity", F.col("count").alias("n"))


@query("b13_rule_ranges", f"WITH stats AS (SELECT min(l_quantity) AS lo FROM lineitem) SELECT rule.sensor, rule.hard_min, rule.hard_max, range.low, range.high FROM {S.values([(x[0], x[3], x[4]) for x in rules_op.RULES], 'sensor, hard_min, hard_max').replace(') t(', ') rule(')} FULL JOIN {S.values([(c, lo, hi) for c, (lo, hi) in T.RANGES.items()], 'sensor, low, high').replace(') t(', ') range(')} ON rule.sensor = range.sensor, stats WHERE rule.sensor IS NULL AND 1 = 0 OR (rule.hard_min IS DISTINCT FROM least(range.low, stats.lo) OR rule.hard_max IS DISTINCT FROM range.high) AND rule.sensor IS NOT NULL")
def b13(spark, d):
    least = T.read(spark, d, "lineitem").agg(F.min("l_quantity").alias("lo"))
    ranges = spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in T.RANGES.items()], "sensor string, low double, high double").join(F.broadcast(least)).withColumn("cut", F.least("low", "lo"))
    odd = validation.rule_range_findings(rule_table(spark), ranges.select("sensor", F.col("cut").alias("low"), "high")).filter("hard_min is not null")
    return odd.drop("low").join(ranges.select("sensor", "low"), "sensor").select("sensor", "hard_min", "hard_max", "low", "high")


SPLIT = f"""b AS (SELECT CAST(trunc(quantile_cont(t, 0.6)) AS BIGINT) AS train_end, CAST(trunc(quantile_cont(t, 0.8)) AS BIGINT) AS valid_end FROM (SELECT DISTINCT epoch_us(timestamp) AS t FROM m)),
s AS (SELECT m.*, epoch_us(timestamp) AS t, CASE WHEN epoch_us(timestamp) <= train_end THEN 'train' WHEN epoch_us(timestamp) BETWEEN train_end + {48 * labels.HOUR} AND valid_end THEN 'valid' WHEN epoch_us(timestamp) >= valid_end + {48 * labels.HOUR} THEN 'test' ELSE 'embargo' END AS split FROM m, b)"""
_target = f"coalesce(max(failure_event) OVER (PARTITION BY turbine_id ORDER BY epoch_us(timestamp) RANGE BETWEEN 1 FOLLOWING AND {48 * labels.HOUR} FOLLOWING), 0)"


def labelled_events(spark, d):
    return labels.failure_target(keyed_events(spark, d))


@query("b14_split_labels", f"WITH {S.EVENTS}, {SPLIT}, l AS (SELECT split, {_target} AS target FROM s) SELECT split, count(*) AS rows, CAST(sum(target) AS BIGINT) AS positives, {S.r('avg(target)', 6)} AS rate, sum(target) > 0 AS ok FROM l GROUP BY 1")
def b14(spark, d):
    rows = labelled_events(spark, d)
    return validation.split_labels(labels.assign_splits(rows, labels.split_bounds(rows)), "target").withColumn("rate", rounded("rate", 6))


@query("c1_step_hours", f"WITH {S.MACHINES}, g AS (SELECT epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY turbine_id ORDER BY timestamp) AS gap FROM raw) SELECT {S.r('quantile_cont(gap, 0.5) / 3.6e9')} AS step_hours FROM g WHERE gap > 0")
def c1(spark, d):
    return cleaning.step_hours(machines(spark, d)).select(rounded("step_hours").alias("step_hours"))


@query("c3_normalise_keys", f"WITH {S.MACHINES} SELECT turbine_id, ordinal, {S.r('power_output')} AS power_output FROM m")
def c3(spark, d):
    return keyed(spark, d).select(*ID, rounded("power_output").alias("power_output"))


@query("c3_key_counts", f"WITH {ROUGH}, k AS (SELECT count(*) AS n FROM raw WHERE turbine_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY turbine_id, timestamp) SELECT (SELECT count(*) FROM raw) AS input, (SELECT count(*) FROM raw WHERE turbine_id IS NULL) AS dropped_missing_keys, CAST((SELECT sum(n - 1) FROM k) AS BIGINT) AS dropped_duplicates, (SELECT count(*) FROM k) AS output")
def c3b(spark, d):
    return cleaning.key_counts(rough_events(spark, d))


_invalid = " UNION ALL ".join(f"SELECT '{c}' AS sensor, count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS n FROM raw" for c, (lo, hi) in T.RANGES.items())


@query("c4_invalid_counts", f"WITH {S.MACHINES} {_invalid}")
def c4(spark, d):
    return cleaning.invalid_counts(machines(spark, d))


_v = "CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}"
_valid = ", ".join(_v.format(c=c, lo=lo, hi=hi) for c, (lo, hi) in T.RANGES.items())
_carry = ", ".join(f"last_value({c} IGNORE NULLS) OVER ({S.BY} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}" for c in cleaning.CARRIED)
_rest = ", ".join(c for c in T.SENSORS if c not in cleaning.CARRIED)
_median = ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY turbine_id)) AS {c}" for c in T.SENSORS)
_fleet = ", ".join(f"{S.r(f'coalesce({c}, (SELECT median({c}) FROM p), 0)')} AS {c}" for c in T.SENSORS)
CLEAN = f"{S.MACHINES}, v AS (SELECT turbine_id, ordinal, timestamp, operational_status, {_valid} FROM m), f AS (SELECT turbine_id, ordinal, operational_status, {_carry}, {_rest} FROM v), p AS (SELECT turbine_id, ordinal, coalesce(operational_status, 'normal') AS operational_status, {_median} FROM f)"


@query("c6_preprocess", f"WITH {CLEAN} SELECT turbine_id, ordinal, operational_status, {_fleet} FROM p")
def c6(spark, d):
    return cleaning.preprocess(machines(spark, d)).select(*ID, "operational_status", *(rounded(c).alias(c) for c in T.SENSORS))


@query("d1_failure_within_horizon", f"WITH {S.EVENTS} SELECT turbine_id, ordinal, {_target} AS target, epoch_us(timestamp) <= max(epoch_us(timestamp)) OVER (PARTITION BY turbine_id) - {48 * labels.HOUR} AS label_reliable FROM m")
def d1(spark, d):
    return labelled_events(spark, d).select(*ID, "target", "label_reliable")


@query("d4_eligible", f"WITH {S.EVENTS}, l AS (SELECT *, epoch_us(timestamp) <= max(epoch_us(timestamp)) OVER (PARTITION BY turbine_id) - {48 * labels.HOUR} AS ok, operational_status IN ('fault', 'maintenance') AS off FROM m), q AS (SELECT *, coalesce(max(off::INT) OVER ({S.BY} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) = 1 AS after_repair FROM l) SELECT turbine_id, ordinal, after_repair, ok AND NOT off AND NOT after_repair AS modelling_eligible FROM q")
def d4(spark, d):
    return labels.eligible(labelled_events(spark, d), 6).select(*ID, "after_repair", "modelling_eligible")


@query("d5_health_target", f"WITH {S.MACHINES} SELECT turbine_id, ordinal, {S.r(S.clip('100.0 * (1.0 - coalesce(degradation_level, 0.0))', 0.0, 100.0))} AS health_score, operational_status NOT IN ('fault', 'maintenance') AND degradation_level IS NOT NULL AS health_eligible FROM m")
def d5(spark, d):
    return labels.health_target(keyed(spark, d)).select(*ID, rounded("health_score").alias("health_score"), "health_eligible")


@query("d6_anomaly_truth", f"WITH {S.MACHINES} SELECT turbine_id, ordinal, (coalesce(degradation_level, 0.0) >= 0.2)::INT AS is_anomalous, (coalesce(degradation_level, 0.0) <= 0.0)::INT AS is_healthy FROM m")
def d6(spark, d):
    return labels.anomaly_truth(keyed(spark, d)).select(*ID, "is_anomalous", "is_healthy")


@query("d7_split_bounds", f"WITH {S.MACHINES}, {SPLIT} SELECT train_end, train_end + {48 * labels.HOUR} AS valid_start, valid_end, valid_end + {48 * labels.HOUR} AS test_start FROM b")
def d7(spark, d):
    return labels.split_bounds(keyed(spark, d))


@query("d8_assign_splits", f"WITH {S.MACHINES}, {SPLIT} SELECT turbine_id, ordinal, split FROM s")
def d8(spark, d):
    rows = keyed(spark, d)
    return labels.assign_splits(rows, labels.split_bounds(rows)).select(*ID, "split")


@query("d10_split_gaps", f"WITH {S.MACHINES}, {SPLIT}, g AS (SELECT (min(t) FILTER (split = 'valid') - max(t) FILTER (split = 'train')) / 3.6e9 AS a, (min(t) FILTER (split = 'test') - max(t) FILTER (split = 'valid')) / 3.6e9 AS b FROM s) SELECT {S.r('a')} AS train_valid_hours, {S.r('b')} AS valid_test_hours, a >= 48 AND b >= 48 AS ok FROM g")
def d10(spark, d):
    rows = keyed(spark, d)
    gaps = labels.split_gaps(labels.assign_splits(rows, labels.split_bounds(rows)))
    return gaps.withColumns({c: rounded(c) for c in ("train_valid_hours", "valid_test_hours")})


@query("q19_split_summary", f"WITH {S.MACHINES}, {SPLIT} SELECT split, count(*) AS rows, CAST(sum(failure_event) AS BIGINT) AS positives, {S.r('avg(failure_event)', 6)} AS rate, min(t) AS first, max(t) AS last FROM s GROUP BY 1")
def q19(spark, d):
    rows = keyed(spark, d)
    return labels.split_summary(labels.assign_splits(rows, labels.split_bounds(rows)), "failure_event").withColumn("rate", rounded("rate", 6))


@query("a6_prepared_outputs", f"WITH {S.MACHINES}, {SPLIT}, f AS (SELECT turbine_id, timestamp, lag(vibration, 6) {S.LAG} AS x FROM m) SELECT split, count(*) AS rows, CAST(sum(failure_event) AS BIGINT) AS positives, count(x) AS known, {S.r('avg(x)')} AS mean_before FROM s JOIN f USING (turbine_id, timestamp) GROUP BY 1")
def a6(spark, d):
    """Labelled rows and features, prepared as tables of one key and joined again, by split."""
    from ..operators import features, models
    from ..sources.prepared import write_aligned

    rows = keyed(spark, d)
    labelled = labels.assign_splits(rows, labels.split_bounds(rows)).select("turbine_id", "timestamp", "split", "failure_event")
    matrix, _ = features.failure_features(rows, ("lag",))
    made = write_aligned({"labels": labelled, "features": matrix.select("turbine_id", "timestamp", "vibration_lag_6h")})
    both = models.with_labels(made["features"], made["labels"], "failure_event")
    return both.groupBy("split").agg(F.count("*").alias("rows"), F.sum("failure_event").cast("long").alias("positives"), F.count("vibration_lag_6h").alias("known"), rounded(F.avg("vibration_lag_6h")).alias("mean_before"))
