"""Validation findings: (check, severity, message, count, details). Nothing is changed, only reported.

Checks that look at single rows share one aggregate pass; keyed checks add one shuffle each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.telemetry import RANGES, REQUIRED, SENSORS, STATUSES, micros
from .windows import ENTITY, TIME

ERROR, WARNING = "error", "warning"
MOST_MISSING, SOME_MISSING, LEAST_ROWS = 0.15, 0.05, 720


class InvalidTelemetry(ValueError):
    """A strict validation found errors."""


def finding(check: str | Column, severity: str | Column, message: str | Column, count: Column, details: Column | None = None) -> list[Column]:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return [
        as_col(check).alias("check"), as_col(severity).alias("severity"), as_col(message).alias("message"), count.cast("long").alias("count"),
        (F.lit(None).cast("string") if details is None else details).alias("details"),
    ]


def missing_columns(frame: DataFrame, required=REQUIRED) -> list[str]:
    return [c for c in required if c not in frame.columns]


def schema_findings(frame: DataFrame, required=REQUIRED) -> DataFrame:
    """One finding if columns are missing; looks at the schema alone."""
    missing = missing_columns(frame, required)
    rows = [("required_columns", ERROR, "required columns are missing", len(missing), ",".join(missing))] if missing else []
    return frame.sparkSession.createDataFrame(rows, "check string, severity string, message string, count long, details string")


def row_counts(frame: DataFrame, sensors=SENSORS) -> DataFrame:
    """(check, name, n, rows): everything that one pass over the rows can count."""
    items: list[tuple[str, str, Column]] = [("null_key", ENTITY, F.col(ENTITY).isNull()), ("null_key", TIME, F.try_to_timestamp(F.col(TIME).cast("string")).isNull())]
    items += [("missing", c, F.col(c).isNull()) for c in sensors]
    items += [("range", c, ~F.col(c).between(*RANGES[c])) for c in sensors]
    items += [("failure_value", "failure_event", F.col("failure_event").isNull() | ~F.col("failure_event").isin(0, 1)), ("failures", "failure_event", F.col("failure_event") == 1)]
    counted = frame.agg(F.count("*").alias("rows"), *(F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(items)))
    return counted.select(F.col("rows"), F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.lit(n).alias("name"), F.col(f"c{i}").alias("n")) for i, (k, n, _) in enumerate(items)))).alias("x")).select("x.check", "x.name", "x.n", "rows")


def key_findings(counts: DataFrame) -> DataFrame:
    hit = counts.filter("check = 'null_key' and n > 0")
    return hit.select(*finding(F.concat(F.lit("null_"), "name"), WARNING, "rows without a usable key", F.col("n")))


def missing_findings(counts: DataFrame, most: float = MOST_MISSING, some: float = SOME_MISSING) -> DataFrame:
    """Sensors whose share of missing readings is elevated or excessive."""
    share = F.col("n") / F.greatest("rows", F.lit(1))
    hit = counts.filter("check = 'missing'").withColumn("share", share).filter(F.col("share") > some)
    excessive = F.col("share") > most
    return hit.select(
        *finding(
            F.when(excessive, "missing_excessive").otherwise("missing_elevated"), F.when(excessive, ERROR).otherwise(WARNING), F.concat(F.lit("missing readings in "), "name"), F.col("n"), F.round("share", 6).cast("decimal(10,6)").cast("string")
        )
    )


def range_findings(counts: DataFrame) -> DataFrame:
    return counts.filter("check = 'range' and n > 0").select(*finding(F.concat(F.lit("range_"), "name"), WARNING, "readings outside the physical range", F.col("n")))


def failure_findings(counts: DataFrame) -> DataFrame:
    bad = counts.filter("check = 'failure_value' and n > 0").select(*finding("failure_value", ERROR, "failure_event is not 0 or 1", F.col("n")))
    none = counts.filter("check = 'failures' and n = 0").select(*finding("no_failures", ERROR, "no failure events", F.col("n")))
    return bad.unionByName(none)


def duplicate_findings(frame: DataFrame) -> DataFrame:
    """Extra rows of keys that occur more than once."""
    by_key = frame.filter(F.col(ENTITY).isNotNull() & F.col(TIME).isNotNull()).groupBy(ENTITY, TIME).agg(F.count("*").alias("n"))
    extra = by_key.agg(F.sum(F.col("n") - 1).alias("n"))
    return extra.filter("n > 0").select(*finding("duplicate_keys", WARNING, "rows repeat a key", F.col("n")))


def order_findings(frame: DataFrame) -> DataFrame:
    """Machines whose rows did not arrive in time order."""
    arrival = Window.partitionBy(ENTITY).orderBy("ordinal")
    late = frame.filter(F.col(ENTITY).isNotNull()).select(ENTITY, (F.col(TIME) < F.lag(TIME).over(arrival)).alias("late"))
    machines = late.groupBy(ENTITY).agg(F.bool_or("late").alias("late")).filter("late")
    some = machines.agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(ENTITY)), 1, 20), ",").alias("d"))
    return some.filter("n > 0").select(*finding("unsorted_times", WARNING, "rows out of time order", F.col("n"), F.col("d")))


def status_findings(frame: DataFrame, allowed=STATUSES) -> DataFrame:
    odd = frame.filter(F.col("operational_status").isNotNull() & ~F.col("operational_status").isin(*allowed)).groupBy("operational_status").agg(F.count("*").alias("n"))
    return odd.select(*finding("unexpected_status", ERROR, "status is not allowed", F.col("n"), F.col("operational_status")))


def machine_findings(frame: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Machines with few rows, and machines without a failure."""
    by = frame.filter(F.col(ENTITY).isNotNull()).groupBy(ENTITY).agg(F.count("*").alias("n"), F.coalesce(F.sum("failure_event"), F.lit(0)).alias("f"))
    total = by.agg(F.count_if(F.col("n") < least_rows).alias("few"), F.count_if(F.col("f") == 0).alias("quiet"))
    few = total.filter("few > 0").select(*finding("few_rows", WARNING, "machines with little history", F.col("few")))
    return few.unionByName(total.filter("quiet > 0").select(*finding("no_machine_failures", WARNING, "machines without failures", F.col("quiet"))))


def validate(frame: DataFrame, sensors=SENSORS, least_rows: int = LEAST_ROWS, required=REQUIRED) -> DataFrame:
    """All findings. Missing columns end the validation at once."""
    if missing_columns(frame, required):
        return schema_findings(frame, required)
    counts = row_counts(frame, sensors)
    parts = [f(counts) for f in (key_findings, missing_findings, range_findings, failure_findings)]
    parts += [duplicate_findings(frame), order_findings(frame), status_findings(frame), machine_findings(frame, least_rows)]
    return reduce(DataFrame.unionByName, parts)


def raise_for_errors(findings: DataFrame) -> DataFrame:
    errors = [r["check"] for r in findings.filter(F.col("severity") == ERROR).select("check").distinct().limit(50).collect()]
    if errors:
        raise InvalidTelemetry(", ".join(sorted(errors)))
    return findings


def summary(frame: DataFrame) -> DataFrame:
    """One row: rows, machines, first and last time, failures."""
    t = micros(TIME)
    return frame.agg(F.count("*").alias("rows"), F.count_distinct(ENTITY).alias("machines"), F.min(t).alias("first"), F.max(t).alias("last"), F.sum("failure_event").alias("failures"))


def missing_shares(frame: DataFrame, sensors=SENSORS) -> DataFrame:
    """(sensor, share) of every sensor, in one pass."""
    return frame.agg(*(F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(c) for c in sensors)).unpivot([], list(sensors), "sensor", "share")


def target_findings(frame: DataFrame, target: str) -> DataFrame:
    """A target that is absent, missing, not 0 or 1, never positive, or positive more often than not."""
    if target not in frame.columns:
        return frame.sparkSession.range(1).select(*finding("target_absent", ERROR, "no such column", F.lit(1), F.lit(target)))
    t = F.col(target)
    counts = frame.agg(F.count("*").alias("rows"), F.count_if(t.isNull()).alias("nulls"), F.count_if(~t.isin(0, 1)).alias("odd"), F.count_if(t == 1).alias("positive"))
    rows = [
        ("target_nulls", ERROR, "missing labels", F.col("nulls"), F.col("nulls") > 0), ("target_values", ERROR, "labels other than 0 and 1", F.col("odd"), F.col("odd") > 0),
        ("target_no_positives", ERROR, "no positive labels", F.col("positive"), F.col("positive") == 0), ("target_rate", WARNING, "more positive than negative labels", F.col("positive"), F.col("positive") * 2 > F.col("rows")),
    ]
    return reduce(DataFrame.unionByName, [counts.filter(when).select(*finding(c, s, m, n)) for c, s, m, n, when in rows])


def rule_range_findings(rules: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rules whose hard limits disagree with the physical ranges (sensor, low, high), either way round."""
    both = rules.select("sensor", "hard_min", "hard_max").join(ranges, "sensor", "full_outer")
    odd = ~(F.col("hard_min").eqNullSafe(F.col("low")) & F.col("hard_max").eqNullSafe(F.col("high")))
    return both.filter(odd).select("sensor", "hard_min", "hard_max", "low", "high")


def split_labels(frame: DataFrame, target: str) -> DataFrame:
    """(split, rows, positives, rate, ok): whether every part has positives."""
    return frame.groupBy("split").agg(F.count("*").alias("rows"), F.sum(target).alias("positives"), F.avg(target).alias("rate")).withColumn("ok", F.col("positives") > 0)
