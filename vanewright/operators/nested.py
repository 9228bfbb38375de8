"""Nested windows: one array of observations per machine, their contract, and their history gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.telemetry import RANGES, SENSORS, micros
from . import labels

HOUR = labels.HOUR


def to_windows(frame: DataFrame, sensors=SENSORS) -> DataFrame:
    """(turbine_id, observations): rows of each machine in time order. Meant for bounded windows (see last_rows);
    whole histories stay flat."""
    obs = F.struct("timestamp", *sensors, "operational_status")
    return frame.groupBy("turbine_id").agg(F.array_sort(F.collect_list(obs)).alias("observations"))


def last_rows(frame: DataFrame, rows: int) -> DataFrame:
    order = Window.partitionBy("turbine_id").orderBy(F.desc("timestamp"), F.desc("ordinal"))
    return frame.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rows).drop("_n")


def to_rows(windows: DataFrame, sensors=SENSORS) -> DataFrame:
    """Observations as rows; sensors that the windows lack are null."""
    rows = windows.select("turbine_id", F.posexplode("observations").alias("ordinal", "o"))
    have = set(rows.schema["o"].dataType.fieldNames())
    pick = lambda c, kind: F.col(f"o.{c}").alias(c) if c in have else F.lit(None).cast(kind).alias(c)
    return rows.select("turbine_id", "ordinal", pick("timestamp", "timestamp_ntz"), *(pick(c, "double") for c in sensors), pick("operational_status", "string"))


def outside(sensor: str):
    return lambda o: F.coalesce(~o[sensor].between(*RANGES[sensor]), F.lit(False))


def violations(windows: DataFrame, sensors=SENSORS) -> DataFrame:
    """(turbine_id, violation): empty or unsorted windows, repeated times, and readings out of bounds; by array
    functions alone, so nothing is exploded."""
    obs = F.col("observations")
    times = F.transform(obs, lambda o: o["timestamp"])
    checks: list[tuple[str, Column]] = [
        ("empty", F.size(obs) == 0),
        ("unsorted", ~F.coalesce(times == F.array_sort(times), F.lit(False))),
        ("repeated_times", F.size(F.array_distinct(times)) < F.size(times)),
    ]
    checks += [(f"bounds_{c}", F.exists(obs, outside(c))) for c in sensors]
    found = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in checks)))
    return windows.select("turbine_id", F.explode(found).alias("violation"))


def history(frame: DataFrame, required_hours: float, least_rows: int = 2) -> DataFrame:
    """(turbine_id, span_hours, rows, accepted): whether a machine has enough history to be scored."""
    t = micros("timestamp")
    by = frame.groupBy("turbine_id").agg(((F.max(t) - F.min(t)) / HOUR).alias("span_hours"), F.count("*").alias("rows"))
    return by.withColumn("accepted", (F.col("span_hours") >= required_hours) & (F.col("rows") >= least_rows))


class TooManyWindows(ValueError):
    """A batch above its limit."""


def limit_batch(windows: DataFrame, most: int = 200) -> DataFrame:
    """The windows, if there are no more than a caller allows; an optional guard of interactive callers."""
    if windows.limit(most + 1).count() > most:
        raise TooManyWindows(f"more than {most} windows")
    return windows


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
