"""Forward-looking labels, eligibility, and chronological splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clip, holds
from ..functions.quantiles import wide_quantiles
from ..sources.telemetry import micros
from .windows import ENTITY, TIME, order

HOUR = 3_600_000_000
HORIZON, EMBARGO, REPAIR_HOURS = 48.0, 48.0, 6.0
TRAIN_END, VALID_END = 0.60, 0.80
OFF = ("fault", "maintenance")


class BadSplit(ValueError):
    """Times or settings that give no valid split."""


def failure_target(frame: DataFrame, horizon_hours: float = HORIZON, name: str = "target") -> DataFrame:
    """1 if the machine has a failure within (t, t + horizon]; the failure's own row is not counted. Also whether the
    label is reliable: the machine's record reaches a horizon further. One range window, no self-join."""
    horizon = int(horizon_hours * HOUR)
    ahead = Window.partitionBy(ENTITY).orderBy("_t").rangeBetween(1, horizon)
    frame = frame.withColumn("_t", micros(TIME))
    return frame.withColumns(
        {
            name: F.coalesce(F.max((F.col("failure_event") == 1).cast("int")).over(ahead), F.lit(0)),
            "label_reliable": F.col("_t") <= F.max("_t").over(Window.partitionBy(ENTITY)) - horizon,
        }
    ).drop("_t")


def eligible(frame: DataFrame, repair_rows: int) -> DataFrame:
    """Adds modelling_eligible: a reliable label, a machine that is running, and no repair in the rows before."""
    off = F.col("operational_status").isin(*OFF)
    before = F.max(off.cast("int")).over(order().rowsBetween(-repair_rows, -1))
    return frame.withColumns({"after_repair": F.coalesce(before, F.lit(0)) == 1}).withColumn("modelling_eligible", F.col("label_reliable") & ~holds(off) & ~F.col("after_repair"))


def health_target(frame: DataFrame) -> DataFrame:
    """100 (1 - degradation), bounded, and whether a row may be learned from."""
    score = clip(100.0 * (1.0 - F.coalesce(F.col("degradation_level"), F.lit(0.0))), 0, 100)
    return frame.withColumns({"health_score": score, "health_eligible": ~holds(F.col("operational_status").isin(*OFF)) & F.col("degradation_level").isNotNull()})


def check_degradation(frame: DataFrame) -> DataFrame:
    """The frame, if every degradation lies in [0, 1]."""
    if frame.filter(~F.col("degradation_level").between(0, 1)).limit(1).count():
        raise ValueError("degradation_level out of [0, 1]")
    return frame


def anomaly_truth(frame: DataFrame, truth: float = 0.20, healthy: float = 0.0) -> DataFrame:
    level = F.coalesce(F.col("degradation_level"), F.lit(0.0))
    return frame.withColumns({"is_anomalous": (level >= truth).cast("int"), "is_healthy": (level <= healthy).cast("int")})


def split_bounds(frame: DataFrame, train_end: float = TRAIN_END, valid_end: float = VALID_END, embargo_hours: float = EMBARGO) -> DataFrame:
    """One row of micros: quantiles of the distinct times, and the starts an embargo later."""
    times = frame.filter(F.col(TIME).isNotNull()).select(micros(TIME).alias("t")).distinct()
    q = wide_quantiles(times, {"q": "t"}, [train_end, valid_end])
    gap = int(embargo_hours * HOUR)
    ends = q.select(F.col("q")[0].cast("long").alias("train_end"), F.col("q")[1].cast("long").alias("valid_end"))
    return ends.select("train_end", (F.col("train_end") + gap).alias("valid_start"), "valid_end", (F.col("valid_end") + gap).alias("test_start"))


def check_bounds(bounds: DataFrame, horizon_hours: float = HORIZON, embargo_hours: float = EMBARGO):
    """The bounds as a row, if they make three parts."""
    b = bounds.first()
    if b is None or b["train_end"] is None:
        raise BadSplit("no times")
    if embargo_hours < horizon_hours:
        raise BadSplit("the embargo is shorter than the horizon")
    if not b["train_end"] < b["valid_start"] < b["valid_end"] < b["test_start"]:
        raise BadSplit("the parts are out of order")
    return b


def assign_splits(frame: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds split: train, valid, test, or embargo between them."""
    t = micros(TIME)
    name = (
        F.when(t <= F.col("train_end"), "train").when((t >= F.col("valid_start")) & (t <= F.col("valid_end")), "valid").when(t >= F.col("test_start"), "test").otherwise("embargo")
    )
    return frame.join(F.broadcast(bounds)).withColumn("split", name).drop(*bounds.columns)  # bounds is one row


def temporal_split(frame: DataFrame, bounds: DataFrame) -> dict[str, DataFrame]:
    named = assign_splits(frame, bounds)
    parts = {s: named.filter(F.col("split") == s) for s in ("train", "valid", "test")}
    empty = [s for s, part in parts.items() if part.limit(1).count() == 0]
    if empty:
        raise BadSplit(f"empty: {', '.join(empty)}")
    return parts


def split_summary(named: DataFrame, target: str = "target") -> DataFrame:
    """(split, rows, positives, rate, first, last) of rows with a split."""
    t = micros(TIME)
    return named.groupBy("split").agg(F.count("*").alias("rows"), F.sum(target).alias("positives"), F.avg(target).alias("rate"), F.min(t).alias("first"), F.max(t).alias("last"))


def split_gaps(named: DataFrame, embargo_hours: float = EMBARGO) -> DataFrame:
    """One row: hours between the parts and whether both reach the embargo."""
    t = micros(TIME)
    edge = named.agg(*(f(F.when(F.col("split") == s, t)).alias(f"{s}_{n}") for s in ("train", "valid", "test") for n, f in (("min", F.min), ("max", F.max))))
    gaps = edge.select(((F.col("valid_min") - F.col("train_max")) / HOUR).alias("train_valid_hours"), ((F.col("test_min") - F.col("valid_max")) / HOUR).alias("valid_test_hours"))
    return gaps.withColumn("ok", (F.col("train_valid_hours") >= embargo_hours) & (F.col("valid_test_hours") >= embargo_hours))
