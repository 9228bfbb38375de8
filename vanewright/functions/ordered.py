"""Running sums over a whole frame in the order of a number, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Ranges that a frame is dealt to.
RANGES = 256


def with_running(frame: DataFrame, key: str, sums: dict[str, Column], descending: bool = False, before: bool = False) -> DataFrame:
    """Adds sums over all rows up to each one in the order of `key` (a number; missing ones are least); `before`: without
    the row itself. Rows are dealt to ranges of the key by its approximate quantiles, summed within them, and get what
    the ranges before hold: one row for each range goes to every task."""
    bounds = sorted(set(frame.approxQuantile(key, [i / RANGES for i in range(1, RANGES)], 0.001))) if frame.columns else []
    value = F.col(key).cast("double")
    bucket = F.when(value.isNull(), -1).otherwise(F.size(F.filter(F.lit(bounds), lambda b: b < value)) if bounds else F.lit(0))
    rows = frame.withColumns({"_range": bucket} | {f"_own_{n}": c for n, c in sums.items()})
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    past = Window.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range").agg(*(F.sum(f"_own_{n}").alias(f"_all_{n}") for n in sums))
    # a row for each range
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_all_{n}").over(past), F.lit(0)).alias(f"_start_{n}") for n in sums))
    within = Window.partitionBy("_range").orderBy(way(key)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = rows.join(F.broadcast(starts), "_range")
    out = out.withColumns({n: F.col(f"_start_{n}") + F.coalesce(F.sum(f"_own_{n}").over(within), F.lit(0)) for n in sums})
    return out.drop("_range", *(f"_{k}_{n}" for n in sums for k in ("own", "start")))


#: Rows, of all groups together, that a window a group may sort.
FEW_ROWS = 1_000_000


def with_grouped_running(frame: DataFrame, keys: list[str], by: str, sums: dict[str, str], few_rows: int = FEW_ROWS) -> DataFrame:
    """Adds, for each of `sums` (new name: column), the sum over the rows of a group up to each one in ascending order
    of `by` (missing ones first). Few rows take a window a group; of many, ranges of (group, value) are summed apart, and
    each starts with what the group's ranges before it hold, so a large group spreads over many tasks."""
    way = F.asc_nulls_first(by)
    within = Window.partitionBy(*keys).orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
    if frame.count() <= few_rows:
        return frame.withColumns({n: F.sum(c).over(within) for n, c in sums.items()})
    ranged = written(frame.repartitionByRange(*keys, by).withColumn("_part", F.spark_partition_id()), "running-ranges")
    # a row for each group and range
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_all_{n}") for n, c in sums.items()))
    starts = held.select(*keys, "_part", *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in sums))
    own = Window.partitionBy("_part", *keys).orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({n: F.sum(c).over(own) for n, c in sums.items()}).join(starts.hint("merge"), [*keys, "_part"])
    return summed.withColumns({n: F.col(n) + F.col(f"_start_{n}") for n in sums}).drop("_part", *(f"_start_{n}" for n in sums))
