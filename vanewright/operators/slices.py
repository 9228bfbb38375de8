"""Time slices with halo rows, so that one long machine spreads over many tasks.

A window over the last so many rows of a machine needs, of what came before a slice of its series, that many rows and no
more. Rows are dealt to ranges of (machine, time); every range that continues a machine gets copies of the rows just
before it (its halo); slices then stand in for machines while features are built, and halo rows are left out of the
result. Few rows are copied: the look back once for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .windows import ENTITY, TIME

#: Rows of a slice; machines of no more rows are not sliced.
SLICE_ROWS = 500_000
HALO, SEPARATOR = "_halo", "\x1f"


def with_slices(frame: DataFrame, lead: int, slice_rows: int) -> DataFrame:
    """Adds _halo, and names each slice of a machine `range + SEPARATOR + machine` in the machine's column."""
    total = frame.count()
    ranges = max(1, -(-total // slice_rows))
    dealt = frame.repartitionByRange(ranges, ENTITY, TIME).sortWithinPartitions(ENTITY, TIME).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges-of-rows")
    # places in the machine's series, from keys alone: rows of its ranges before, then within the range
    before = Window.partitionBy(ENTITY).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges_of = dealt.groupBy(ENTITY, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranges_of = written(ranges_of, "machine-ranges")
    within = Window.partitionBy(ENTITY, "_range").orderBy(TIME)
    later = ranges_of.filter("_before > 0").select(ENTITY, F.col("_range").alias("_slice"), F.greatest(F.col("_before") - lead, F.lit(0)).alias("_place"))
    # at most one range a partition continues a machine, so this side is no larger than the number of partitions
    split = later.select(ENTITY).distinct()
    places = dealt.select(ENTITY, TIME, "_range").join(F.broadcast(split), ENTITY).withColumn("_at", F.row_number().over(within) - 1)
    places = places.join(F.broadcast(ranges_of.join(F.broadcast(split), ENTITY).select(ENTITY, "_range", "_before")), [ENTITY, "_range"])
    cuts = places.select(ENTITY, "_range", F.col(TIME).alias("_cut"), (F.col("_before") + F.col("_at")).alias("_place")).join(F.broadcast(later), [ENTITY, "_place"])
    # a halo may lie in several short ranges
    spans = written(cuts.select(ENTITY, "_slice", "_cut", F.explode(F.sequence("_range", F.col("_slice") - 1)).alias("_range")), "halo-spans")
    lies = F.col("_cut").isNull() | F.coalesce(F.col(TIME) >= F.col("_cut"), F.lit(False))
    halo = dealt.join(F.broadcast(spans), [ENTITY, "_range"]).filter(lies).withColumn(HALO, F.lit(True))
    rows = dealt.withColumn("_slice", F.col("_range")).withColumn(HALO, F.lit(False)).unionByName(halo.drop("_cut"))
    return rows.withColumn(ENTITY, F.concat(F.col("_slice").cast("string"), F.lit(SEPARATOR), F.col(ENTITY))).drop("_range", "_slice")


def in_slices(frame: DataFrame, lead: int, build: Callable[[DataFrame], DataFrame], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """build(frame), for a build that adds columns by windows over at most `lead` earlier rows of a machine and keeps the
    columns that it got. Where no machine is longer than a slice, it is built by machine."""
    longest = frame.groupBy(ENTITY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= slice_rows:
        return build(frame)
    made = build(with_slices(frame, lead, slice_rows)).filter(~F.col(HALO)).drop(HALO)
    machine = F.substr(F.col(ENTITY), F.locate(SEPARATOR, ENTITY) + 1)
    return made.withColumn(ENTITY, machine.cast(frame.schema[ENTITY].dataType))
