"""Exact medians of all earlier rows of a machine, for machines too long for one task.

Before a slice of m rows, of the n earlier values only those of the m + 2 or so middle ranks can become a median within
the slice: with every further value the middle moves by half a rank. So a slice needs the earlier values of these ranks
and how many lie below them. They are found by counts over cells, which cut the range of a column's values about evenly:
counts of the slices before add up, the cells that hold the wanted ranks follow, and their values, counted by value, go
to the slice. A task holds some two slices of floats, and of all earlier slices nothing else.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.telemetry import KEY

ENTITY, TIME = KEY
#: Rows of a slice; machines of no more rows pass through one task.
MEDIAN_ROWS = 100_000
LEAST_CELLS, MOST_CELLS = 64, 4096


def in_ranges(frame: DataFrame, slice_rows: int) -> DataFrame:
    """The frame with _range: ranges of (machine, time), in order."""
    ranges = max(1, -(-frame.count() // slice_rows))
    return written(frame.repartitionByRange(ranges, ENTITY, TIME).withColumn("_range", F.spark_partition_id()), "ranges-of-rows")


def counts_before(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """(machine, _column, _range, cell, prior, below, n): for each slice and each cell of its column, how many earlier
    values the cell and the cells under it hold, and the number of all. cells: (machine, _column, _range, cell, c)."""
    every = cells.select(ENTITY, "_column", "cell").distinct().join(ranges.hint("merge"), ENTITY)
    at = [ENTITY, "_column", "_range", "cell"]
    dense = every.join(cells.hint("merge"), at, "left")
    earlier = Window.partitionBy(ENTITY, "_column", "cell").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    under = Window.partitionBy(ENTITY, "_column", "_range").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(ENTITY, "_column", "_range")
    out = dense.withColumn("prior", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    return out.withColumns({"below": F.coalesce(F.sum("prior").over(under), F.lit(0)), "n": F.sum("prior").over(whole), "m": F.coalesce(F.sum("c").over(whole), F.lit(0))})


def middle_values(dealt: DataFrame, columns: list[str]) -> DataFrame:
    """(machine, _range, _column, _x, _c, _base, _n): the earlier values that may become medians within a slice, how
    often each occurs, how many lie below all of them, and how many there are."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("_column"), F.col(c).alias("_x")) for c in columns))).alias("_p")
    long = dealt.select(ENTITY, "_range", pairs).select(ENTITY, "_range", "_p.*").filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    values = written(long.groupBy(ENTITY, "_column", "_range", "_x").agg(F.count("*").alias("c")), "values-of-slices")
    ranges = written(dealt.select(ENTITY, "_range").distinct(), "slices")
    most = ranges.groupBy(ENTITY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    cells = min(max(LEAST_CELLS, 2 * most), MOST_CELLS)
    cuts = values.groupBy(ENTITY, "_column").agg(F.array_distinct(F.percentile_approx("_x", [i / cells for i in range(1, cells)], 4 * cells)).alias("_cuts"))
    # a cell's number is that of the cuts below or at the value
    placed = written(values.join(cuts.hint("merge"), [ENTITY, "_column"]).withColumn("cell", F.size(F.filter("_cuts", lambda k: k <= F.col("_x")))).drop("_cuts"), "values-by-cell")
    counts = counts_before(placed.groupBy(ENTITY, "_column", "_range", "cell").agg(F.sum("c").alias("c")), ranges)
    low, high = F.floor((F.col("n") - F.col("m") - 1) / 2) - 1, F.floor((F.col("n") + F.col("m")) / 2)
    wanted = counts.filter((F.col("prior") > 0) & (F.col("below") + F.col("prior") > low) & (F.col("below") <= high))
    base = F.min("below").over(Window.partitionBy(ENTITY, "_column", "_range"))
    wanted = written(wanted.select(ENTITY, "_column", F.col("_range").alias("_for"), "cell", base.alias("_base"), F.col("n").alias("_n")), "cells-wanted")
    sent = placed.join(wanted.hint("merge"), [ENTITY, "_column", "cell"]).filter(F.col("_range") < F.col("_for"))
    return sent.groupBy(ENTITY, F.col("_for").alias("_range"), "_column", "_x").agg(F.sum("c").alias("_c"), F.first("_base").alias("_base"), F.first("_n").alias("_n"))


class Middle:
    """The middle of a growing multiset: sorted values from rank `base` on, of n in all."""

    def __init__(self) -> None:
        self.kept: list[tuple[float, int]] = []
        self.seen: list[float] | None = None
        self.base = self.n = 0

    def begin(self, rows: int) -> None:
        """Lay out the ranks that `rows` more values can make the middle, and no more."""
        low, high, rank, self.seen = (self.n - rows - 1) // 2 - 1, (self.n + rows) // 2, self.base, []
        first = None
        for x, c in sorted(self.kept):
            start, end = max(rank, low), min(rank + c, high + 1)
            if start < end:
                first = start if first is None else first
                self.seen += [x] * (end - start)
            rank += c
        self.base, self.kept = first or 0, []

    def medians(self, values: list[float], least: int) -> list[float | None]:
        out = []
        for x in values:
            out.append((self.seen[(self.n - 1) // 2 - self.base] + self.seen[self.n // 2 - self.base]) / 2 if self.n >= max(least, 1) else None)
            if x == x:
                insort(self.seen, x)
                self.n += 1
        return out


def with_earlier_medians(dealt: DataFrame, columns: dict[str, str], least: int) -> DataFrame:
    """Adds, for each (name, input) of columns, the median of the input over strictly earlier rows of the machine. dealt:
    a frame with _range (see in_ranges)."""
    size = F.count("*").over(Window.partitionBy(ENTITY, "_range"))
    fields = dealt.columns
    middles = middle_values(dealt, list(columns.values())).withColumn("_kind", F.lit(0))
    rows = dealt.withColumns({"_rows": size, "_kind": F.lit(1)})
    both = rows.unionByName(middles, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}
        for batch in batches:
            keys = list(zip(batch.column("_range").to_pylist(), batch.column(ENTITY).to_pylist()))
            kinds = batch.column("_kind").to_pylist()
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]] + [len(keys)]
            made: dict[str, list] = {n: [] for n in columns}
            for i, j in zip(cuts[:-1], cuts[1:]):
                if keys[i] != part:
                    part, held = keys[i], {c: Middle() for c in columns.values()}
                own = batch.slice(i, j - i)
                if kinds[i] == 0:
                    for c, x, n, base, total in zip(*(own.column(k).to_pylist() for k in ("_column", "_x", "_c", "_base", "_n"))):
                        held[c].kept.append((x, n))
                        held[c].base, held[c].n = base, total
                    continue
                for name, c in columns.items():
                    if held[c].seen is None:
                        held[c].begin(own.column("_rows")[0].as_py())
                    made[name] += held[c].medians(own.column(c).to_numpy(zero_copy_only=False).astype(float).tolist(), least)
            rows_only = batch.filter(pa.array(np.array(kinds, int) == 1)) if keys else batch
            yield pa.RecordBatch.from_arrays([*(rows_only.column(f) for f in fields), *(pa.array(made[n], pa.float64()) for n in columns)], [*fields, *columns])

    by = (ENTITY, "_range")
    ordered = both.repartition(*by).sortWithinPartitions("_range", ENTITY, "_kind", TIME)
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields] + [f"`{n}` double" for n in columns])
    return ordered.mapInArrow(run, types)


def with_long_medians(frame: DataFrame, columns: dict[str, str], least: int, slice_rows: int = MEDIAN_ROWS) -> DataFrame:
    """Adds _median_<name> and _mad_<name> for each (name, input): medians over strictly earlier rows, and of the
    distances of those rows from their own medians. Machines must be named, and inputs be doubles; missing ones and NaN
    don't count."""
    dealt = in_ranges(frame, slice_rows)
    first = with_earlier_medians(dealt, {f"_median_{n}": c for n, c in columns.items()}, least)
    away = written(first.withColumns({f"_away_{n}": F.abs(F.col(c) - F.col(f"_median_{n}")) for n, c in columns.items()}), "distances")
    return with_earlier_medians(away, {f"_mad_{n}": f"_away_{n}" for n in columns}, least).drop("_range", *(f"_away_{n}" for n in columns))
