"""Cleaning: keys, impossible values, gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import half_even_steps
from ..functions.quantiles import SENT_GROUPS, wide_quantiles
from ..sources.shared import written
from ..sources.telemetry import RANGES, SENSORS, micros
from .slices import SLICE_ROWS
from .windows import ENTITY, TIME, order

#: Slow channels that may be carried forward, and for how many rows.
CARRIED = ("generator_temperature", "gearbox_temperature", "bearing_temperature", "oil_temperature", "nacelle_temperature", "ambient_temperature", "brake_temperature", "oil_pressure", "hydraulic_pressure")
CARRY_ROWS = 3


class NoStep(ValueError):
    """No machine has two different times."""


def step_hours(frame: DataFrame) -> DataFrame:
    """One row: the median positive distance of a machine's times, in hours."""
    t = frame.select(ENTITY, micros(TIME).alias("t"))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(ENTITY).orderBy("t"))
    found = wide_quantiles(t.select(gap.alias("gap")).filter("gap > 0"), {"gap": "gap"}, [0.5])
    return found.select((F.col("gap")[0] / 3.6e9).alias("step_hours"))


def infer_step(frame: DataFrame) -> float:
    found = step_hours(frame).first()[0]
    if found is None:
        raise NoStep("no machine has two different times")
    return found


def steps(hours: float, frame: DataFrame | None = None, step: float | None = None) -> int:
    return half_even_steps(hours, step if step is not None else infer_step(frame))


def passes_whole(frame: DataFrame, slice_rows: int = SLICE_ROWS) -> bool:
    """Whether no machine has more than slice_rows rows, so that a task may hold one."""
    return (frame.groupBy(ENTITY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= slice_rows


def normalise_keys(frame: DataFrame, together: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per (machine, time): the first to arrive. Rows without a key go. `together`: rows are dealt by machine
    where none has more than slice_rows, so that windows by machine which follow need no shuffle of their own."""
    first = Window.partitionBy(ENTITY, TIME).orderBy("ordinal")
    keyed = frame.filter(F.col(ENTITY).isNotNull() & F.col(TIME).isNotNull())
    if together and passes_whole(keyed, slice_rows):
        keyed = keyed.repartition(ENTITY)
    return keyed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def key_counts(frame: DataFrame) -> DataFrame:
    """One row: input, dropped_missing_keys, dropped_duplicates, output. Keys are counted before the sum, so the
    shuffle carries one row per key and task."""
    valid = F.col(ENTITY).isNotNull() & F.col(TIME).isNotNull()
    by_key = frame.groupBy(valid.alias("ok"), F.when(valid, F.col(ENTITY)).alias("e"), F.when(valid, F.col(TIME)).alias("t")).agg(F.count("*").alias("n"))
    total = by_key.agg(F.sum("n").alias("input"), F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).alias("dropped_missing_keys"), F.sum(F.when(F.col("ok"), F.col("n") - 1).otherwise(0)).alias("dropped_duplicates"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return total.select(*(zero(c).alias(c) for c in total.columns), (zero("input") - zero("dropped_missing_keys") - zero("dropped_duplicates")).alias("output"))


def in_range(c: str) -> Column:
    low, high = RANGES[c]
    return F.when(F.col(c).between(low, high), F.col(c))


def mask_invalid(frame: DataFrame, sensors=SENSORS) -> DataFrame:
    """Readings out of their physical range become missing."""
    return frame.withColumns({c: in_range(c) for c in sensors})


def invalid_counts(frame: DataFrame, sensors=SENSORS) -> DataFrame:
    """(sensor, n): readings out of range, for every sensor, in one pass."""
    counts = frame.agg(*(F.count_if(~F.col(c).between(*RANGES[c])).alias(c) for c in sensors))
    return counts.unpivot([], list(sensors), "sensor", "n")


def fill_by_machine(frame: DataFrame, sensors=SENSORS, carried=CARRIED, carry_rows: int = CARRY_ROWS) -> DataFrame:
    """Slow channels are carried forward a few rows, then missing readings become the machine's exact median of the
    column; they stay missing where a machine has none, or where the machine itself is missing. A task holds one machine
    and a batch, and looks only at columns that miss something."""
    frame = frame.withColumns({c: F.col(c).cast("double") for c in sensors})
    names, schema = frame.columns, frame.schema
    # what the window asks for: a machine's rows together and in order
    placed = frame.withColumn("_place", F.row_number().over(order()))

    def filled(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        owner = whole.column(ENTITY).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = owner.indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1))
        ends = [*starts[1:].tolist(), len(codes)]
        known = [owner.dictionary[k].is_valid for k in codes[starts].tolist()]
        columns = {n: whole.column(n).combine_chunks() for n in names}
        for c in sensors:
            if not columns[c].null_count:
                continue
            missing = pc.is_null(columns[c]).to_numpy(zero_copy_only=False).copy()
            x = columns[c].fill_null(0.0).to_numpy(zero_copy_only=False).copy()
            if c in carried:
                at = np.arange(len(x))
                last = np.maximum.accumulate(np.where(missing, -1, at))
                near = missing & (last >= np.maximum(at - carry_rows, np.repeat(starts, np.diff([*starts, len(x)]))))
                x[near], missing[near] = x[last[near]], False
            for k in np.flatnonzero(np.add.reduceat(missing, starts, dtype=np.int64)).tolist():
                i, j = starts[k], ends[k]
                hole = missing[i:j].copy()
                have = np.sort(x[i:j][~hole])  # NaN is greater than any number
                if known[k] and len(have):
                    low, high = have[(len(have) - 1) // 2], have[len(have) // 2]
                    x[i:j][hole] = low if low == high else 0.5 * low + 0.5 * high
                    missing[i:j] = False
            columns[c] = pa.array(x, mask=missing)
        yield from pa.Table.from_arrays([columns[n] for n in names], names=names).to_batches(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the machine that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            owner = batch.column(names.index(ENTITY)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            changes = np.flatnonzero(np.diff(owner)) + 1
            last = int(changes[-1]) if len(changes) else 0
            if held and (last or held[-1].column(names.index(ENTITY))[0].as_py() != batch.column(names.index(ENTITY))[0].as_py()):
                yield from filled([*held, batch.slice(0, last)] if last else held)
                held = []
            elif last:
                yield from filled([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield from filled(held)

    return placed.mapInArrow(run, schema)


def fill_by_joins(frame: DataFrame, sensors=SENSORS, carried=CARRIED, carry_rows: int = CARRY_ROWS) -> DataFrame:
    """The same with medians from a table of machines, however many rows one has."""
    back = order().rowsBetween(-carry_rows, 0)
    frame = frame.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in carried if c in sensors})
    frame = written(frame, "carried-forward")
    middles = {f"_own_{c}": c for c in sensors}
    own = written(wide_quantiles(frame, middles, [0.5], [ENTITY]), "machine-medians")  # a row for each machine
    frame = frame.join(F.broadcast(own) if own.count() <= SENT_GROUPS else own.hint("merge"), ENTITY, "left")
    return frame.withColumns({c: F.coalesce(F.col(c), F.col(f"_own_{c}")[0]) for c in sensors}).drop(*middles)


def fill_gaps(frame: DataFrame, sensors=SENSORS, carried=CARRIED, carry_rows: int = CARRY_ROWS, slice_rows: int = SLICE_ROWS, whole: bool | None = None) -> DataFrame:
    """Carry slow channels forward a few rows, then each machine's median, then the fleet's, then 0. A missing status
    is normal. `whole`: whether no machine has more than slice_rows rows (counted unless given). The fleet's median is
    taken of columns alone that a machine has no reading of."""
    whole = passes_whole(frame, slice_rows) if whole is None else whole
    frame = written((fill_by_machine if whole else fill_by_joins)(frame, sensors, carried, carry_rows), "filled-by-machine")
    left = frame.agg(*(F.count(c).alias(c) for c in sensors), F.count("*").alias("rows")).first()
    bare = [c for c in sensors if left[c] < left["rows"]]
    if bare:
        fleet = wide_quantiles(frame, {f"_fleet_{c}": c for c in bare}, [0.5])  # one row
        frame = frame.join(F.broadcast(fleet))
        frame = frame.withColumns({c: F.coalesce(F.col(c), F.col(f"_fleet_{c}")[0], F.lit(0.0)) for c in bare}).drop(*(f"_fleet_{c}" for c in bare))
    return frame.withColumn("operational_status", F.coalesce("operational_status", F.lit("normal"))) if "operational_status" in frame.columns else frame


def preprocess(frame: DataFrame, sensors=SENSORS) -> DataFrame:
    whole = passes_whole(frame.filter(F.col(ENTITY).isNotNull()))
    return fill_gaps(mask_invalid(normalise_keys(frame, together=whole), sensors), sensors, whole=whole)
