"""Past-only window primitives per machine.

All of them look back over rows, in time order, within one machine. The frames share one partitioning and ordering, so
any number of them costs one shuffle and one sort.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import TINY, clip, col, floor_of, ratio
from .middles import MEDIAN_ROWS, with_long_medians

ENTITY, TIME = "turbine_id", "timestamp"
#: Rows whose windows are reduced together.
CHUNK = 2048


def order(*partition: str):
    return Window.partitionBy(*(partition or (ENTITY,))).orderBy(TIME)


def trailing(rows: int, *partition: str):
    """The last so many rows, the current one included."""
    return order(*partition).rowsBetween(-(rows - 1), 0)


def past(*partition: str):
    """All rows before the current one."""
    return order(*partition).rowsBetween(Window.unboundedPreceding, -1)


def lag(x: Column | str, n: int) -> Column:
    return F.lag(col(x), n).over(order())


def diff(x: Column | str, n: int) -> Column:
    return col(x) - lag(x, n)


def pct_change(x: Column | str, n: int, limit: float = 50.0) -> Column:
    """Relative change against max(abs(previous), 1e-6), bounded."""
    before = lag(x, n)
    return clip(ratio(col(x) - before, floor_of(F.abs(before), TINY)), -limit, limit)


STATS = {
    "mean": lambda x: F.avg(x),
    "std": lambda x: F.stddev_samp(x),
    "min": lambda x: F.min(x),
    "max": lambda x: F.max(x),
    "median": lambda x: F.percentile(x, 0.5),
    "sum": lambda x: F.sum(x),
}


def rolling(x: Column | str, rows: int, stat: str, least: int | None = None) -> Column:
    """A statistic over the last rows; missing with fewer than `least` values (half the window by default)."""
    x, frame = col(x), trailing(rows)
    least = max(rows // 2, 1) if least is None else least
    value = F.max(x).over(frame) - F.min(x).over(frame) if stat == "range" else STATS[stat](x).over(frame)
    return F.when(F.count(x).over(frame) >= least, value)


def with_position(frame: DataFrame, name: str = "_row") -> DataFrame:
    return frame.withColumn(name, F.row_number().over(order()).cast("double"))


def slope(x: Column | str, rows: int, position: str = "_row") -> Column:
    """Least-squares slope per row over the last rows, without missing values; needs half of the window, two at least."""
    x, frame = col(x), trailing(rows)
    return F.when(F.count(x).over(frame) >= max(rows // 2, 2), F.regr_slope(x, F.col(position)).over(frame))


class Trailing(NamedTuple):
    """A statistic over the last rows of a channel, for with_trailing(); `scale` is what a rate is divided by, and the
    limit of a relative change."""

    channel: str
    rows: int
    stat: str
    least: int
    scale: float = 1.0


def trailing_of(channel: str, rows: int, stat: str, least: int | None = None) -> Trailing:
    """As rolling() and slope() have it, or `off_mean`: the value less the mean."""
    return Trailing(channel, rows, stat, max(rows // 2, 2 if stat == "slope" else 1) if least is None else least)


#: Statistics of a window's first and last value alone.
ENDS = ("lag", "diff", "rate", "change")


def end_of(channel: str, n: int, stat: str, scale: float | None = None) -> Trailing:
    """As lag(), diff() and pct_change() over n rows have it, or `rate`: the difference over `scale`."""
    return Trailing(channel, n + 1, stat, 1, (50.0 if stat == "change" else 1.0) if scale is None else scale)


def shifted(x: np.ndarray, rows: int, fill: float) -> np.ndarray:
    """Each value's predecessor so many rows before; `fill` where there is none."""
    return np.concatenate([np.full(min(rows, len(x)), fill), x[: max(len(x) - rows, 0)]])


def rows_alone(x: np.ndarray, stats: set[str]) -> dict[str, np.ndarray]:
    """Moments of windows of a single row, for joined(); NaN is missing."""
    there = ~np.isnan(x)
    out = {"n": there.astype(float)}
    if stats & {"mean", "std", "off_mean", "slope"}:
        out["sum"] = np.where(there, x, 0.0)
    if "std" in stats:
        out["xx"] = np.zeros(len(x))
    if "slope" in stats:
        out |= {"at": np.where(there, np.arange(len(x), dtype=float), 0.0), "tt": np.zeros(len(x)), "tx": np.zeros(len(x))}
    if stats & {"min", "range"}:
        out["min"] = np.where(there, x, np.inf)
    if stats & {"max", "range"}:
        out["max"] = np.where(there, x, -np.inf)
    return out


def joined(b: dict[str, np.ndarray], rows: int, earlier: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Moments of the last `rows` rows joined with those of the windows `earlier` that end just before them. Spreads are
    joined by the distance of the means, so nothing cancels."""
    a = {k: shifted(v, rows, {"min": np.inf, "max": -np.inf}.get(k, 0.0)) for k, v in earlier.items()}
    out = {"n": a["n"] + b["n"]}
    if "sum" in b:
        out["sum"] = a["sum"] + b["sum"]
    if "xx" in b or "tt" in b:
        size = np.maximum(out["n"], 1.0)
        weight = a["n"] * b["n"] / size
        apart = b["sum"] / np.maximum(b["n"], 1.0) - a["sum"] / np.maximum(a["n"], 1.0)
        if "xx" in b:
            out["xx"] = a["xx"] + b["xx"] + apart * apart * weight
        if "tt" in b:
            away = b["at"] - a["at"]
            out["at"] = np.where(a["n"] > 0, a["at"] + away * (b["n"] / size), b["at"])
            out["tt"] = a["tt"] + b["tt"] + away * away * weight
            out["tx"] = a["tx"] + b["tx"] + away * apart * weight
    if "min" in b:
        out["min"] = np.minimum(a["min"], b["min"])
    if "max" in b:
        out["max"] = np.maximum(a["max"], b["max"])
    return out


def trailing_moments(x: np.ndarray, sizes: dict[int, set[str]]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(rows, moments of the last so many rows at every place) of each size: windows of 1, 2, 4, ... rows are joined from
    two halves, and every size from those, so a value costs the logarithm of the longest window."""
    if not sizes:
        return
    every = set().union(*sizes.values())
    block, width, done = rows_alone(x, every), 1, {}
    longest = max(sizes)
    while width <= longest:
        for rows in sizes:
            if rows & width:
                done[rows] = joined(done[rows], rows & (width - 1), block) if rows in done else block
                if rows < 2 * width:
                    yield rows, done.pop(rows)
        width *= 2
        if width <= longest:
            block = joined(block, width // 2, block)


def trailing_statistics(x: np.ndarray, moments: dict[str, np.ndarray], stats: set[str]) -> dict[str, np.ndarray]:
    """Statistics of trailing windows by their moments."""
    size, out = np.maximum(moments["n"], 1.0), {}
    if stats & {"mean", "off_mean"}:
        out["mean"] = moments["sum"] / size
        out["off_mean"] = x - out["mean"]
    if "std" in stats:
        out["std"] = np.where(moments["n"] > 1, np.sqrt(moments["xx"] / np.maximum(moments["n"] - 1, 1.0)), np.nan)
    if "slope" in stats:
        spread = moments["tt"]
        out["slope"] = np.where(spread > 0, moments["tx"] / np.where(spread > 0, spread, 1.0), np.nan)
    for s in stats & {"min", "max"}:
        out[s] = moments[s]
    if "range" in stats:
        out["range"] = moments["max"] - moments["min"]
    return out


def trailing_medians(x: np.ndarray, rows: int, spot: np.ndarray) -> np.ndarray:
    """The medians of the last so many rows at these places; NaN is missing."""
    views, out = np.lib.stride_tricks.sliding_window_view(x, rows), np.empty(len(spot))
    for i in range(0, len(out), CHUNK):
        ordered = np.sort(views[spot[i : i + CHUNK] - rows + 1], axis=1)  # NaN last
        size, at = np.maximum((~np.isnan(ordered)).sum(1), 1), np.arange(len(ordered))
        out[i : i + CHUNK] = (ordered[at, (size - 1) // 2] + ordered[at, size // 2]) / 2
    return out


def ends_of_windows(x: np.ndarray, there: np.ndarray, spot: np.ndarray, spec: Trailing) -> pa.Array:
    """A statistic of ENDS at these places; `there` marks values that aren't missing (NaN is one)."""
    first = spot - (spec.rows - 1)
    if spec.stat == "lag":
        return pa.array(x[first], mask=~there[first])
    made = x[spot] - x[first]
    if spec.stat == "rate":
        made /= spec.scale
    if spec.stat == "change":
        size = np.abs(x[first])
        made /= np.where(size < TINY, TINY, size)
        # NaN is above every limit
        made = np.where(np.isnan(made), spec.scale, np.clip(made, -spec.scale, spec.scale))
    return pa.array(made, mask=~(there[spot] & there[first]))


class Pass(NamedTuple):
    """A step over batches of rows in order by machine and time: run() adds the columns `added`, all doubles."""

    added: list[str]
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def with_added(batch: pa.RecordBatch, made: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])


def with_passes(frame: DataFrame, passes: Iterable[Pass], drop: Iterable[str] = ()) -> DataFrame:
    """The columns of these passes, each of which may read what those before it added, without the columns `drop`. The
    rows are in order by machine and time already. All passes of a task share one Python process, and rows go there
    and back once, however many passes."""
    passes, gone = list(passes), set(drop)
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields} | {n: "double" for p in passes for n in p.added}
    kept = [n for n in kinds if n not in gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in passes:
            batches = p.run(batches)
        for batch in batches:
            yield batch.select(kept)

    return frame.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in kept)) if passes else frame.drop(*gone)


def made_pass(made: dict[str, Callable[..., np.ndarray]], of: dict[str, tuple[str, ...]]) -> Pass:
    """Columns made of others row by row: of[name] names what made[name] gets; NaN is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: floats(batch, c) for c in {c for names in of.values() for c in names}}
            with np.errstate(invalid="ignore"):
                yield with_added(batch, {n: pa.array(f(*(values[c] for c in of[n])), pa.float64(), from_pandas=True) for n, f in made.items()})

    return Pass(list(made), run)


def floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def codes_of(column: pa.Array) -> tuple[np.ndarray, list]:
    """Numbers of a column's distinct values, and these."""
    found = column.dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def trailing_pass(block: dict[str, Trailing], lane: str | None = None) -> Pass:
    """Many trailing statistics at once: each machine's rows pass once, in order, and all windows of a batch are reduced
    together. It holds one batch and the last rows of one machine. `lane`: a column of few values, each of which has
    windows of its own; the rows of all of them come in order of time."""
    wanted: dict[str, dict[int, list[str]]] = {}
    ends: dict[str, list[str]] = {}
    for n, t in block.items():
        if t.stat in ENDS:
            ends.setdefault(t.channel, []).append(n)
        else:
            wanted.setdefault(t.channel, {}).setdefault(t.rows, []).append(n)
    lead = max((t.rows for t in block.values()), default=1) - 1
    channels = list(dict.fromkeys(t.channel for t in block.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, before = (), {}
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            codes, owners = codes_of(batch.column(ENTITY))
            lanes, names = codes_of(batch.column(lane)) if lane else (np.zeros(size, np.int64), [None])
            same = machine == (owners[codes[0]],)
            # a part is the rows of a machine and lane; missing values between parts, so that no window reaches from
            # one into the next
            owner = np.cumsum(np.concatenate([[0], np.diff(codes) != 0]))
            key = owner * len(names) + lanes
            order = np.argsort(key, kind="stable") if lane else np.arange(size)
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            begins = first + lead * (1 + np.arange(len(first)))
            finishes = np.append(begins[1:] - lead, size + lead * len(first))
            spot = np.empty(size, np.int64)
            spot[order] = np.arange(size) + lead * np.repeat(1 + np.arange(len(first)), np.diff(np.append(first, size)))
            parts = [(names[lanes[order[i]]], int(owner[order[i]]), j, k) for i, j, k in zip(first, begins, finishes)]
            goes_on = [(n, j) for n, at, j, _ in parts if at == 0 and same and n in before]
            last = [(n, k) for n, at, _, k in parts if at == owner[-1]]
            kept = before if same and owner[-1] == 0 else {}
            held = {n: {} for n, _ in last}
            made: dict[str, pa.Array] = {}
            for c in channels:
                x, there = np.full(size + lead * len(first), np.nan), np.zeros(size + lead * len(first), bool)
                for n, j in goes_on:
                    x[j - lead : j], there[j - lead : j] = before[n][c]
                x[spot], there[spot] = floats(batch, c), batch.column(c).is_valid().to_numpy(zero_copy_only=False)
                for n, k in last:
                    held[n][c] = x[k - lead : k].copy(), there[k - lead : k].copy()
                with np.errstate(all="ignore"):
                    for n in ends.get(c, ()):
                        made[n] = ends_of_windows(x, there, spot, block[n])
                    windows = wanted.get(c, {})
                    for rows, moments in trailing_moments(x, {r: {block[n].stat for n in some} for r, some in windows.items()}):
                        some = windows[rows]
                        count = moments["n"][spot]
                        values = trailing_statistics(x, moments, {block[n].stat for n in some} - {"median"})
                        for n in some:
                            found = trailing_medians(x, rows, spot) if block[n].stat == "median" else values[block[n].stat][spot]
                            made[n] = pa.array(np.where(count >= block[n].least, found, np.nan), pa.float64(), from_pandas=True)
            machine, before = (owners[codes[-1]],), kept | held
            yield with_added(batch, {n: made[n] for n in block})

    return Pass(list(block), run)


def with_trailing(frame: DataFrame, block: dict[str, Trailing], dealt: bool = False) -> DataFrame:
    """Adds many trailing statistics at once. A sliding window aggregate goes over its frame again for every row and
    column; see trailing_pass(). `dealt`: the rows are in order by machine and time already."""
    rows = frame if dealt else frame.repartition(ENTITY).sortWithinPartitions(ENTITY, TIME)
    return with_passes(rows, [trailing_pass(block)])


def with_columns(frame: DataFrame, block: dict[str, Column | Trailing]) -> DataFrame:
    """Adds a block: plain columns first, while rows are narrow, then trailing statistics."""
    plain = {n: x for n, x in block.items() if not isinstance(x, Trailing)}
    rest = {n: x for n, x in block.items() if isinstance(x, Trailing)}
    frame = frame.withColumns(plain) if plain else frame
    return with_trailing(frame, rest) if rest else frame


def expanding(x: Column | str, stat: str, least: int, *partition: str) -> Column:
    """A statistic over strictly earlier rows; missing with fewer than `least` values."""
    x, frame = col(x), past(*partition)
    return F.when(F.count(x).over(frame) >= least, STATS[stat](x).over(frame))


def past_medians(values: list, state: tuple[list, list], least: int) -> tuple[list, list]:
    """For each value the median of those before it, and the median of their distances from the medians before them.
    State: the values so far and their distances, each sorted. Missing values (NaN) count in neither."""
    seen, away = state
    medians, spreads = [], []
    for x in values:
        n, m = len(seen), len(away)
        mid = (seen[(n - 1) // 2] + seen[n // 2]) / 2 if n >= least else None
        medians.append(mid)
        spreads.append((away[(m - 1) // 2] + away[m // 2]) / 2 if m >= least else None)
        if x == x:
            insort(seen, x)
            if mid is not None:
                insort(away, abs(x - mid))
    return medians, spreads


def medians_pass(columns: dict[str, str], least: int) -> Pass:
    """_median_<name> and _mad_<name> of each (name, input) over strictly earlier rows: values go into sorted lists, so it
    holds the floats of one machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, state = None, {}
        for batch in batches:
            owner = batch.column(ENTITY).to_pylist()
            cuts = [0, *(i for i in range(1, len(owner)) if owner[i] != owner[i - 1]), len(owner)] if owner else [0]
            made = {n: ([], []) for n in columns}
            values = {n: floats(batch, c).tolist() for n, c in columns.items()}
            for i, j in zip(cuts[:-1], cuts[1:]):
                if owner[i] != machine:
                    machine, state = owner[i], {n: ([], []) for n in columns}
                for n in columns:
                    for have, new in zip(made[n], past_medians(values[n][i:j], state[n], least)):
                        have += new
            yield with_added(batch, {f"_{k}_{n}": pa.array(x, pa.float64()) for n in columns for k, x in zip(("median", "mad"), made[n])})

    return Pass([f"_{k}_{n}" for n in columns for k in ("median", "mad")], run)


def with_medians(frame: DataFrame, columns: dict[str, Column | str], least: int, slice_rows: int = MEDIAN_ROWS, then: Iterable[Pass] = (), drop: Iterable[str] = ()) -> DataFrame:
    """Adds _median_<name> and _mad_<name> over strictly earlier rows. A percentile window sorts its whole frame again
    for every row; here each machine's rows pass once, in order (see medians_pass). Where a machine has more than
    slice_rows rows, all are built in slices (see middles). `then`: further passes over the same rows, of whose columns,
    and the frame's, `drop` are left out."""
    names, then, drop = list(columns), list(then), set(drop)
    inputs = frame.withColumns({f"_in_{n}": col(x).cast("double") for n, x in columns.items()})
    longest = frame.groupBy(ENTITY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest > slice_rows:
        long = with_long_medians(inputs, {n: f"_in_{n}" for n in names}, least, slice_rows)
        long = long.select(*frame.columns, *(f"_{k}_{n}" for n in names for k in ("median", "mad")))
        return with_passes(long.repartition(ENTITY).sortWithinPartitions(ENTITY, TIME), then, drop)  # dealt as below, which callers rely on
    dealt = inputs.repartition(ENTITY).sortWithinPartitions(ENTITY, TIME)
    return with_passes(dealt, [medians_pass({n: f"_in_{n}" for n in names}, least), *then], {f"_in_{n}" for n in names} | drop)


def robust_z(x: Column | str, name: str, floor: float = TINY) -> Column:
    """(x - median) / max(1.4826 * median absolute deviation, floor), by the columns of with_medians."""
    return ratio(col(x) - F.col(f"_median_{name}"), floor_of(1.4826 * F.col(f"_mad_{name}"), floor))


def with_robust_z(frame: DataFrame, columns: dict[str, Column | str], least: int, floor: float = TINY, suffix: str = "_z") -> DataFrame:
    """Robust z scores against strictly earlier rows; `columns` maps names to inputs."""
    out = with_medians(frame, columns, least).withColumns({f"{n}{suffix}": robust_z(x, n, floor) for n, x in columns.items()})
    return out.drop(*(f"_{kind}_{n}" for n in columns for kind in ("median", "mad")))


def with_masked_z(frame: DataFrame, columns: dict[str, Column | str], mask: Column, least: int, *partition: str, suffix: str = "_drift_z") -> DataFrame:
    """(x - mean) / max(std, 1e-6) with mean and std over earlier rows where the mask holds, scored on every row."""
    masked = {n: F.when(mask, col(x)) for n, x in columns.items()}
    scores = {
        f"{n}{suffix}": ratio(col(columns[n]) - expanding(m, "mean", least, *partition), floor_of(expanding(m, "std", least, *partition), TINY)) for n, m in masked.items()
    }
    return frame.withColumns(scores)


def future_change(before: DataFrame, after: DataFrame, features: list[str], key: tuple[str, ...] = (ENTITY, TIME)) -> DataFrame:
    """Leakage check: keys of rows whose features differ between two builds, by null-safe comparison."""
    changed = F.lit(False)
    joined = before.alias("x").join(after.alias("y"), list(key))
    for c in features:
        changed = changed | ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return joined.filter(changed).select(*key)
