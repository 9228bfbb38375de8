"""The drift monitor as a stream: control charts of every (machine, sensor) series, carried as state.

monitor_in_order() waits for stragglers: rows are held until the watermark has passed them, then folded in time order, so
a stream whose rows arrive in any order within the delay gives what the batch operator gives. Its state is three
numbers, and the rows of the delay. monitor() answers at once:

The state of a series is three numbers and the time of its last row. Rows of a micro-batch are folded in time order, so
a stream that arrives in order gives what the batch operator gives on the same rows. Rows older than the last one of
their series come too late and are counted, not folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.drift import DECISION, LAMBDA, SLACK, fold

STATE = "up double, down double, ewma double, last timestamp, late long"
OUTPUT = "turbine_id string, sensor string, timestamp timestamp, ordinal long, z double, cusum_up double, cusum_down double, ewma double, late long"


def monitor(z: DataFrame, slack: float = SLACK, decision: float | None = DECISION, weight: float = LAMBDA) -> DataFrame:
    """A streaming frame (turbine_id, sensor, timestamp, ordinal, z) -> its rows with charts."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, mean, last, late = state.get if state.exists else (0.0, 0.0, None, None, 0)
        rows = pd.concat(list(frames)).sort_values(["timestamp", "ordinal"], kind="stable")
        if last is not None:
            early = rows["timestamp"] < pd.Timestamp(last)
            late += int(early.sum())
            rows = rows[~early]
        (up, down, mean), made = fold((up, down, mean), rows["z"].to_numpy(float), slack, decision, weight)
        if len(rows):
            last = rows["timestamp"].iloc[-1].to_pydatetime()
        state.update((up, down, None if mean is None else float(mean), last, late))
        charts = np.array([[a, b, np.nan if m is None else m] for a, b, m in made], float).reshape(-1, 3)
        yield rows[["turbine_id", "sensor", "timestamp", "ordinal", "z"]].assign(cusum_up=charts[:, 0], cusum_down=charts[:, 1], ewma=charts[:, 2], late=late)

    return z.groupBy("turbine_id", "sensor").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


HELD = "up double, down double, ewma double, last long, times array<long>, ordinals array<long>, values array<double>"
IN_ORDER = "turbine_id string, sensor string, timestamp timestamp, ordinal long, z double, cusum_up double, cusum_down double, ewma double"


def monitor_in_order(z: DataFrame, delay: str, idle_hours: float | None = None, slack: float = SLACK, decision: float | None = DECISION, weight: float = LAMBDA) -> DataFrame:
    """A streaming frame (turbine_id, sensor, timestamp, ordinal, z) -> its rows with charts, once the watermark, which
    trails the latest time by `delay`, has passed them. A row that comes later still takes its place if no row of its
    series as late has been folded, else it is left out (here, or by Spark, which counts it in its progress); so are rows
    without a time.
    Where two rows of a series are more than idle_hours apart its charts begin anew, and its state is given up when the
    watermark has come so far; None keeps it."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, mean, last, times, ordinals, values = state.get if state.exists else (0.0, 0.0, None, None, [], [], [])
        micros = lambda t: pd.Series(t).astype("datetime64[us]").astype("int64")
        parts = [pd.DataFrame({"t": pd.Series(list(times), dtype="int64"), "o": pd.Series(list(ordinals), dtype="int64"), "z": pd.Series(list(values), dtype=float)})]
        parts += [pd.DataFrame({"t": micros(f["timestamp"]).to_numpy(), "o": f["ordinal"].to_numpy(), "z": f["z"].to_numpy(float)}) for f in frames if len(f)]
        if last is not None:
            parts[1:] = [p[p["t"] > last] for p in parts[1:]]
        rows = pd.concat([p for p in parts if len(p)] or parts[:1]).sort_values(["t", "o"], kind="stable")
        mark = state.getCurrentWatermarkMs()
        ready = rows["t"] <= mark * 1000
        out, kept = rows[ready], rows[~ready]
        made: list = []
        at, idle = out["t"].to_numpy(), None if idle_hours is None else int(idle_hours * 3_600_000_000)
        # charts begin anew after a gap, whether or not the state was given up in between
        gaps = [] if idle is None else np.flatnonzero(np.diff(at, prepend=at[:1] if last is None else last) > idle).tolist()
        for i, j in zip([0, *gaps], [*gaps, len(at)]):
            if i in gaps:
                up, down, mean = 0.0, 0.0, None
            (up, down, mean), part = fold((up, down, mean), out["z"].to_numpy(float)[i:j], slack, decision, weight)
            made += part
        if len(out):
            last = int(at[-1])
        wake = None
        if len(kept):
            wake = -(-int(kept["t"].iloc[0]) // 1000)
        elif idle_hours is not None and last is not None:
            wake = last // 1000 + int(idle_hours * 3_600_000) + 1
        if wake is not None and not len(kept) and wake <= mark:
            state.remove()
        else:
            held = kept["z"].tolist()
            state.update((up, down, None if mean is None else float(mean), last, kept["t"].tolist(), kept["o"].tolist(), held))
            if wake is not None:
                state.setTimeoutTimestamp(max(wake, mark + 1))
        charts = np.array([[a, b, np.nan if m is None else m] for a, b, m in made], float).reshape(-1, 3)
        # times cross as UTC, as Spark's session would write them
        yield pd.DataFrame({"turbine_id": [key[0]] * len(out), "sensor": [key[1]] * len(out), "timestamp": pd.to_datetime(out["t"].to_numpy(), unit="us"), "ordinal": out["o"].to_numpy("int64"), "z": out["z"].to_numpy(float), "cusum_up": charts[:, 0], "cusum_down": charts[:, 1], "ewma": charts[:, 2]})

    timed = z.filter("timestamp is not null").withWatermark("timestamp", delay)
    return timed.groupBy("turbine_id", "sensor").applyInPandasWithState(run, IN_ORDER, HELD, "append", GroupStateTimeout.EventTimeTimeout)
