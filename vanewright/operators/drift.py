"""Drift: standardised residuals, two-sided CUSUM with restart, EWMA, persistence, multivariate novelty, calibrated
thresholds that are kept as tables, reports, penalties."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.expressions import holds
from ..functions.quantiles import wide_quantiles
from ..sources.shared import written
from . import anomaly
from . import windows as W
from .slices import SLICE_ROWS

#: Fixed values.
SENSORS = ("vibration", "gearbox_temperature", "bearing_temperature", "oil_pressure", "generator_temperature")
SLACK, DECISION, LAMBDA, SIGMAS, WINDOW = 0.5, 5.0, 0.1, 3.0, 168
LEAST_PAST, LEAST_HEALTHY, HEALTHY_SCORE = 72, 500, 95.0
NOVELTY_TREES, NOVELTY_TREE_ROWS, LEAST_NOVELTY_ROWS = 200, 4096, 50
WARNING_RATIO, ALARM_RATIO, ALARM_SIGNALS, NOVELTY, NOVELTY_ALARM = 1.0, 1.6, 3.0, 0.62, 0.775
WARNING_POINTS, ALARM_POINTS, NOVELTY_POINTS, MOST_POINTS = 2.5, 5.0, 5.0, 15.0
RANK = {"none": 0, "warning": 1, "alarm": 2}

KEYS = ("turbine_id", "sensor")


def ewma_limit(weight: float = LAMBDA, sigmas: float = SIGMAS) -> float:
    return sigmas * (weight / (2 - weight)) ** 0.5


def wide_residuals(frame: DataFrame, mask: Column, sensors=SENSORS, least: int = LEAST_PAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """(turbine_id, timestamp, ordinal, a column for each sensor): each sensor against the machine's own past while the
    mask held, and the columns of `carry` as they are. Rows are dealt by machine and in order, which is what the windows ask for."""
    kept = frame.select("turbine_id", "timestamp", "ordinal", *sensors, *carry, mask.alias("_mask"))
    ordered = kept.repartition(W.ENTITY).sortWithinPartitions(W.ENTITY, W.TIME, "ordinal")
    scored = W.with_masked_z(ordered, {c: c for c in sensors}, F.col("_mask"), least)
    return scored.select("turbine_id", "timestamp", "ordinal", *(F.col(f"{c}_drift_z").alias(c) for c in sensors), *carry)


def residuals(frame: DataFrame, mask: Column, sensors=SENSORS, least: int = LEAST_PAST) -> DataFrame:
    """(turbine_id, timestamp, ordinal, sensor, z) of the same."""
    return wide_residuals(frame, mask, sensors, least).unpivot(["turbine_id", "timestamp", "ordinal"], list(sensors), "sensor", "z")


def folded(state: tuple, values: np.ndarray, slack: float, decision: float | None, weight: float) -> tuple[tuple, list, list, list]:
    """Carry (up, down, ewma) over values; a missing one changes nothing. An arm restarts after it has reached the
    decision limit and been reported."""
    up, down, mean = state
    ups, downs, means, rest = [], [], [], 1 - weight
    limit = float("inf") if decision is None else decision
    for z in values.tolist():
        if z == z:
            up = max(0.0, up + z - slack)
            down = max(0.0, down - z - slack)
            mean = z if mean is None else weight * z + rest * mean
        ups.append(up)
        downs.append(down)
        means.append(mean)
        if decision is not None:
            up = 0.0 if up >= limit else up
            down = 0.0 if down >= limit else down
    return (up, down, mean), ups, downs, means


def fold(state: tuple, values: np.ndarray, slack: float, decision: float | None, weight: float) -> tuple[tuple, list]:
    """folded() with a tuple for each value."""
    state, *made = folded(state, values, slack, decision, weight)
    return state, list(zip(*made))


class Meeting:
    """What holds after a slice of a series whatever state it began with. An arm began in [0, decision): a run from the
    decision limit that never restarts stays above every such run, so once it is 0 all of them are. The mean began
    within the values' bound: runs from both ends of it enclose every other, so once they are equal all are."""

    def __init__(self, slack: float, decision: float, weight: float, bound: float):
        self.slack, self.decision, self.weight = slack, decision, weight
        self.above, self.arm, self.met, self.low, self.high = [decision, decision], [0.0, 0.0], [False, False], -bound, bound

    def take(self, values: np.ndarray) -> None:
        w = self.weight
        for z in values.tolist():
            if z != z:
                for i in (0, 1):
                    self.arm[i] = 0.0 if self.arm[i] >= self.decision else self.arm[i]
                continue
            for i, step in ((0, z), (1, -z)):
                if self.met[i]:
                    self.arm[i] = max(0.0, (0.0 if self.arm[i] >= self.decision else self.arm[i]) + step - self.slack)
                else:
                    self.above[i] = max(0.0, self.above[i] + step - self.slack)
                    self.met[i] = self.above[i] == 0.0
            self.low, self.high = w * z + (1 - w) * self.low, w * z + (1 - w) * self.high

    def state(self) -> tuple | None:
        if not (all(self.met) and self.low == self.high):
            return None
        return (*(0.0 if a >= self.decision else a for a in self.arm), self.low)


def stretches(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[tuple, int, int]]:
    """(key, start, end) of the runs of equal keys in a batch."""
    keys = list(zip(*(batch.column(n).to_pylist() for n in names)))
    i = 0
    while i < len(keys):
        j = i + 1
        while j < len(keys) and keys[j] == keys[i]:
            j += 1
        yield keys[i], i, j
        i = j


def floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def charted(rows: DataFrame, columns: list[str], slack: float, decision: float | None, weight: float, start: bool) -> DataFrame:
    """Charts of each (series, _chain) in order; `start`: a chain begins with the state in _up, _down, _ewma, else at
    rest. A task holds one batch and one state however long a chain is."""
    by = (*KEYS, "_chain") if start else KEYS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, state = None, (0.0, 0.0, None)
        for batch in batches:
            values, made = floats(batch, "z"), []
            for key, i, j in stretches(batch, by):
                if key != series:
                    series, state = key, tuple(batch.column(c)[i].as_py() for c in ("_up", "_down", "_ewma")) if start else (0.0, 0.0, None)
                state, out = fold(state, values[i:j], slack, decision, weight)
                made += out
            up, down, mean = zip(*made) if made else ((), (), ())
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(up, pa.float64()), pa.array(down, pa.float64()), pa.array(mean, pa.float64())], [*columns, "cusum_up", "cusum_down", "ewma"])

    dealt = rows.repartition(*by).sortWithinPartitions(*by, "timestamp", "ordinal")
    schema = f"{', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in columns)}, cusum_up double, cusum_down double, ewma double"
    return dealt.mapInArrow(run, schema)


def with_chains(named: DataFrame, slack: float, decision: float, weight: float, slice_rows: int) -> DataFrame:
    """Adds _chain and the state before it: stretches of a series that can be folded side by side. Rows are dealt to
    ranges of (series, time); what each range's part of a series ends with is known where it doesn't depend on what
    came before (see Meeting), and the next part then begins a chain. Parts that don't meet, such as ones with few
    values, lengthen the chain before them."""
    ranges = max(1, -(-named.count() // slice_rows))
    dealt = named.repartitionByRange(ranges, *KEYS, "timestamp", "ordinal").withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges-of-series")
    bound = 2 * (dealt.agg(F.max(F.when(~F.isnan("z"), F.abs("z")))).first()[0] or 0.0)
    at = ("_range", *KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, meeting, out = None, None, None, []

        def close() -> None:
            if part is not None:
                known = meeting.state()
                out.append((*part, known is not None, *(known or (None,) * 3), *state))

        for batch in batches:
            values = floats(batch, "z")
            for key, i, j in stretches(batch, at):
                if key != part:
                    close()
                    part, state, meeting = key, (0.0, 0.0, None), Meeting(slack, decision, weight, bound)
                state, _ = fold(state, values[i:j], slack, decision, weight)
                meeting.take(values[i:j])
        close()
        # a row for each series in the task's ranges
        yield pa.RecordBatch.from_pylist([dict(zip(ends.names, r)) for r in out], schema=ends)

    types = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in at)
    schema = f"{types}, met boolean, up double, down double, ewma double, first_up double, first_down double, first_ewma double"
    ends = to_arrow_schema(StructType.fromDDL(schema))
    parts = written(dealt.select(*at, "timestamp", "ordinal", "z").repartition("_range").sortWithinPartitions(*at, "timestamp", "ordinal").mapInArrow(run, schema), "ends-of-parts")
    order = W.Window.partitionBy(*KEYS).orderBy("_range")
    first = F.row_number().over(order) == 1
    known = parts.withColumns({"_met": first | F.col("met")} | {f"_{c}": F.when(first, F.col(f"first_{c}")).otherwise(F.col(c)) for c in ("up", "down", "ewma")})
    begins = F.coalesce(F.lag("_met").over(order), F.lit(True))
    chains = known.withColumns({"_begins": begins.cast("int")} | {f"{c}0": F.lag(c).over(order) for c in ("_up", "_down", "_ewma")})
    chains = chains.withColumn("_chain", F.sum("_begins").over(order))
    same = W.Window.partitionBy(*KEYS, "_chain").orderBy("_range")
    state = {"_up": F.coalesce(F.first("_up0").over(same), F.lit(0.0)), "_down": F.coalesce(F.first("_down0").over(same), F.lit(0.0)), "_ewma": F.first("_ewma0").over(same)}
    chains = written(chains.select(*at, "_chain", *(x.alias(c) for c, x in state.items())), "chains")
    return dealt.join(chains.hint("merge"), list(at))


def control_charts(z: DataFrame, slack: float = SLACK, decision: float | None = DECISION, weight: float = LAMBDA, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds cusum_up, cusum_down and ewma to (turbine_id, timestamp, ordinal, sensor, z). The recursions need each
    series in order: rows are dealt by series, sorted, and folded as a stream. A series of more than slice_rows rows is
    folded in chains side by side, with the same numbers to the last bit; without a decision limit an arm has no bound
    to begin from, and a series stays one stream (see plain_cusum)."""
    named = z.select("turbine_id", "sensor", "timestamp", "ordinal", F.col("z").cast("double").alias("z"))
    columns = named.columns
    longest = 0 if decision is None else named.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= slice_rows:
        return charted(named, columns, slack, decision, weight, False)
    return charted(with_chains(named, slack, decision, weight, slice_rows), columns, slack, decision, weight, True)


def plain_sums(z: Column, slack: float, *partition: str) -> tuple[Column, Column]:
    """Running sums of what each row adds to the two arms."""
    upto = W.order(*partition).rowsBetween(W.Window.unboundedPreceding, 0)
    return tuple(F.sum(F.coalesce(x - slack, F.lit(0.0))).over(upto) for x in (z, -z))


def above_least(total: Column, *partition: str) -> Column:
    return total - F.least(F.lit(0.0), F.min(total).over(W.order(*partition).rowsBetween(W.Window.unboundedPreceding, 0)))


def plain_cusum(z: DataFrame, slack: float = SLACK) -> DataFrame:
    """The form without restart needs no recursion: a running sum less its running minimum."""
    total = z.withColumns(dict(zip(("_us", "_ds"), plain_sums(F.col("z"), slack, *KEYS))))
    return total.select("turbine_id", "sensor", "timestamp", "ordinal", above_least(F.col("_us"), *KEYS).alias("cusum_up"), above_least(F.col("_ds"), *KEYS).alias("cusum_down"))


def plain_statistics(frame: DataFrame, mask: Column, sensors=SENSORS, least: int = LEAST_PAST, slack: float = SLACK) -> DataFrame:
    """plain_cusum() of the residuals; all sensors of a machine in one pass over its rows."""
    wide = wide_residuals(frame, mask, sensors, least)
    sums = {c: plain_sums(F.col(c), slack) for c in sensors}
    wide = wide.withColumns({f"_{c}_{i}": x for c, arms in sums.items() for i, x in enumerate(arms)})
    wide = wide.withColumns({f"_{c}_{i}": above_least(F.col(f"_{c}_{i}")) for c in sensors for i in (0, 1)})
    rows = F.array(*(F.struct(F.lit(c).alias("sensor"), F.col(f"_{c}_0").alias("cusum_up"), F.col(f"_{c}_1").alias("cusum_down")) for c in sensors))
    return wide.select("turbine_id", "timestamp", "ordinal", F.inline(rows)).select("turbine_id", "sensor", "timestamp", "ordinal", "cusum_up", "cusum_down")


def with_signals(charts: DataFrame, decision: float = DECISION, rows: int = WINDOW) -> DataFrame:
    """Adds how often an arm crossed its limit over the trailing window."""
    crossed = holds((F.col("cusum_up") >= decision) | (F.col("cusum_down") >= decision)).cast("double")
    return charts.withColumn("signals", F.sum(crossed).over(W.trailing(rows, *KEYS)))


CHARTS = ("cusum_up", "cusum_down", "ewma", "signals")


def charts_pass(series: dict[str, str], slack: float = SLACK, decision: float = DECISION, weight: float = LAMBDA, window: int = WINDOW) -> W.Pass:
    """<name>_cusum_up, _cusum_down, _ewma and _signals for each of `series` (name: column of residuals), as
    control_charts() and with_signals() have them. It holds one batch and a window."""
    names = [f"{n}_{c}" for n in series for c in CHARTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, state, past = None, {}, {}
        for batch in batches:
            owner = batch.column(W.ENTITY)
            made = {n: ([], [], [], []) for n in series}
            values = {n: floats(batch, c) for n, c in series.items()}
            codes = owner.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else [0]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if machine is None or owner[i].as_py() != machine[0]:
                    machine = (owner[i].as_py(),)
                    state, past = {n: (0.0, 0.0, None) for n in series}, {n: np.zeros(window - 1) for n in series}
                for n in series:
                    state[n], ups, downs, means = folded(state[n], values[n][i:j], slack, decision, weight)
                    crossed = np.concatenate([past[n], (np.array(ups) >= decision) | (np.array(downs) >= decision)])
                    total = np.concatenate([[0.0], np.cumsum(crossed)])
                    past[n] = crossed[len(crossed) - window + 1 :]
                    for have, new in zip(made[n], (ups, downs, means, (total[window:] - total[:-window]).tolist())):
                        have += new
            yield W.with_added(batch, dict(zip(names, (pa.array(x, pa.float64()) for n in series for x in made[n]))))

    return W.Pass(names, run)


def with_charts(rows: DataFrame, series: dict[str, str], slack: float = SLACK, decision: float = DECISION, weight: float = LAMBDA, window: int = WINDOW) -> DataFrame:
    """Adds what charts_pass() makes. Rows come in order by machine and time; all series of a machine pass together, so
    they are neither stacked nor shuffled again."""
    return W.with_passes(rows, [charts_pass(series, slack, decision, weight, window)])


def longest_machine(frame: DataFrame) -> int:
    return frame.groupBy(W.ENTITY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def wide_statistics(frame: DataFrame, mask: Column, sensors=SENSORS, least: int = LEAST_PAST, rows: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """(turbine_id, timestamp, ordinal, of each sensor its residual and <sensor>_cusum_up and so on, and `carry`)."""
    return with_charts(wide_residuals(frame, mask, sensors, least, carry), {c: c for c in sensors}, window=rows)


def stacked(wide: DataFrame, sensors=SENSORS, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each sensor of what wide_statistics() returns."""
    each = F.array(*(F.struct(F.lit(c).alias("sensor"), F.col(c).alias("z"), *(F.col(f"{c}_{x}").alias(x) for x in CHARTS)) for c in sensors))
    return wide.select("turbine_id", "timestamp", "ordinal", *carry, F.inline(each)).select("turbine_id", "sensor", "timestamp", "ordinal", "z", *CHARTS, *carry)


def drift_statistics(frame: DataFrame, mask: Column, sensors=SENSORS, least: int = LEAST_PAST, rows: int = WINDOW, slice_rows: int = SLICE_ROWS, carry: tuple[str, ...] = (), whole: bool | None = None) -> DataFrame:
    """Residuals with their charts, a row for each sensor. Machines of no more than slice_rows rows pass whole (`whole`:
    whether all do; counted unless given). `carry`: columns of the frame to keep."""
    if longest_machine(frame) > slice_rows if whole is None else not whole:
        long = with_signals(control_charts(residuals(frame, mask, sensors, least), slice_rows=slice_rows), rows=rows)
        return long.join(frame.select(W.ENTITY, W.TIME, "ordinal", *carry).hint("merge"), [W.ENTITY, W.TIME, "ordinal"]).select(*long.columns, *carry) if carry else long
    return stacked(wide_statistics(frame, mask, sensors, least, rows, carry), sensors, carry)


def statistics_and_residuals(frame: DataFrame, mask: Column, sensors=SENSORS, least: int = LEAST_PAST, rows: int = WINDOW, slice_rows: int = SLICE_ROWS, carry: tuple[str, ...] = (), whole: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """drift_statistics() and its complete_residuals(), both with `carry`, from one table that is written. Where
    machines pass whole it has a row for each key, and neither needs a shuffle."""
    if longest_machine(frame) > slice_rows if whole is None else not whole:
        long = written(drift_statistics(frame, mask, sensors, least, rows, slice_rows, carry, False), "drift-statistics")
        return long, complete_residuals(long, sensors, carry)
    wide = written(wide_statistics(frame, mask, sensors, least, rows, carry), "drift-statistics")
    return stacked(wide, sensors, carry), wide.dropna(subset=list(sensors)).select("turbine_id", "timestamp", "ordinal", F.array(*sensors).alias("x"), *carry)


#: Columns of each sensor in drift_block().
BLOCK = ("z", "cusum_up", "cusum_down", "signals", "ewma")


def drift_block(frame: DataFrame, mask: Column, sensors=SENSORS, least: int = LEAST_PAST, rows: int = WINDOW, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The statistics as a wide row for each key, <sensor>_<column>."""
    keys = ("turbine_id", "timestamp", "ordinal")
    if longest_machine(frame) > slice_rows:
        long = drift_statistics(frame, mask, sensors, least, rows, slice_rows)
        return long.groupBy(*keys).agg(*(F.max(F.when(F.col("sensor") == s, F.col(c))).alias(f"{s}_{c}") for s in sensors for c in BLOCK))
    wide = wide_statistics(frame, mask, sensors, least, rows)
    return wide.select(*keys, *(F.col(s if c == "z" else f"{s}_{c}").alias(f"{s}_{c}") for s in sensors for c in BLOCK))


def complete_residuals(statistics: DataFrame, sensors=SENSORS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(turbine_id, timestamp, ordinal, x): the residuals of rows that have all of them, in the sensors' order."""
    wide = statistics.groupBy("turbine_id", "timestamp", "ordinal").agg(*(F.max(F.when(F.col("sensor") == s, F.col("z"))).alias(s) for s in sensors), *(F.max(c).alias(c) for c in carry))
    return wide.dropna(subset=list(sensors)).select("turbine_id", "timestamp", "ordinal", F.array(*sensors).alias("x"), *carry)


@dataclass
class NoveltyModel:
    """An isolation forest over residuals; its score as a probability around the median of the rows it was fitted on, so
    that a score does not depend on what else is scored."""

    forest: anomaly.IsolationForest
    middle: float
    spread: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.forest.score(x) - self.middle) / self.spread))


def fit_novelty(residuals: DataFrame, trees: int = NOVELTY_TREES, tree_rows: int = NOVELTY_TREE_ROWS) -> NoveltyModel | None:
    """From complete residuals of the training part; None with fewer than LEAST_NOVELTY_ROWS. A tree grows from at most
    tree_rows rows; the median and spread are those of all rows."""
    if residuals.limit(LEAST_NOVELTY_ROWS).count() < LEAST_NOVELTY_ROWS:
        return None
    forest = anomaly.fit_isolation_forest(residuals, "x", "ordinal", trees, tree_rows)
    return around_median(forest, written(anomaly.score_with(residuals, forest, "x").select("novelty"), "raw-novelty"))


def around_median(forest: anomaly.IsolationForest, raw: DataFrame) -> NoveltyModel:
    """The forest with median and spread of its scores of the rows it was fitted on."""
    middle = wide_quantiles(raw, {"q": "novelty"}, [0.5]).first()["q"][0]
    return NoveltyModel(forest, middle, raw.agg(F.stddev_pop("novelty")).first()[0] or 1.0)


def fitted_novelty(residuals: DataFrame, train: str, trees: int = NOVELTY_TREES, tree_rows: int = NOVELTY_TREE_ROWS) -> DataFrame | None:
    """novelty_scores() of all complete residuals by what fit_novelty() makes of those that the column `train` marks: each
    row passes the forest once, as the scores that give median and spread are kept. None with too few to fit on."""
    own = residuals.filter(F.col(train))
    if own.limit(LEAST_NOVELTY_ROWS).count() < LEAST_NOVELTY_ROWS:
        return None
    forest = anomaly.fit_isolation_forest(own, "x", "ordinal", trees, tree_rows)
    raw = written(anomaly.score_with(residuals, forest, "x").drop("x"), "raw-novelty")
    model = around_median(forest, raw.filter(F.col(train)))
    return raw.withColumn("novelty", 1 / (1 + F.exp(-(F.col("novelty") - model.middle) / model.spread)))


def novelty_scores(residuals: DataFrame, model: NoveltyModel) -> DataFrame:
    """(turbine_id, timestamp, ordinal, novelty) of complete residuals; other rows have no novelty."""
    return anomaly.score_with(residuals, model, "x").drop("x")


class TooFewHealthyRows(ValueError):
    """Not enough rows to calibrate on."""


def healthy_of(rows: DataFrame, healthy: DataFrame | str | None) -> DataFrame:
    """The rows of healthy keys; healthy: a table of them, or a column that marks them."""
    if isinstance(healthy, str):
        return rows.filter(F.col(healthy))
    return rows if healthy is None else rows.join(healthy.hint("merge"), ["turbine_id", "timestamp"], "left_semi")


def calibrate(statistics: DataFrame, healthy: DataFrame | str | None = None, least_rows: int = 0) -> DataFrame:
    """(sensor, signals_warning, signals_alarm, ewma_warning, ewma_alarm) from quantiles of healthy rows (all, those of
    a table of keys, or those that a column marks), rounded as they are kept. least_rows counts rows of telemetry."""
    rows = healthy_of(statistics, healthy)
    if least_rows:  # made once: counted, then ranked
        rows = written(rows.select("turbine_id", "timestamp", "sensor", "signals", "ewma"), "healthy-statistics")
    if least_rows and rows.select("turbine_id", "timestamp").distinct().limit(least_rows).count() < least_rows:
        raise TooFewHealthyRows(f"fewer than {least_rows} rows")
    q = wide_quantiles(rows, {"s": "signals", "e": F.abs("ewma")}, [0.95, 0.99], ["sensor"])
    sw, ew = F.greatest(F.col("s")[0], F.lit(1.0)), F.greatest(F.col("e")[0], F.lit(ewma_limit()))
    return q.select(
        "sensor", F.bround(sw, 3).alias("signals_warning"), F.bround(F.greatest(F.col("s")[1], sw + 1), 3).alias("signals_alarm"), F.bround(ew, 4).alias("ewma_warning"), F.bround(F.greatest(F.col("e")[1], 1.05 * ew), 4).alias("ewma_alarm")
    )


def calibrate_novelty(novel: DataFrame, healthy: DataFrame | str | None = None) -> DataFrame:
    """(novelty_warning, novelty_alarm) from quantiles of healthy rows that have a finite novelty, rounded as they are
    kept; no row where there is none."""
    rows = healthy_of(novel, healthy)
    q = wide_quantiles(rows.filter(F.abs("novelty") < float("inf")), {"q": "novelty"}, [0.95, 0.99])
    low, high = F.col("q")[0], F.col("q")[1]
    return q.select(F.bround(low, 6).alias("novelty_warning"), F.bround(F.greatest(low, high), 6).alias("novelty_alarm")).dropna()


#: The table of a calibration: a row for each sensor, and one for the novelty of all.
MULTIVARIATE = "multivariate"
CALIBRATION = "sensor string, signals_warning double, signals_alarm double, ewma_warning double, ewma_alarm double, novelty_warning double, novelty_alarm double"


def calibration_table(sensors: DataFrame, novelty: DataFrame | None = None) -> DataFrame:
    """Limits of sensors and of novelty as one table, a handful of rows."""
    out = sensors
    if novelty is not None:
        out = out.unionByName(novelty.withColumn("sensor", F.lit(MULTIVARIATE)), allowMissingColumns=True)
    columns = [c.split() for c in CALIBRATION.split(", ")]
    return out.select(*((F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in columns))


def save_calibration(calibration: DataFrame, path: str, version: int) -> str:
    """Keep a calibration as a version of its own; a version that is there is never written over."""
    calibration.coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")
    return path


def load_calibration(spark, path: str, version: int | None = None) -> DataFrame:
    """A kept calibration, the last version unless one is named. What serving judges by: limits as they were rounded."""
    table = spark.read.schema(f"{CALIBRATION}, version int").parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    found = table.filter(F.col("version") == version).drop("version")
    if version is None or found.isEmpty():
        raise ValueError(f"no calibration of version {version} in {path}")
    return found


def with_novelty_limits(novel: DataFrame, calibration: DataFrame | None) -> DataFrame:
    """Adds novelty_warning and novelty_alarm; the fixed ones where the calibration has none."""
    fixed = {"novelty_warning": NOVELTY, "novelty_alarm": NOVELTY_ALARM}
    if calibration is None or "novelty_warning" not in calibration.columns:
        return novel.withColumns({c: F.lit(v) for c, v in fixed.items()})
    one = calibration.filter(F.col("sensor") == MULTIVARIATE).agg(*(F.max(c).alias(c) for c in fixed))  # one row
    limits = one.select("novelty_warning", F.coalesce("novelty_alarm", "novelty_warning").alias("novelty_alarm"))
    return novel.join(F.broadcast(limits)).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fixed.items()})


def with_thresholds(statistics: DataFrame, calibration: DataFrame | None) -> DataFrame:
    """Thresholds of each row's sensor; the fixed ones where it has none."""
    fixed = {"signals_warning": 1.0, "signals_alarm": ALARM_SIGNALS, "ewma_warning": ewma_limit() * WARNING_RATIO, "ewma_alarm": ewma_limit() * ALARM_RATIO}
    if calibration is None:
        return statistics.withColumns({c: F.lit(v) for c, v in fixed.items()})
    limits = calibration.select("sensor", *fixed)
    joined = statistics.join(F.broadcast(limits), "sensor", "left")  # one row for each sensor
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fixed.items()})


def graded(statistics: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """Adds cusum_severity and ewma_severity."""
    rows = with_thresholds(statistics, calibration)
    n, e = F.col("signals"), F.abs(F.col("ewma"))
    return rows.withColumns(
        {
            "cusum_severity": F.when(holds(n < 1) | n.isNull(), "none").when(n >= F.col("signals_alarm"), "alarm").when(n >= F.col("signals_warning"), "warning").otherwise("none"),
            "ewma_severity": F.when(holds(e >= F.col("ewma_alarm")), "alarm").when(holds(e >= F.col("ewma_warning")), "warning").otherwise("none"),
        }
    )


def rank(severity: Column | str) -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    return F.when(c == "alarm", 2).when(c == "warning", 1).otherwise(0)


def drift_report(statistics: DataFrame, calibration: DataFrame | None = None, decision: float = DECISION, novel: DataFrame | None = None) -> DataFrame:
    """Signals that fired, per machine and sensor, as of each machine's last row: (turbine_id, sensor, method,
    severity, direction, statistic, first_detected). novel: (turbine_id, timestamp, novelty) of the rows that have one;
    a machine's last row then reports for the sensor `multivariate` too."""
    rows = graded(statistics, calibration)
    by = rows.groupBy(*KEYS).agg(
        F.max_by(rank("cusum_severity"), "timestamp").alias("cs"), F.max_by(rank("ewma_severity"), "timestamp").alias("es"), F.max_by("ewma", "timestamp").alias("ewma"), F.max("cusum_up").alias("up"), F.max("cusum_down").alias("down"),
        F.min(F.when(F.col("cusum_up") >= decision, F.col("timestamp"))).alias("up_at"), F.min(F.when(F.col("cusum_down") >= decision, F.col("timestamp"))).alias("down_at"),
        F.min(F.when(F.abs(F.col("ewma")) >= F.col("ewma_warning"), F.col("timestamp"))).alias("ewma_at"), F.max("timestamp").alias("last"),
    )
    by = written(by, "drift-signals")  # a row for each series: the statistics are read once, whatever they are made from
    # ranks: a text in an aggregate's buffer would have all rows sorted
    by = by.withColumns({c: F.when(F.col(c) == 2, "alarm").when(F.col(c) == 1, "warning").otherwise("none") for c in ("cs", "es")})
    upward = F.col("up") >= F.col("down")
    fired = lambda method, severity, direction, statistic, at: F.struct(F.lit(method).alias("method"), F.col(severity).alias("severity"), direction.alias("direction"), statistic.alias("statistic"), at.alias("first_detected"))
    cusum = fired("cusum", "cs", F.when(upward, "upward").otherwise("downward"), F.greatest("up", "down"), F.when(upward, F.col("up_at")).otherwise(F.col("down_at")))
    ewma = fired("ewma", "es", F.when(F.col("ewma") >= 0, "upward").otherwise("downward"), F.abs("ewma"), F.col("ewma_at"))
    report = by.select(*KEYS, F.inline(F.array(cusum, ewma))).filter("severity <> 'none'")
    if novel is None:
        return report
    last = by.groupBy("turbine_id").agg(F.max("last").alias("timestamp"))
    judged = with_novelty_limits(novel.join(last.hint("merge"), ["turbine_id", "timestamp"]), calibration)
    judged = judged.groupBy("turbine_id").agg(*(F.max(c).alias(c) for c in ("novelty", "novelty_warning", "novelty_alarm")))
    fired = judged.filter((F.abs("novelty") < float("inf")) & (F.col("novelty") >= F.col("novelty_warning")))
    severity = F.when(F.col("novelty") >= F.col("novelty_alarm"), "alarm").otherwise("warning")
    when = F.lit(None).cast(statistics.schema["timestamp"].dataType)
    return report.unionByName(fired.select("turbine_id", F.lit(MULTIVARIATE).alias("sensor"), F.lit("isolation_forest").alias("method"), severity.alias("severity"), F.lit("none").alias("direction"), F.bround("novelty", 4).alias("statistic"), when.alias("first_detected")))


def in_order(report: DataFrame) -> DataFrame:
    """Adds place: a machine's signals from 1, alarms first, then larger statistics, then by sensor and method. A machine
    has at most two signals a sensor and one more."""
    return report.withColumn("place", F.row_number().over(W.Window.partitionBy("turbine_id").orderBy(rank("severity").desc(), F.desc("statistic"), "sensor", "method")))


def points(worst: Column) -> Column:
    return F.when(worst == 2, ALARM_POINTS).when(worst == 1, WARNING_POINTS).otherwise(0.0)


def drift_penalty(report: DataFrame) -> DataFrame:
    """(turbine_id, penalty): points for each sensor's worst signal and for novelty, bounded."""
    worth = F.when(F.col("sensor") == MULTIVARIATE, NOVELTY_POINTS).otherwise(points(F.col("worst")))
    by = report.groupBy(*KEYS).agg(F.max(rank("severity")).alias("worst")).groupBy("turbine_id").agg(F.sum(worth).alias("p"))
    return by.select("turbine_id", F.least(F.col("p"), F.lit(MOST_POINTS)).alias("penalty"))


def row_penalties(statistics: DataFrame, calibration: DataFrame | None = None, novel: DataFrame | None = None) -> DataFrame:
    """(turbine_id, timestamp, ordinal, penalty) for every row; on a machine's last row the same as drift_penalty.
    novel: (turbine_id, timestamp, novelty) of the rows that have one."""
    rows = graded(statistics, calibration)
    worst = F.greatest(rank("cusum_severity"), rank("ewma_severity"))
    by = rows.groupBy("turbine_id", "timestamp", "ordinal").agg(F.sum(points(worst)).alias("p"))
    if novel is not None:
        fired = with_novelty_limits(novel, calibration).filter((F.abs("novelty") < float("inf")) & (F.col("novelty") >= F.col("novelty_warning")))
        fired = fired.select("turbine_id", "timestamp").distinct().withColumn("_novel", F.lit(NOVELTY_POINTS))
        by = by.join(fired.hint("merge"), ["turbine_id", "timestamp"], "left").withColumn("p", F.col("p") + F.coalesce("_novel", F.lit(0.0)))
    return by.select("turbine_id", "timestamp", "ordinal", F.least(F.col("p"), F.lit(MOST_POINTS)).alias("penalty"))
