"""Anomaly detection: reference samples, isolation forest, local outlier factor, calibration, contributing signals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import with_running
from ..functions.expressions import TINY, floor_of, holds, ratio
from ..functions.quantiles import quantiles, wide_quantiles
from ..sources.shared import written

REFERENCE_ROWS, TREES, TREE_ROWS, NEIGHBOURS = 20_000, 250, 256, 35
#: Strata whose counts may be sent to all tasks.
SENT_STRATA = 50_000
#: Components beyond this have squares that overflow; pairs of rows measured at a time.
LARGEST, MEASURED = 1e150, 1 << 14
WARNING_RATE, ALARM_RATE, LEAST_CALIBRATION = 0.05, 0.01, 20


def level_of(sizes: dict[int, int], most_rows: int) -> int:
    """The least number of rows a stratum such that all strata, each giving no more than it has, give most_rows; the
    largest size where they have fewer. sizes: how many strata have so many rows."""
    left, strata, level = most_rows, sum(sizes.values()), 0
    for size in sorted(sizes):
        if (size - level) * strata >= left:
            return level + -(-left // strata)
        left -= (size - level) * strata
        strata -= sizes[size]
        level = size
    return level


def lowest(frame: DataFrame, strata: tuple[str, ...], key: tuple[str, ...], order: Column, level: int) -> DataFrame:
    """Rows in the first `level` places of their stratum, with _place."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(order, *key))
    return frame.withColumn("_place", place).filter(F.col("_place") <= level)


def reference_sample(frame: DataFrame, strata: tuple[str, ...], key: tuple[str, ...], most_rows: int = REFERENCE_ROWS, seed: int = 42) -> DataFrame:
    """At most so many rows, balanced over strata: rows take their place in their stratum by a hash of the key, and
    first places of all strata come before second ones.

    Strata are counted, which says how many places each can give; then a stratum's rows pass only if their hash is low
    enough that they may be among these, so what is shuffled and ordered is of the sample's size and not the table's.
    Strata where that let too few through (one key on many rows, say) are ordered whole."""
    order = F.xxhash64(*key, F.lit(seed))
    counts = written(frame.groupBy(*strata).agg(F.count("*").alias("_n")), "strata")
    size = F.least(F.col("_n"), F.lit(most_rows))  # so that no more sizes than most_rows come back
    sizes = {r["size"]: r["n"] for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}
    level = level_of(sizes, most_rows)
    share = (level + 8 * level**0.5 + 16) / F.col("_n")
    small = counts.count() <= SENT_STRATA

    def of_strata(rows: DataFrame, table: DataFrame) -> DataFrame:
        named = table.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)), *(c for c in table.columns if c not in strata))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(strata)))
        return rows.join(F.broadcast(named) if small else named.hint("merge"), same).drop(*(f"_s{i}" for i in range(len(strata))))

    low = of_strata(frame, counts.withColumn("_share", share)).filter(order / float(1 << 64) + 0.5 <= F.col("_share")).drop("_share", "_n")
    places = written(lowest(low, strata, key, order, level), "places")
    given = places.groupBy(*strata).agg(F.count("*").alias("_given")).unionByName(counts.select(*strata, F.lit(0).cast("long").alias("_given")))
    given = given.groupBy(*strata).agg(F.sum("_given").alias("_given"))
    short = written(of_strata(given, counts).filter(F.col("_given") < F.least(F.col("_n"), F.lit(level))).select(*strata, F.lit(True).alias("_short")), "short-strata")
    if not short.isEmpty():
        whole = lowest(of_strata(frame, short).drop("_short"), strata, key, order, level)
        named = short.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(strata)))
        places = places.join(F.broadcast(named) if small else named.hint("merge"), same, "left_anti").unionByName(whole)
    return places.orderBy("_place", order, *key).limit(most_rows).drop("_place")


def path_constant(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(rows: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, cut, left, right, size); feature -1 is a leaf."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list = []

    def node(own: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, len(own)))
        low, high = own.min(0), own.max(0)
        open_to = np.flatnonzero(high > low)
        if depth < limit and len(own) > 1 and len(open_to):
            f = int(rng.choice(open_to))
            cut = float(rng.uniform(low[f], high[f]))
            left = own[:, f] < cut
            if left.any() and not left.all():
                a, b = node(own[left], depth + 1), node(own[~left], depth + 1)
                nodes[at] = (f, cut, a, b, len(own))
        return at

    if len(rows):
        node(rows, 0)
    return nodes


class IsolationForest:
    def __init__(self, trees: list, sample: int):
        self.trees = [tuple(np.array(c) for c in zip(*t)) for t in trees if t]
        self.sample = sample
        self.laid = [beside(*t) for t in self.trees]

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher for rows that are isolated sooner."""
        if not len(x):
            return np.zeros(0)
        total, odd = np.zeros(len(x)), np.flatnonzero(~np.isfinite(x).all(1))
        for i in range(0, len(x), BLOCK):
            total[i : i + BLOCK] = self.paths(x[i : i + BLOCK])
        total[odd] = self.paths_by_node(x[odd])
        return 2.0 ** (-total / max(len(self.trees), 1) / max(float(path_constant(self.sample)), TINY))

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Summed path lengths of finite rows: all go down a level together, and stay where they have come to a leaf."""
        total, rows, flat = np.zeros(len(x)), np.arange(len(x)), np.ascontiguousarray(x.T).ravel()
        for feature, cut, left, length, levels in self.laid:
            place, at = feature * len(x), np.zeros(len(x), np.int64)
            for _ in range(levels):
                above = flat.take(place.take(at) + rows) >= cut.take(at)
                at = left.take(at) + above
            total += length.take(at)
        return total

    def paths_by_node(self, x: np.ndarray) -> np.ndarray:
        """The same for any rows: what isn't less than a cut, NaN among it, goes to the right."""
        total = np.zeros(len(x))
        for feature, cut, left, right, size in self.trees:
            at, depth = np.zeros(len(x), int), np.zeros(len(x))
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                here = at[live]
                at[live] = np.where(x[live, feature[here]] < cut[here], left[here], right[here])
                depth[live] += 1
                live = live[feature[at[live]] >= 0]
            total += depth + path_constant(size[at])
        return total


#: Rows that go down the trees together.
BLOCK = 8192


def beside(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> tuple:
    """(feature, cut, left, path length, levels) of a tree laid out by levels, right children beside the left ones. A leaf
    is its own left child, with a cut that no finite value reaches."""
    order = [0]
    for at in order:
        if feature[at] >= 0:
            order += [int(left[at]), int(right[at])]
    place = np.empty(len(feature), np.int64)
    place[order] = np.arange(len(order))
    depth = np.zeros(len(order), np.int64)
    inner = feature[order] >= 0
    first = np.where(inner, place[left[order]], np.arange(len(order)))
    for at in np.flatnonzero(inner):
        depth[first[at]] = depth[first[at] + 1] = depth[at] + 1
    return np.where(inner, feature[order], 0), np.where(inner, cut[order], np.inf), first, depth + path_constant(size[order]), int(depth.max())


def fit_isolation_forest(frame: DataFrame, features: str, key: str, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 42) -> IsolationForest:
    """Each tree grows in a task of its own from a subsample of bounded size, drawn by hash; only nodes come back.
    `features` is an array column."""
    n = frame.count()
    if not n:
        return IsolationForest([], 1)
    chance = min(1.0, 1.5 * tree_rows / n)
    draw = F.pmod(F.xxhash64(key, "tree", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # a row joins each tree by chance: rows times trees times chance is trees * tree_rows in all, however many rows
    each = frame.select(key, features, F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(key, t, F.lit(seed)), F.lit(1 << 30)) < int(chance * (1 << 30)))).alias("tree"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(draw, key))
    drawn = each.withColumn("_place", place).filter(F.col("_place") <= tree_rows).select("tree", features)

    def grow(group: pa.Table) -> pa.Table:
        tree = group.column("tree")[0].as_py()
        rows = np.array(group.column(features).to_pylist(), float)
        nodes = grow_tree(rows, np.random.default_rng(seed + tree))
        f, c, a, b, s = zip(*nodes)
        return pa.table({"tree": pa.array([tree], pa.int32()), "feature": pa.array([list(f)], pa.list_(pa.int32())), "cut": pa.array([list(c)], pa.list_(pa.float64())), "left": pa.array([list(a)], pa.list_(pa.int32())), "right": pa.array([list(b)], pa.list_(pa.int32())), "size": pa.array([list(s)], pa.list_(pa.int32()))})

    schema = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, size array<int>"
    grown = drawn.groupBy("tree").applyInArrow(grow, schema).orderBy("tree").collect()  # trees * 2 * tree_rows nodes at most
    return IsolationForest([list(zip(r.feature, r.cut, r.left, r.right, r.size)) for r in grown], min(tree_rows, n))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed in one order whatever the shapes, so that equal rows are equally far."""
    return np.sqrt(((a - b) ** 2).sum(-1))


def usable(rows: np.ndarray) -> np.ndarray:
    """Rows whose squared distances are numbers."""
    return (np.abs(rows) < LARGEST).all(1)


class NearestRows:
    """Exact nearest neighbours among rows of a bounded number.

    Rows belong to the nearest of about sqrt(n) pivots, each of which lies furthest from those before it, and are
    sorted in their cell by the distance from it. A row at distance r from a query is, by the triangle inequality, at
    most r nearer to the pivot or further from it than the query is; with r the distance of the k-th nearest row so far,
    only that ring of each cell is compared. Comparing uses products of matrices, with a bound of their rounding, and
    what may be among the k nearest is measured again row by row. Equally far rows come in order of their places."""

    def __init__(self, rows: np.ndarray):
        home, away, pivots = np.zeros(len(rows), int), np.full(len(rows), np.inf), []
        while len(pivots) < max(len(rows) ** 0.5, 1) and len(rows) and away.max() > 0:
            at = int(away.argmax())
            d = distances(rows, rows[at])
            home[d < away] = len(pivots)
            away = np.minimum(away, d)
            pivots.append(at)
        self.place = np.lexsort((away, home))
        self.rows, self.away = np.ascontiguousarray(rows[self.place]), away[self.place]
        self.first = np.searchsorted(home[self.place], np.arange(len(pivots) + 1))
        self.pivots = rows[pivots]
        self.square = (self.rows**2).sum(1)
        self.compared = 0  # distances taken so far, pivots included

    def nearest(self, rows: np.ndarray, k: int, own: bool = False, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest rows, nearest first. own: the rows are the table itself, and none is
        its own neighbour."""
        near, distance = np.zeros((len(rows), k), int), np.zeros((len(rows), k))
        square = (rows**2).sum(1)
        error = 16 * (rows.shape[1] + 4) * np.finfo(float).eps * (square + self.square.max(initial=0))
        to = np.sqrt(np.maximum(square[:, None] + (self.pivots**2).sum(1) - 2 * rows @ self.pivots.T, 0))
        self.compared += to.size
        home = to.argmin(1)
        order = np.argsort(home, kind="stable")
        ends = np.searchsorted(home[order], np.arange(len(self.pivots) + 1))
        for c in range(len(self.pivots)):
            for i in range(ends[c], ends[c + 1], block):
                at = order[i : min(i + block, ends[c + 1])]
                near[at], distance[at] = self.nearest_of(rows[at], square[at], to[at], error[at], k, at if own else None)
        return near, distance

    def ring(self, cell: int, low: float, high: float) -> np.ndarray:
        i, j = self.first[cell], self.first[cell + 1]
        return np.arange(i + np.searchsorted(self.away[i:j], low), i + np.searchsorted(self.away[i:j], high, "right"))

    def nearest_of(self, q: np.ndarray, square: np.ndarray, to: np.ndarray, error: np.ndarray, k: int, own: np.ndarray | None):
        least, radius = self.away[self.first[:-1]], self.away[self.first[1:] - 1]
        best, seen = np.full((len(q), k), np.inf), []
        cells = np.argsort((to - radius).min(0), kind="stable")
        # the nearest cell, then the next two, four and so on, each time with the rings that are left
        for n in (1 << np.arange(len(cells).bit_length())) - 1:
            step = cells[n : 2 * n + 1]
            reach = (np.sqrt(best[:, -1] + error) + 2 * np.sqrt(error))[:, None]
            low, high = to[:, step] - reach, to[:, step] + reach
            meets = (high >= least[step]) & (low <= radius[step])
            low, high = np.where(meets, low, np.inf).min(0), np.where(meets, high, -np.inf).max(0)
            at = [self.ring(c, low[i], high[i]) for i, c in enumerate(step) if low[i] <= high[i]]
            if not at:
                continue
            asks, at = np.flatnonzero(meets.any(1)), np.concatenate(at)
            d = np.maximum(square[asks, None] + self.square[at] - 2 * q[asks] @ self.rows[at].T, 0)
            self.compared += d.size
            if own is not None:
                d[self.place[at] == own[asks, None]] = np.inf
            a, b = np.nonzero((d <= best[asks, -1:] + 2 * error[asks, None]) & (d < np.inf))
            seen.append((asks[a], at[b], d[a, b]))
            best[asks] = np.partition(np.concatenate((best[asks], d), 1), k - 1, axis=1)[:, :k]
        a, b, d = (np.concatenate(part) for part in zip(*seen))
        kept = d <= best[a, -1] + 2 * error[a]
        a, b = a[kept], b[kept]
        exact = np.concatenate([distances(q[a[i : i + MEASURED]], self.rows[b[i : i + MEASURED]]) for i in range(0, len(a), MEASURED)])
        order = np.lexsort((self.place[b], exact, a))
        taken = order[np.searchsorted(a[order], np.arange(len(q)))[:, None] + np.arange(k)]
        return self.place[b[taken]], exact[taken]


class OutlierFactor:
    """Local outlier factor against a reference of bounded size. Rows of it with a component that isn't a number are
    left out; such rows have no score, and none has one where fewer than two reference rows are left."""

    def __init__(self, reference: np.ndarray, k: int = NEIGHBOURS):
        reference = reference[usable(reference)] if reference.ndim == 2 else reference.reshape(0, 0)
        self.k, self.index = min(k, len(reference) - 1), NearestRows(reference)
        if self.k > 0:
            near, distance = self.index.nearest(reference, self.k, True)
            self.reach = distance[:, -1]
            self.density = self.local_density(near, distance)

    def local_density(self, near: np.ndarray, distance: np.ndarray) -> np.ndarray:
        return 1 / (np.maximum(distance, self.reach[near]).mean(1) + 1e-10)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Mean density of the neighbours over a row's own; larger is more anomalous."""
        out, at = np.full(len(rows), np.nan), np.flatnonzero(usable(rows))
        if self.k > 0 and len(at):
            near, distance = self.index.nearest(rows[at], self.k)
            out[at] = self.density[near].mean(1) / self.local_density(near, distance)
        return out


def fit_outlier_factor(sample: DataFrame, features: str, k: int = NEIGHBOURS) -> OutlierFactor:
    """From a reference sample of bounded size (see reference_sample)."""
    return OutlierFactor(np.array([r[0] for r in sample.select(features).collect()], float), k)


def score_with(frame: DataFrame, model, features: str, name: str = "novelty") -> DataFrame:
    """The frame with a model's scores, in Arrow tasks; the model's size does not depend on the rows scored."""
    held = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(features)
            rows = np.array(batch.column(at).to_pylist(), float)
            score = held.value.score(rows) if len(rows) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{fields}, {name} double")


def calibrate(scores: DataFrame, column: str = "novelty", least_rows: int = LEAST_CALIBRATION) -> DataFrame:
    """One row of limits from healthy scores, and the rates that they give there."""
    finite = scores.filter(F.abs(F.col(column)) < float("inf"))
    if finite.limit(least_rows).count() < least_rows:
        raise ValueError(f"fewer than {least_rows} healthy scores")
    finite = written(finite.select(column), "healthy-scores")
    limits = wide_quantiles(finite, {"_q": column}, [1 - WARNING_RATE, 1 - ALARM_RATE]).select(F.col("_q")[0].alias("warning"), F.col("_q")[1].alias("alarm"))
    over = lambda c: F.avg((F.col(column) >= F.col(c)).cast("double"))
    achieved = finite.join(F.broadcast(limits)).agg(over("warning").alias("warning_rate"), over("alarm").alias("alarm_rate"))
    return limits.join(F.broadcast(achieved))


def percentile_scores(frame: DataFrame, reference: DataFrame, column: str = "novelty") -> DataFrame:
    """Adds percentile: the share of reference scores at or below. Reference and queries are counted by value; sums
    run over the distinct values."""
    ref = reference.groupBy(column).agg(F.count("*").alias("_r"))
    asked = frame.select(column).distinct().withColumn("_r", F.lit(0).cast("long"))
    values = ref.unionByName(asked).groupBy(column).agg(F.sum("_r").alias("_r"))
    total = ref.agg(F.sum("_r").alias("_all"))  # one row
    ecdf = with_running(values, column, {"_below": F.col("_r")}).join(F.broadcast(total)).select(column, (F.col("_below") / F.col("_all")).alias("percentile"))
    return frame.join(ecdf, column)


def severity(score: Column | str, warning: Column, alarm: Column, status: Column | str | None = None) -> Column:
    """alarm, warning or normal; machines in fault or maintenance are not judged."""
    s = F.col(score) if isinstance(score, str) else score
    graded = F.when(holds(s >= alarm), "alarm").when(holds(s >= warning), "warning").otherwise("normal")
    if status is None:
        return graded
    st = F.col(status) if isinstance(status, str) else status
    return F.when(holds(st.isin("fault", "maintenance")), "not_applicable").otherwise(graded)


def feature_reference(frame: DataFrame, features: list[str]) -> DataFrame:
    """(feature, median, q1, q3)."""
    q = quantiles(frame, {c: c for c in features}, [0.25, 0.5, 0.75])
    return q.select(F.col("column").alias("feature"), F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"))


def contributing_signals(rows: DataFrame, reference: DataFrame, features: list[str], most: int = 5, least: float = 1.0) -> DataFrame:
    """(turbine_id, rank, feature, deviation): features that lie furthest from their median, in interquartile ranges."""
    long = rows.select("turbine_id", *(F.col(c).cast("double").alias(c) for c in features)).unpivot(["turbine_id"], features, "feature", "value")
    far = ratio(F.abs(F.col("value") - F.col("median")), floor_of(F.col("q3") - F.col("q1"), TINY))
    scored = long.join(F.broadcast(reference), "feature").select("turbine_id", "feature", far.alias("deviation")).filter(F.col("deviation") >= least)
    w = Window.partitionBy("turbine_id").orderBy(F.desc("deviation"), "feature")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("turbine_id", "rank", "feature", "deviation")


def recent_quality(frame: DataFrame, sensors: list[str], rows: int = 24) -> DataFrame:
    """(turbine_id, data_quality): mean share of sensors with a reading over the last rows."""
    order = Window.partitionBy("turbine_id").orderBy(F.desc("timestamp"), F.desc("ordinal"))
    there = sum((F.col(c).isNotNull().cast("int") for c in sensors), F.lit(0)) / float(len(sensors))
    last = frame.select("turbine_id", there.alias("q"), F.row_number().over(order).alias("n")).filter(F.col("n") <= rows)
    return last.groupBy("turbine_id").agg(F.avg("q").alias("data_quality"))


def select_detector(candidates: DataFrame) -> DataFrame:
    """Candidates (model, recall, pr_auc, f2, latency) in order."""
    w = Window.orderBy(F.desc("recall"), F.desc("pr_auc"), F.desc("f2"), "latency", "model")
    return candidates.withColumn("rank", F.row_number().over(w))
