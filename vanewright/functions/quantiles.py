"""Exact quantiles of many columns at once, by distributed selection.

An exact percentile aggregate keeps every distinct value of a group in one task. Here a first pass takes approximate
quantiles (a mergeable sketch of bounded size) just below and above each wanted one; between these two lies the wanted
rank, and about a 1,250th of all rows. A second pass counts what lies below, as one number, and every distinct value in
between. Ranks are then found by running sums: by a window a group where these rows are few, else over ranges of the
values, of which each starts with what the ranges before it hold. Where a sketch should not have enclosed a rank, the pass is
repeated for that group without bounds. No task holds more than a sketch or a range. Where no group has more than
SMALL_GROUP values, which is counted first, the exact aggregate itself is bounded and is taken.

Values are interpolated between neighbouring ranks, as SQL's continuous quantiles are. Missing values don't count;
NaN is greater than any number; a group without values, or a null group, has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .ordered import FEW_ROWS, with_grouped_running

#: Relative accuracy of the sketch is 1 / ACCURACY of a group's rows; bounds lie twice as far from the wanted rank.
ACCURACY = 5_000
#: Values of a group that one buffer may hold.
SMALL_GROUP = 50_000
#: Groups that may be sent to all tasks.
SENT_GROUPS = 50_000


def long_values(frame: DataFrame, columns: dict[str, Column | str], by: list[str]) -> DataFrame:
    """(by..., column, x) of the values that are there."""
    pairs = [F.struct(F.lit(n).alias("column"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("x")) for n, c in columns.items()]
    return frame.select(*by, F.explode(F.array(*pairs)).alias("_v")).select(*by, "_v.column", "_v.x").filter("x is not null")


def bounds_of(values: DataFrame, ps: list[float], by: list[str]) -> DataFrame:
    """(by..., column, n, low[], high[]) for each of ps."""
    finite = F.when(F.isnan("x"), F.lit(float("inf"))).otherwise(F.col("x"))
    step = 2 / ACCURACY
    asked = [min(max(q, 0.0), 1.0) for p in ps for q in (p - step, p + step)]
    found = values.groupBy(*by, "column").agg(F.count("*").alias("n"), F.percentile_approx(finite, asked, ACCURACY).alias("q"))
    at = lambda odd: F.array(*(F.col("q")[2 * i + odd] for i in range(len(ps))))
    return found.select(*by, "column", "n", at(0).alias("low"), at(1).alias("high"))


def counted(values: DataFrame, bounds: DataFrame, ps: list[float], by: list[str], few: bool) -> DataFrame:
    """(by..., column, at, x, c): how often each value between the bounds of the quantile `at` occurs; x null: all values
    below them."""
    keys = [*by, "column"]
    met = values.join(F.broadcast(bounds) if few else bounds.hint("merge"), keys)
    x = F.col("x")
    low, high = [F.col("low")[i] for i in range(len(ps))], [F.col("high")[i] for i in range(len(ps))]
    # below: a number for each quantile; only the few values in between become rows
    sums = met.groupBy(*keys).agg(*(F.count_if(x < a).alias(f"_{i}") for i, a in enumerate(low)))
    below = sums.select(*keys, F.inline(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(None).cast("double").alias("x"), F.col(f"_{i}").alias("c")) for i in range(len(ps)))))).filter("c > 0")
    within = [(x >= a) & ((x <= b) | (b == float("inf"))) for a, b in zip(low, high)]
    some = within[0]
    for more in within[1:]:
        some = some | more
    places = F.array(*(F.when(inside, F.lit(i)) for i, inside in enumerate(within)))
    rows = met.filter(some).select(*keys, "x", F.explode(places).alias("at")).filter("at is not null")
    return below.unionByName(rows.groupBy(*keys, "at", "x").agg(F.count("*").alias("c")).select(*keys, "at", "x", "c"))


def quantiles(frame: DataFrame, columns: dict[str, Column | str], ps: list[float], by: list[str] | None = None, few_rows: int = FEW_ROWS) -> DataFrame:
    """(by..., column, n, q array<double>): exact quantiles ps of each column in each group. The input is evaluated once:
    what is needed of it is written to the shared folder."""
    by = list(by or [])
    keys = [*by, "column"]
    values = written(long_values(frame, columns, by), "quantile-values")
    largest = values.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= SMALL_GROUP:
        return values.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("x", F.array(*map(F.lit, ps))).alias("q")).dropna(subset=by)
    bounds = written(bounds_of(values, ps, by), "quantile-bounds")
    few = bounds.count() <= SENT_GROUPS
    places = F.create_map(*(F.lit(v) for i, p in enumerate(ps) for v in (i, p)))
    done: list[DataFrame] = []
    while True:
        counts = written(counted(values, bounds, ps, by, few), "quantile-counts")
        ranked = with_grouped_running(counts, [*keys, "at"], "x", {"upto": "c"}, few_rows)
        n = bounds.select(*keys, "n")
        position = (F.col("n") - 1) * places[F.col("at")]
        held = ranked.join(F.broadcast(n) if few else n.hint("merge"), keys).withColumn("h", position)
        rank = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("c") <= k), F.struct(F.col("x").isNotNull().alias("ok"), F.col("x").alias("x"))))
        picked = held.groupBy(*keys, "at").agg(F.first("n").alias("n"), F.first("h").alias("h"), rank(F.floor("h")).alias("a"), rank(F.ceil("h")).alias("b"))
        picked = written(picked, "quantile-ranks")
        good = picked.filter("a.ok and b.ok")
        done.append(good)
        missed = picked.filter("not coalesce(a.ok and b.ok, false)").select(*keys).distinct()
        if missed.isEmpty():
            break
        open_ = F.array(*(F.lit(float("-inf")) for _ in ps)), F.array(*(F.lit(float("inf")) for _ in ps))
        bounds = written(bounds.join(missed.hint("merge"), keys, "left_semi").withColumns({"low": open_[0], "high": open_[1]}), "quantile-bounds")
        done[-1] = good.join(missed.hint("merge"), keys, "left_anti")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    a, b, h = F.col("a.x"), F.col("b.x"), F.col("h")
    value = F.when(a == b, a).otherwise((F.ceil(h) - h) * a + (h - F.floor(h)) * b)
    listed = every.select(*keys, "at", "n", value.alias("v")).groupBy(*keys).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "v"))).alias("_q"))
    return listed.select(*keys, "n", F.transform("_q", lambda s: s["v"]).alias("q"))


def wide_quantiles(frame: DataFrame, columns: dict[str, Column | str], ps: list[float], by: list[str] | None = None) -> DataFrame:
    """A row a group (one row without groups, even of an empty table): by..., and for each column its quantiles as an
    array (missing where it has no values)."""
    by = list(by or [])
    found = quantiles(frame, columns, ps, by)
    picked = [F.max(F.when(F.col("column") == n, F.col("q"))).alias(n) for n in columns]
    return found.groupBy(*by).agg(*picked) if by else found.agg(*picked)
