"""Fleet queries: what dashboards and explorations read, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio
from ..functions.quantiles import quantiles
from ..sources.telemetry import micros
from . import metrics

LEVELS = ("low", "medium", "high")


def risk_counts(scored: DataFrame) -> DataFrame:
    names = scored.sparkSession.createDataFrame([(x, i) for i, x in enumerate(LEVELS)], "risk string, rank int")
    counts = scored.groupBy(metrics.risk_level("p").alias("risk")).agg(F.count("*").alias("n"))
    return names.join(counts, "risk", "left").select("risk", "rank", F.coalesce("n", F.lit(0)).alias("n"))


def executive_summary(scored: DataFrame) -> DataFrame:
    """One row: machines, machines at high risk, mean risk, and the riskiest one."""
    return scored.agg(F.count("*").alias("machines"), F.count_if(F.col("p") >= metrics.MEDIUM_RISK).alias("high"), F.avg("p").alias("mean_p"), F.max_by("turbine_id", F.struct("p", "turbine_id")).alias("riskiest"))


def fleet_table(scored: DataFrame, factors: DataFrame, levels=("medium", "high"), least_p: float = 0.0) -> DataFrame:
    top = factors.filter("rank = 1").select("turbine_id", F.col("feature").alias("top_factor"))
    rows = scored.withColumn("risk", metrics.risk_level("p")).filter(F.col("risk").isin(*levels) & (F.col("p") >= least_p))
    return rows.join(top.hint("merge"), "turbine_id", "left").select("turbine_id", "p", "risk", "top_factor")


def history_with_features(history: DataFrame, features: DataFrame, columns: list[str], key=("turbine_id", "timestamp", "ordinal")) -> DataFrame:
    """Rows of a history with columns of the matrix beside them, by key; rows that the matrix lacks have nulls."""
    return history.join(features.select(*key, *columns).hint("merge"), list(key), "left")


def time_slice(frame: DataFrame, machine: str, start, end) -> DataFrame:
    """Rows of a machine in [start, end); both filters reach the scan."""
    return frame.filter((F.col("turbine_id") == machine) & (F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end)))


def class_balance(frame: DataFrame, target: str) -> DataFrame:
    total = Window.partitionBy()
    return frame.groupBy(target).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(total))


def machine_positives(frame: DataFrame, target: str) -> DataFrame:
    return frame.groupBy("turbine_id").agg(F.count("*").alias("observations"), F.sum("failure_event").alias("failures"), F.sum(target).alias("positives"), F.avg(target).alias("positive_rate"))


def describe(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, std, min, median, max) in one pass over the long form."""
    long = frame.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    middles = quantiles(frame, {c: c for c in columns}, [0.5]).select("column", F.col("q")[0].alias("median"))
    stats = long.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.join(F.broadcast(middles), "column", "left").select("column", "count", "mean", "std", "min", "median", "max")  # a row for each column


def correlation(a: str, b: str) -> Column:
    """Pearson's; missing where one side is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of every pair, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = frame.agg(*(correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def target_correlations(frame: DataFrame, columns: list[str], target: str, most: int = 25) -> DataFrame:
    """(feature, corr): the features most correlated with the target, by size."""
    one = frame.agg(*(correlation(c, target).alias(c) for c in columns))
    return one.unpivot([], columns, "feature", "corr").filter("corr is not null").orderBy(F.desc(F.abs("corr")), "feature").limit(most)


def class_means(frame: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, negative, positive, difference, relative): means by class."""
    one = frame.agg(*(F.avg(F.when(F.col(target) == k, F.col(c))).alias(f"{c}__{k}") for c in columns for k in (0, 1)))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}__0").alias("negative"), F.col(f"{c}__1").alias("positive")) for c in columns))).alias("x")).select("x.*")
    return rows.withColumns({"difference": F.col("positive") - F.col("negative"), "relative": 100 * ratio(F.col("positive") - F.col("negative"), F.abs("negative"))})


def failure_profile(frame: DataFrame, columns: list[str], bucket: int = 12, most: int = 240) -> DataFrame:
    """Mean of each sensor by how long before a failure a row lies."""
    rows = frame.filter(F.col("hours_to_failure").between(0, most))
    return rows.groupBy((F.floor(F.col("hours_to_failure") / bucket) * bucket).cast("int").alias("bucket")).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))


def worst_timeline(frame: DataFrame) -> DataFrame:
    """The rows of the machine with most failures, the first by name of ties."""
    by = frame.groupBy("turbine_id").agg(F.sum("failure_event").alias("n"))
    worst = by.orderBy(F.desc("n"), "turbine_id").limit(1).select("turbine_id")
    return frame.join(F.broadcast(worst), "turbine_id", "left_semi")  # one row


def sampled_curve(frame: DataFrame, per_mille: int = 100, seed: int = 42) -> DataFrame:
    """Wind and power of a share of the rows, the same ones every time."""
    return frame.filter(F.pmod(F.pmod("ordinal", F.lit(1000003)) * 7919 + seed, F.lit(1000)) < per_mille).select("turbine_id", "ordinal", "wind_speed", "power_output")


def attention(latest: DataFrame) -> DataFrame:
    """One row: machines that are not healthy, mean deduction, share with one."""
    off = F.col("raw") - F.col("score")
    return latest.agg(F.count_if(F.col("health_class") != "healthy").alias("needs_attention"), F.avg(off).alias("mean_deduction"), F.avg((off > 1e-6).cast("double")).alias("share_deducted"))


def dataset_summary(named: DataFrame, target: str = "target") -> DataFrame:
    """One row: rows, machines, time range, positive rate, and rows by split."""
    t = micros("timestamp")
    return named.agg(F.count("*").alias("rows"), F.count_distinct("turbine_id").alias("machines"), F.min(t).alias("first"), F.max(t).alias("last"), F.avg(target).alias("positive_rate"), *(F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "valid", "test")))
