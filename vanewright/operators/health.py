"""Health scores, classes, components, factors, and fleet summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import with_running
from ..functions.expressions import clip, holds
from ..functions.quantiles import wide_quantiles
from ..sources.shared import written
from . import rules as R

#: Classes, worst last, and their lowest scores.
CLASSES = ("healthy", "monitor", "degraded", "critical")
BANDS = {"healthy": 80.0, "monitor": 60.0, "degraded": 40.0}
SATURATION, LEAST_IMPACT = 4.0, 0.05


def check_bands(bands: dict[str, float]) -> dict[str, float]:
    if not bands["healthy"] > bands["monitor"] > bands["degraded"] > 0:
        raise ValueError("class bands are out of order")
    return bands


def health_class(score: Column | str, bands: dict[str, float] | None = None) -> Column:
    """The class of a score; a missing score is critical."""
    b, s = check_bands(bands or BANDS), F.col(score) if isinstance(score, str) else score
    return F.when(holds(s >= b["healthy"]), "healthy").when(holds(s >= b["monitor"]), "monitor").when(holds(s >= b["degraded"]), "degraded").otherwise("critical")


def class_rank(name: Column | str) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.array_position(F.array(*map(F.lit, CLASSES)), c).cast("int") - 1


def adaptive_bands(scores: DataFrame, column: str = "score", most_shift: float = 10.0) -> DataFrame:
    """One row: bands shifted by how far the median lies from the middle of the two upper ones."""
    middle = (BANDS["healthy"] + BANDS["monitor"]) / 2
    shift = wide_quantiles(scores, {"_middle": column}, [0.5]).select(clip(F.col("_middle")[0] - middle, -most_shift, most_shift).alias("shift"))
    return shift.select("shift", *(clip(F.lit(v) + F.col("shift"), 1, 99).alias(n) for n, v in BANDS.items()))


def published(raw: Column | str, penalty: Column | str) -> Column:
    raw, penalty = (F.col(c) if isinstance(c, str) else c for c in (raw, penalty))
    return clip(raw - F.when(penalty > 0, penalty).otherwise(0.0), 0, 100)


def all_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(CLASSES)], "health_class string, rank int")


def class_distribution(scored: DataFrame) -> DataFrame:
    """(health_class, rank, n) of all classes, empty ones too."""
    counts = scored.groupBy("health_class").agg(F.count("*").alias("n"))
    return all_classes(scored.sparkSession).join(counts, "health_class", "left").select("health_class", "rank", F.coalesce("n", F.lit(0)).alias("n"))


def badward(z: str = "z") -> Column:
    """A deviation in the bad direction, 0 in the other or where missing."""
    d = R.sign() * F.col(z)
    return F.when(holds(d > 0), d).otherwise(0.0)


def evidence(last_rows: DataFrame) -> DataFrame:
    """Rule rows (turbine_id, sensor, value, z, rule columns) with exceedance, deviation and impact."""
    exceed, dev = F.coalesce(R.exceedance(), F.lit(0.0)), badward()
    return last_rows.withColumns({"exceed": exceed, "dev": dev}).withColumn("impact", F.greatest("exceed", F.col("dev") / SATURATION))


def component_health(last_rows: DataFrame) -> DataFrame:
    """(turbine_id, component, score, health_class, drivers): 100 at no evidence, 0 at an alarm limit or four
    deviations; the three strongest drivers."""
    rows = evidence(last_rows)
    drivers = F.array_compact(
        F.array(
            F.when(F.col("exceed") > 0, F.struct((-F.col("exceed")).alias("order"), F.concat("sensor", F.lit(":limit")).alias("what"))),
            F.when(F.col("dev") / SATURATION > 0.25, F.struct((-F.col("dev") / SATURATION).alias("order"), F.concat("sensor", F.lit(":baseline")).alias("what"))),
        )
    )
    by = rows.withColumn("drivers", drivers).groupBy("turbine_id", "component").agg(F.max("impact").alias("worst"), F.flatten(F.collect_list("drivers")).alias("drivers"))
    score = F.bround(100 * (1 - F.least("worst", F.lit(1.0))), 2)
    top = F.transform(F.slice(F.array_sort("drivers"), 1, 3), lambda d: d["what"])
    return by.select("turbine_id", "component", score.alias("score"), top.alias("drivers")).withColumn("health_class", health_class("score"))


def worst_component(components: DataFrame) -> DataFrame:
    return components.groupBy("turbine_id").agg(F.min_by("component", F.struct("score", "component")).alias("component"), F.min("score").alias("score"))


def top_factors(last_rows: DataFrame, most: int = 5) -> DataFrame:
    """(turbine_id, rank, sensor, kind, impact): the strongest evidence of each machine."""
    rows = evidence(last_rows).filter(F.col("impact") > LEAST_IMPACT)
    kind = F.when(F.col("exceed") >= F.col("dev") / SATURATION, "limit").otherwise("baseline")
    order = Window.partitionBy("turbine_id").orderBy(F.desc(F.round("impact", 9)), "sensor")  # equal but for the last bits is equal
    return rows.withColumns({"kind": kind, "rank": F.row_number().over(order)}).filter(F.col("rank") <= most).select("turbine_id", "rank", "sensor", "kind", "impact")


def latest_per_machine(frame: DataFrame, as_of=None, order_by: str = "timestamp") -> DataFrame:
    """The last row of each machine, up to a time if one is given: an aggregate by key, not a sort."""
    rows = frame if as_of is None else frame.filter(F.col(order_by) <= F.lit(as_of))
    row = F.struct(*rows.columns)
    tie = F.struct(order_by, "ordinal") if "ordinal" in rows.columns else F.col(order_by)
    return rows.groupBy("turbine_id").agg(F.max_by(row, tie).alias("r")).select("r.*")


def fleet_summary(latest: DataFrame) -> DataFrame:
    """One row over the machines' latest scores: counts, mean, least, class and regime counts as maps, machines with a
    deduction, and the five worst."""
    alert = F.count_if(F.col("raw") - F.col("score") > 1e-6)
    one = latest.agg(F.count("*").alias("machines"), F.avg("score").alias("mean_score"), F.min("score").alias("least_score"), alert.alias("drift_alerts"))
    maps = []
    for name in ("health_class", "regime"):
        counts = latest.groupBy(name).agg(F.count("*").alias("n"))
        maps.append(counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias(f"{name}_counts")))
    worst = latest.orderBy("score", "turbine_id").limit(5).agg(F.transform(F.array_sort(F.collect_list(F.struct("score", "turbine_id"))), lambda x: x["turbine_id"]).alias("worst"))
    for part in (*maps, worst):  # one row each
        one = one.join(F.broadcast(part))
    return one


def ranked(frame: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks over the whole frame by way of distinct values."""
    counts = frame.groupBy(column).agg(F.count("*").alias("_c"))
    values = with_running(counts, column, {"_below": F.col("_c")}, before=True).select(column, (F.col("_below") + (F.col("_c") + 1) / 2.0).alias(name))
    return frame.join(values, column)


def regression_metrics(frame: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: mae, rmse, median error, r2, rank correlation, bias, mae of degraded machines, shares within 5 and 10."""
    rows = ranked(ranked(frame.select(F.col(truth).alias("y"), F.col(predicted).alias("p")), "y", "ry"), "p", "rp")
    e = F.col("p") - F.col("y")
    r2 = 1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count("*"))
    # corr by its parts: it is missing, not an error, where one side is constant
    spearman = F.try_divide(F.covar_pop("ry", "rp"), F.stddev_pop("ry") * F.stddev_pop("rp"))
    rows = written(rows, "ranked-pairs")
    middle = wide_quantiles(rows, {"_e": F.abs(e)}, [0.5]).select(F.col("_e")[0].alias("median_ae"))  # one row
    measured = rows.agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"), spearman.alias("spearman"), F.avg(e).alias("bias"),
        F.avg(F.when(F.col("y") < BANDS["healthy"], F.abs(e))).alias("mae_degraded"), F.avg((F.abs(e) <= 5).cast("double")).alias("within_5"), F.avg((F.abs(e) <= 10).cast("double")).alias("within_10"),
    )
    return measured.join(F.broadcast(middle)).select("n", "mae", "rmse", "median_ae", "r2", "spearman", "bias", "mae_degraded", "within_5", "within_10")


def class_metrics(frame: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: agreement, within one class, optimistic share."""
    t, p = class_rank(health_class(truth)), class_rank(health_class(predicted))
    share = lambda c: F.avg(c.cast("double"))
    return frame.agg(share(t == p).alias("agreement"), share(F.abs(t - p) <= 1).alias("within_one"), share(p < t).alias("optimistic"))


def band_errors(frame: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(health_class, rank, n, mae, agreement) by true class, empty ones too."""
    rows = frame.select(health_class(truth).alias("health_class"), F.abs(F.col(predicted) - F.col(truth)).alias("e"), (health_class(truth) == health_class(predicted)).cast("double").alias("same"))
    by = rows.groupBy("health_class").agg(F.count("*").alias("n"), F.avg("e").alias("mae"), F.avg("same").alias("agreement"))
    return all_classes(frame.sparkSession).join(by, "health_class", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion(frame: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(true_class, one column of counts for each class)."""
    rows = frame.select(health_class(truth).alias("true_class"), health_class(predicted).alias("p"))
    return rows.groupBy("true_class").pivot("p", list(CLASSES)).count().na.fill(0)
