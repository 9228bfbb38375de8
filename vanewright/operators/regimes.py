"""Operating regimes of a machine."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import holds

#: Regimes in order, and the limits between them.
REGIMES = ("offline", "idle", "low_load", "medium_load", "high_load", "curtailed")
CUT_IN, CUT_OUT, RATED_WIND, RATED_POWER = 3.0, 25.0, 12.5, 2000.0
IDLE_POWER, LOW_MEDIUM, MEDIUM_HIGH, CURTAILED = 25.0, 7.0, 11.0, 0.55
PRODUCING = ("low_load", "medium_load", "high_load")


def reference_power(wind: Column | str = "wind_speed") -> Column:
    """The reference power curve: a cubic ramp from cut-in to rated wind, flat to cut-out, 0 elsewhere."""
    v = F.col(wind) if isinstance(wind, str) else wind
    ramp = F.lit(RATED_POWER) * F.pow((v - CUT_IN) / (RATED_WIND - CUT_IN), 3)
    return F.when(v.isNull(), None).when((v >= CUT_IN) & (v < RATED_WIND), ramp).when((v >= RATED_WIND) & (v <= CUT_OUT), F.lit(RATED_POWER)).otherwise(F.lit(0.0))


def regime() -> Column:
    """By thresholds: offline before idle before curtailed before the wind's band. A comparison with a missing value
    does not hold."""
    v, p, e = F.col("wind_speed"), F.col("power_output"), reference_power()
    off = holds(F.col("operational_status").isin("maintenance", "fault"))
    idle = holds(v < CUT_IN) | holds(v > CUT_OUT) | holds(p <= IDLE_POWER)
    curtailed = holds((e > 1) & (p / F.greatest(e, F.lit(1.0)) < CURTAILED))
    band = F.when(holds(v < LOW_MEDIUM), "low_load").when(holds(v >= MEDIUM_HIGH), "high_load").otherwise("medium_load")
    return F.when(off, "offline").when(idle, "idle").when(curtailed, "curtailed").otherwise(band)


def with_regime(frame: DataFrame, method: str = "threshold", **options) -> DataFrame:
    if method == "threshold":
        return frame.withColumn("regime", regime())
    if method == "kmeans":
        return kmeans_regimes(frame, **options)
    raise ValueError(f"no regime method {method}")


def kmeans_regimes(frame: DataFrame, most_rows: int = 20_000, seed: int = 42) -> DataFrame:
    """Four clusters of standardised wind, power and rotor speed, named by their mean power. The centres are fitted on
    the rows with the least key hashes; everything is assigned."""
    inputs = ["wind_speed", "power_output", "rotor_speed"]
    online = frame.filter(~holds(F.col("operational_status").isin("maintenance", "fault"))).dropna(subset=inputs)
    fit_on = online.orderBy(F.xxhash64("turbine_id", "timestamp", F.lit(seed))).limit(most_rows)
    model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), KMeans(k=4, seed=seed, featuresCol="_scaled", predictionCol="_cluster")]).fit(fit_on)
    ranks = [r["_cluster"] for r in model.transform(fit_on).groupBy("_cluster").agg(F.avg("power_output").alias("p")).orderBy("p").collect()]  # four rows
    names = F.create_map(*(F.lit(x) for c, n in zip(ranks, ("idle", *PRODUCING)) for x in (c, n)))
    known = F.array_contains(F.array(*(F.col(c).isNull() for c in inputs)), True)
    filled = model.transform(frame.withColumns({f"_was_{c}": F.col(c) for c in inputs}).fillna(0.0, inputs))
    named = F.when(holds(F.col("operational_status").isin("maintenance", "fault")), "offline").when(known, "idle").otherwise(names[F.col("_cluster")])
    restored = filled.withColumns({c: F.col(f"_was_{c}") for c in inputs})
    return restored.withColumn("regime", named).drop("_raw", "_scaled", "_cluster", *(f"_was_{c}" for c in inputs))


def producing(frame: DataFrame) -> Column:
    return F.col("regime").isin(*PRODUCING) if "regime" in frame.columns else F.lit(True)


def regime_summary(frame: DataFrame) -> DataFrame:
    """(regime, rank, n, share) of all regimes, those without rows too."""
    names = frame.sparkSession.createDataFrame([(r, i) for i, r in enumerate(REGIMES)], "regime string, rank int")
    counts = frame.groupBy("regime").agg(F.count("*").alias("n"))
    total = frame.agg(F.count("*").alias("total"))  # one row
    joined = names.join(counts, "regime", "left").join(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return joined.select("regime", "rank", n.alias("n"), F.coalesce(n / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("share"))
