"""Classification metrics, curves, thresholds, and selection. Scores are first counted by distinct value or grid step,
so ordered windows run over those counts and not over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import with_grouped_running, with_running
from ..sources.shared import written
from ..functions.expressions import holds

#: Costs of outcomes, the grid of thresholds, limits of selection.
COSTS = {"fn": 10.0, "fp": 2.0, "tp": 1.0, "tn": 0.0}
GRID_LOW, GRID_STEP, GRID_SIZE = 0.01, 0.005, 197
LOW_RISK, MEDIUM_RISK = 0.30, 0.65
LEAST_RECALL, PR_SHARE, COST_BAND = 0.30, 0.80, 0.05


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def decide(p: Column | str, threshold: float) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return holds(p >= threshold).cast("int")


def risk_level(p: Column | str, low: float = LOW_RISK, medium: float = MEDIUM_RISK) -> Column:
    if not 0 < low < medium < 1:
        raise ValueError("risk bands are out of order")
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < low, "low").when(p < medium, "medium").otherwise("high")


def confusion_counts(y: Column, hit: Column) -> list[Column]:
    return [
        F.count_if((y == 1) & (hit == 1)).alias("tp"), F.count_if((y == 0) & (hit == 1)).alias("fp"), F.count_if((y == 1) & (hit == 0)).alias("fn"), F.count_if((y == 0) & (hit == 0)).alias("tn")
    ]


def rates() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    f = lambda b: share((1 + b * b) * precision * recall, b * b * precision + recall)
    return {
        "precision": precision, "recall": recall, "f1": f(1), "f2": f(2), "fnr": share(fn, tp + fn), "fpr": share(fp, fp + tn), "specificity": share(tn, fp + tn),
        "accuracy": share(tp + tn, tp + fp + fn + tn), "base_rate": share(tp + fn, tp + fp + fn + tn), "positive_rate": share(tp + fp, tp + fp + fn + tn),
    }


def classification_metrics(frame: DataFrame, threshold: float, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """Counts and rates at a threshold, over all rows or by group, in one aggregate."""
    counts = confusion_counts(F.col(y), decide(p, threshold))
    brier = F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier")
    return frame.groupBy(*by).agg(*counts, brier).select(*by, "tp", "fp", "fn", "tn", "brier", *(c.alias(n) for n, c in rates().items()))


def score_counts(frame: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """(p, positives, n) by distinct score."""
    return frame.groupBy(*by, F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("positives"), F.count("*").alias("n"))


def curve(frame: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(p, tp, fp, precision, recall, fpr) at every distinct score taken as threshold."""
    counts = score_counts(frame, y, p)
    total = counts.agg(F.sum("positives").alias("pos"), F.sum("n").alias("all"))  # one row
    rows = with_running(counts, "p", {"tp": F.col("positives"), "seen": F.col("n")}, descending=True).join(F.broadcast(total))
    return rows.select("p", "positives", "tp", (F.col("seen") - F.col("tp")).alias("fp"), share(F.col("tp"), F.col("seen")).alias("precision"), share(F.col("tp"), F.col("pos")).alias("recall"), share(F.col("seen") - F.col("tp"), F.col("all") - F.col("pos")).alias("fpr"))


def grouped_pr_auc(frame: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """A row for each group: pr_auc of all of them in one aggregate."""
    return average_precision(with_totals(frame, by, y, p), by)


def pr_auc_of_counts(counts: DataFrame, *by: str) -> DataFrame:
    """As grouped_pr_auc(), from rows (by..., p, positives, n) that may repeat a score."""
    merged = counts.groupBy(*by, "p").agg(F.sum("positives").alias("positives"), F.sum("n").alias("n"))
    return average_precision(totals_of(merged, by), by)


def average_precision(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    above = lambda upto, own, every: F.col(every) - F.col(upto) + F.col(own)
    rows = counts.withColumn("precision", share(above("upto_positives", "positives", "all_positives"), above("upto_n", "n", "all_n")))
    return rows.groupBy(*by).agg(share(F.sum(F.col("precision") * F.col("positives")), F.sum("positives")).alias("pr_auc"))


def with_totals(frame: DataFrame, by: tuple[str, ...], y: str = "y", p: str = "p") -> DataFrame:
    """Counts by distinct score in each group, with running and whole sums."""
    return totals_of(score_counts(frame, y, p, by), by)


def totals_of(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    counts = written(counts, "score-counts")
    totals = counts.groupBy(*by).agg(F.sum("positives").alias("all_positives"), F.sum("n").alias("all_n"))
    running = with_grouped_running(counts, list(by), "p", {"upto_positives": "positives", "upto_n": "n"})
    return running.join(F.broadcast(totals), list(by))  # a row for each group: a feature and repeat, or a model and part


def grouped_roc_auc(frame: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """A row for each group: roc_auc of all of them in one aggregate."""
    negatives = F.col("n") - F.col("positives")
    below = F.col("upto_n") - F.col("upto_positives") - negatives
    pairs = F.sum(F.col("positives") * (below + negatives / 2.0))
    return with_totals(frame, by, y, p).groupBy(*by).agg(share(pairs, F.sum("positives") * F.sum(negatives)).alias("roc_auc"))


def pr_auc(frame: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: average precision; ties are one step."""
    points = curve(frame, y, p)
    return points.agg(share(F.sum(F.col("precision") * F.col("positives")), F.sum("positives")).alias("pr_auc"))


def roc_auc(frame: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: the share of pairs in order, ties by half, from rank sums over distinct scores."""
    rows = with_running(score_counts(frame, y, p), "p", {"below": F.col("n") - F.col("positives")}, before=True)
    negatives = F.col("n") - F.col("positives")
    pairs = F.sum(F.col("positives") * (F.col("below") + negatives / 2.0))
    return rows.agg(share(pairs, F.sum("positives") * F.sum(negatives)).alias("roc_auc"))


def threshold_curve(frame: DataFrame, y: str = "y", p: str = "p", costs: dict[str, float] | None = None) -> DataFrame:
    """Counts, rates and cost at every threshold of the grid. Scores fall into grid steps once; sums over higher steps
    give the counts, so rows are read once and not once for each threshold."""
    c = costs or COSTS
    spark = frame.sparkSession
    step = F.floor(F.round((F.col(p) - GRID_LOW) / GRID_STEP, 9)).cast("int")
    binned = frame.select(F.greatest(F.least(step, F.lit(GRID_SIZE - 1)), F.lit(-1)).alias("i"), F.col(y).alias("y"))
    counts = binned.groupBy("i").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    grid = spark.range(-1, GRID_SIZE).select(F.col("id").cast("int").alias("i")).join(counts.hint("shuffle_hash"), "i", "left").na.fill(0, ["pos", "neg"])
    higher = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    rows = grid.withColumns({"tp": F.sum("pos").over(higher), "fp": F.sum("neg").over(higher), "all_pos": F.sum("pos").over(total), "all_neg": F.sum("neg").over(total)})
    rows = rows.filter("i >= 0").withColumns({"threshold": F.round(GRID_LOW + F.col("i") * GRID_STEP, 3), "fn": F.col("all_pos") - F.col("tp"), "tn": F.col("all_neg") - F.col("fp")})
    cost = F.col("fn") * c["fn"] + F.col("fp") * c["fp"] + F.col("tp") * c["tp"] + F.col("tn") * c["tn"]
    keep = rates()
    return rows.select("threshold", "tp", "fp", "fn", "tn", *(keep[n].alias(n) for n in ("precision", "recall", "f1", "f2")), cost.alias("cost"))


def choose_threshold(points: DataFrame, split: str = "valid") -> DataFrame:
    """One row: the thresholds of highest F2 and of lowest cost; the lowest of ties. Never on the test part."""
    if split == "test":
        raise ValueError("thresholds are not chosen on the test part")
    return points.agg(F.max_by("threshold", F.struct("f2", -F.col("threshold"))).alias("best_f2"), F.min_by("threshold", F.struct("cost", "threshold")).alias("least_cost"), F.max("f2").alias("f2"), F.min("cost").alias("cost"))


def select_failure_model(candidates: DataFrame) -> DataFrame:
    """Candidates (model, recall, pr_auc, cost, f2) that pass the guards, in order; the first is chosen. Costs within a
    band of the least count as ties."""
    best = candidates.agg(F.max("pr_auc").alias("_best"))
    passed = candidates.join(F.broadcast(best)).filter((F.col("recall") >= LEAST_RECALL) & (F.col("pr_auc") >= PR_SHARE * F.col("_best"))).drop("_best")
    least = passed.agg(F.min("cost").alias("_least"))
    tie = (F.col("cost") <= F.col("_least") * (1 + COST_BAND)).cast("int")
    ordered = passed.join(F.broadcast(least)).withColumn("_tie", tie)
    w = Window.orderBy(F.desc("_tie"), F.when(F.col("_tie") == 0, F.col("cost")), F.desc("f2"), F.desc("recall"), F.desc("pr_auc"), "model")
    return ordered.withColumn("rank", F.row_number().over(w)).drop("_tie", "_least")


def select_health_model(candidates: DataFrame, baseline: str = "mean") -> DataFrame:
    """Candidates (model, mae, mae_degraded, rmse, spearman) that order machines and beat the baseline, in order."""
    base = candidates.filter(F.col("model") == baseline).select(F.col("mae").alias("_base"))
    passed = candidates.join(F.broadcast(base)).filter((F.col("model") != baseline) & holds(F.col("spearman") >= 0.5) & (F.col("mae") <= 0.85 * F.col("_base")))
    least = passed.agg(F.min("mae_degraded").alias("_least"))
    tie = (F.col("mae_degraded") <= 1.05 * F.col("_least")).cast("int")
    w = Window.orderBy(F.desc("_tie"), F.when(F.col("_tie") == 0, F.col("mae_degraded")), "mae", "rmse", F.desc("spearman"), "model")
    return passed.join(F.broadcast(least)).withColumn("_tie", tie).withColumn("rank", F.row_number().over(w)).drop("_tie", "_least", "_base")


def histogram(frame: DataFrame, column: str, low: float, high: float, bins: int = 40) -> DataFrame:
    """(bin, n) of all bins; the last one includes the upper end."""
    b = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = frame.filter(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    grid = frame.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts.hint("shuffle_hash"), "bin", "left").na.fill(0, ["n"])
