"""Metrics and thresholds, explanations, evidence fusion, and fleet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import anomaly, explain, fleet, fusion, health, metrics
from ..operators import features as X
from ..operators import windows as W
from ..sources import telemetry as T
from . import sql as S
from .cleaning_queries import ID, SPLIT, keyed, keyed_events, labelled_events, _target
from .condition_queries import CLASS, LATEST, SCORED, latest, scored
from .feature_queries import INTERACTIONS, POWER
from .registry import ORACLES, query

# scored labels: toxicity labels against a score that depends on the document's length alone
SCORES = "sc AS (SELECT l.doc_id, l.toxic AS y, l.quality, (d.n_chars % 997) / 997.0 AS p FROM labels l JOIN documents d USING (doc_id))"


def scores(spark, d):
    labels = T.read(spark, d, "labels").select("doc_id", F.col("toxic").alias("y"), "quality")
    docs = T.read(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 997) / 997.0).alias("p"))
    return labels.join(docs, "doc_id")


_rates = """tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, fn / nullif(tp + fn, 0)::DOUBLE AS fnr, fp / nullif(fp + tn, 0)::DOUBLE AS fpr, tn / nullif(fp + tn, 0)::DOUBLE AS specificity,
(tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE AS accuracy, (tp + fn) / nullif(tp + fp + fn + tn, 0)::DOUBLE AS base_rate, (tp + fp) / nullif(tp + fp + fn + tn, 0)::DOUBLE AS positive_rate"""


def metrics_sql(source: str, threshold: float, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""cm AS (SELECT {g}count(*) FILTER (y = 1 AND p >= {threshold}) AS tp, count(*) FILTER (y = 0 AND p >= {threshold}) AS fp, count(*) FILTER (y = 1 AND p < {threshold}) AS fn, count(*) FILTER (y = 0 AND p < {threshold}) AS tn, avg(pow(p - y, 2)) AS brier FROM {source} {'GROUP BY ' + by if by else ''}), cr AS (SELECT *, {_rates} FROM cm)
SELECT {g}tp, fp, fn, tn, {S.r('brier', 6)} AS brier, {', '.join(f'{S.r(f"coalesce({c}, 0.0)", 6)} AS {c}' for c in ('precision', 'recall', 'fnr', 'fpr', 'specificity', 'accuracy', 'base_rate', 'positive_rate'))},
{S.r('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0)', 6)} AS f1, {S.r('coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0.0)', 6)} AS f2 FROM cr"""


def rounded_all(frame, keep=(), places=6):
    return frame.select(*(F.col(c) if c in keep or t not in ("double", "float") else rounded(c, places).alias(c) for c, t in frame.dtypes))


@query("m6_classification_metrics", f"WITH {SCORES}, {metrics_sql('sc', 0.5)}")
def m6(spark, d):
    return rounded_all(metrics.classification_metrics(scores(spark, d), 0.5))


@query("m17_metrics_by_split", f"WITH {SCORES}, {metrics_sql('sc', 0.3, 'quality')}")
def m17(spark, d):
    return rounded_all(metrics.classification_metrics(scores(spark, d), 0.3, "quality"))


_curve = "pc AS (SELECT p, sum(y) AS pos, count(*) AS n FROM sc GROUP BY 1), pr AS (SELECT p, pos, n, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen, (SELECT sum(y) FROM sc) AS allpos, (SELECT count(*) FROM sc) AS alln FROM pc)"


@query("m7_pr_auc", f"WITH {SCORES}, {_curve} SELECT {S.r('sum(tp / seen::DOUBLE * pos) / sum(pos)', 6)} AS pr_auc FROM pr")
def m7(spark, d):
    return metrics.pr_auc(scores(spark, d)).select(rounded("pr_auc", 6).alias("pr_auc"))


@query("m7_roc_auc", f"WITH {SCORES}, rk AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM sc) SELECT {S.r('(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))', 6)} AS roc_auc FROM rk")
def m7b(spark, d):
    return metrics.roc_auc(scores(spark, d)).select(rounded("roc_auc", 6).alias("roc_auc"))


@query("m16_curve_points", f"WITH {SCORES}, {_curve} SELECT {S.r('p', 6)} AS p, CAST(tp AS BIGINT) AS tp, CAST(seen - tp AS BIGINT) AS fp, {S.r('tp / seen::DOUBLE', 6)} AS precision, {S.r('tp / allpos::DOUBLE', 6)} AS recall, {S.r('(seen - tp) / (alln - allpos)::DOUBLE', 6)} AS fpr FROM pr")
def m16(spark, d):
    return rounded_all(metrics.curve(scores(spark, d)).drop("positives"))


_grid = f"""gr AS (SELECT round(0.01 + i * 0.005, 3) AS threshold FROM range({metrics.GRID_SIZE}) t(i)), gc AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp, count(*) FILTER (y = 1 AND p < threshold) AS fn, count(*) FILTER (y = 0 AND p < threshold) AS tn FROM gr, sc GROUP BY 1),
tc AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0.0) AS recall, fn * 10.0 + fp * 2.0 + tp * 1.0 AS cost FROM gc), tf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1, coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0.0) AS f2 FROM tc)"""


@query("m8_threshold_curve", f"WITH {SCORES}, {_grid} SELECT threshold, tp, fp, fn, tn, {S.r('precision', 6)} AS precision, {S.r('recall', 6)} AS recall, {S.r('f1', 6)} AS f1, {S.r('f2', 6)} AS f2, CAST(cost AS DOUBLE) AS cost FROM tf")
def m8(spark, d):
    return rounded_all(metrics.threshold_curve(scores(spark, d)), ("threshold", "cost"))


@query("m9_choose_threshold", f"WITH {SCORES}, {_grid} SELECT (SELECT threshold FROM tf ORDER BY round(f2, 9) DESC, threshold LIMIT 1) AS best_f2, (SELECT threshold FROM tf ORDER BY cost, threshold LIMIT 1) AS least_cost, {S.r('max(f2)', 6)} AS f2, CAST(min(cost) AS DOUBLE) AS cost FROM tf")
def m9(spark, d):
    points = metrics.threshold_curve(scores(spark, d)).withColumn("f2", F.round("f2", 9))
    return rounded_all(metrics.choose_threshold(points), ("best_f2", "least_cost", "cost"))


@query("m12_risk_bands", f"WITH {SCORES} SELECT CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.65 THEN 'medium' ELSE 'high' END AS risk, count(*) AS n FROM sc GROUP BY 1")
def m12(spark, d):
    return scores(spark, d).groupBy(metrics.risk_level("p").alias("risk")).agg(F.count("*").alias("n"))


# candidates: one per order priority, measured over the orders
_cand = "ca AS (SELECT o_orderpriority AS model, avg((o_orderstatus = 'F')::INT) AS recall, avg((o_totalprice > 100000)::INT) AS pr_auc, avg(o_totalprice * pi()) / 1000 AS cost, avg((o_orderstatus = 'O')::INT) AS f2 FROM orders GROUP BY 1)"


def candidates(spark, d):
    share = lambda c: F.avg(c.cast("double"))
    return T.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
        share(F.col("o_orderstatus") == "F").alias("recall"), share(F.col("o_totalprice") > 100000).alias("pr_auc"), (F.avg(F.col("o_totalprice") * F.pi()) / 1000).alias("cost"), share(F.col("o_orderstatus") == "O").alias("f2")
    )


@query("m10_select_failure_model", f"WITH {_cand}, pa AS (SELECT * FROM ca WHERE recall >= 0.3 AND pr_auc >= 0.8 * (SELECT max(pr_auc) FROM ca)), ti AS (SELECT *, (cost <= (SELECT min(cost) FROM pa) * 1.05)::INT AS t FROM pa) SELECT model, {S.r('cost')} AS cost, CAST(row_number() OVER (ORDER BY t DESC, CASE WHEN t = 0 THEN cost END, f2 DESC, recall DESC, pr_auc DESC, model) AS INTEGER) AS rank FROM ti")
def m10(spark, d):
    return metrics.select_failure_model(candidates(spark, d)).select("model", rounded("cost").alias("cost"), "rank")


@query("l13_select_detector", f"WITH {_cand} SELECT model, CAST(row_number() OVER (ORDER BY recall DESC, pr_auc DESC, f2 DESC, cost, model) AS INTEGER) AS rank FROM ca")
def l13(spark, d):
    return anomaly.select_detector(candidates(spark, d).withColumnRenamed("cost", "latency")).select("model", "rank")


@query("k17_select_health_model", f"WITH {_cand}, hm AS (SELECT model, cost AS mae, cost * (1 + recall) AS mae_degraded, cost * 1.2 AS rmse, pr_auc AS spearman FROM ca), ba AS (SELECT max(mae) * 2 AS b FROM hm), pa AS (SELECT hm.* FROM hm, ba WHERE spearman >= 0.5 AND mae <= 0.85 * b), ti AS (SELECT *, (mae_degraded <= 1.05 * (SELECT min(mae_degraded) FROM pa))::INT AS t FROM pa) SELECT model, {S.r('mae')} AS mae, CAST(row_number() OVER (ORDER BY t DESC, CASE WHEN t = 0 THEN mae_degraded END, mae, rmse, spearman DESC, model) AS INTEGER) AS rank FROM ti")
def k17(spark, d):
    c = candidates(spark, d).select("model", F.col("cost").alias("mae"), (F.col("cost") * (1 + F.col("recall"))).alias("mae_degraded"), (F.col("cost") * 1.2).alias("rmse"), F.col("pr_auc").alias("spearman"))
    mean = c.agg((F.max("mae") * 2).alias("mae")).select(F.lit("mean").alias("model"), "mae", F.col("mae").alias("mae_degraded"), F.col("mae").alias("rmse"), F.lit(0.0).alias("spearman"))
    return metrics.select_health_model(c.unionByName(mean)).select("model", rounded("mae").alias("mae"), "rank")


@query("q6_score_histogram", f"WITH {SCORES} SELECT CAST(i AS INTEGER) AS bin, count(p) AS n FROM range(40) t(i) LEFT JOIN sc ON least(floor(p / 0.025), 39) = i GROUP BY 1")
def q6(spark, d):
    return metrics.histogram(scores(spark, d), "p", 0.0, 1.0)


# the novelty of a machine reading: here its vibration, judged against readings of normal status
_nov = f"{S.MACHINES}, nv AS (SELECT *, vibration AS novelty FROM m WHERE vibration IS NOT NULL), rf AS (SELECT novelty FROM nv WHERE operational_status = 'normal')"


def novelty(spark, d):
    return keyed(spark, d).filter("vibration is not null").withColumn("novelty", F.col("vibration"))


@query("l6_calibration", f"WITH {_nov}, li AS (SELECT quantile_cont(novelty, 0.95) AS w, quantile_cont(novelty, 0.99) AS a FROM rf) SELECT {S.r('w')} AS warning, {S.r('a')} AS alarm, {S.r('avg((novelty >= w)::INT)', 6)} AS warning_rate, {S.r('avg((novelty >= a)::INT)', 6)} AS alarm_rate FROM rf, li GROUP BY w, a")
def l6(spark, d):
    c = anomaly.calibrate(novelty(spark, d).filter("operational_status = 'normal'"))
    return c.select(rounded("warning").alias("warning"), rounded("alarm").alias("alarm"), rounded("warning_rate", 6).alias("warning_rate"), rounded("alarm_rate", 6).alias("alarm_rate"))


@query("l7_percentile_scores", f"WITH {_nov}, ec AS (SELECT novelty, count(*) AS n FROM rf GROUP BY 1), dv AS (SELECT DISTINCT novelty FROM nv), cu AS (SELECT dv.novelty, coalesce(sum(n) OVER (ORDER BY dv.novelty), 0) / (SELECT count(*) FROM rf)::DOUBLE AS q FROM dv LEFT JOIN ec USING (novelty)) SELECT turbine_id, ordinal, {S.r('q', 6)} AS percentile FROM nv JOIN cu USING (novelty)")
def l7(spark, d):
    rows = novelty(spark, d)
    return anomaly.percentile_scores(rows, rows.filter("operational_status = 'normal'")).select(*ID, rounded("percentile", 6).alias("percentile"))


@query("l8_severity", f"WITH {_nov} SELECT CASE WHEN operational_status IN ('fault', 'maintenance') THEN 'not_applicable' WHEN novelty >= 12 THEN 'alarm' WHEN novelty >= 9 THEN 'warning' ELSE 'normal' END AS severity, count(*) AS n FROM nv GROUP BY 1")
def l8(spark, d):
    return novelty(spark, d).groupBy(anomaly.severity("novelty", F.lit(9.0), F.lit(12.0), "operational_status").alias("severity")).agg(F.count("*").alias("n"))


_feat = ("vibration", "gearbox_temperature", "oil_pressure", "bearing_temperature", "power_output", "rotor_speed")
_refs = " UNION ALL ".join(f"SELECT '{c}' AS feature, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM m" for c in _feat)
_lastrow = "la AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp DESC, ordinal DESC) = 1)"


@query("l10_feature_reference", f"WITH {S.MACHINES}, r AS ({_refs}) SELECT feature, {S.r('median')} AS median, {S.r('q1')} AS q1, {S.r('q3')} AS q3 FROM r")
def l10(spark, d):
    return rounded_all(anomaly.feature_reference(keyed(spark, d), list(_feat)), places=4)


@query("l10_contributing_signals", f"WITH {S.MACHINES}, r AS ({_refs}), {_lastrow}, lo AS (UNPIVOT (SELECT turbine_id, {', '.join(_feat)} FROM la) ON {', '.join(_feat)} INTO NAME feature VALUE value), de AS (SELECT turbine_id, feature, abs(value - median) / {S.at_least('q3 - q1', 1e-06).replace('CASE', '(CASE').replace('END', 'END)')} AS d FROM lo JOIN r USING (feature)) SELECT turbine_id, CAST(row_number() OVER (PARTITION BY turbine_id ORDER BY d DESC, feature) AS INTEGER) AS rank, feature, {S.r('d')} AS deviation FROM de WHERE d >= 1 QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY d DESC, feature) <= 5")
def l10b(spark, d):
    rows = keyed(spark, d)
    out = anomaly.contributing_signals(health.latest_per_machine(rows), anomaly.feature_reference(rows, list(_feat)), list(_feat))
    return out.withColumn("deviation", rounded("deviation"))


_filled = " + ".join(f"({c} IS NOT NULL)::INT" for c in T.SENSORS)


@query("l11_recent_quality", f"WITH {S.MACHINES}, l AS (SELECT turbine_id, ({_filled}) / {len(T.SENSORS)}.0 AS q FROM m QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp DESC, ordinal DESC) <= 24) SELECT turbine_id, {S.r('avg(q)', 6)} AS data_quality FROM l GROUP BY 1")
def l11(spark, d):
    return anomaly.recent_quality(keyed(spark, d), list(T.SENSORS)).withColumn("data_quality", rounded("data_quality", 6))


@query("l12_detector_metrics", f"WITH {S.MACHINES}, sc AS (SELECT (coalesce(degradation_level, 0.0) >= 0.2)::INT AS y, vibration / 20 AS p FROM m WHERE vibration IS NOT NULL), {metrics_sql('sc', 0.45)}")
def l12(spark, d):
    rows = keyed(spark, d).filter("vibration is not null").select((F.coalesce("degradation_level", F.lit(0.0)) >= 0.2).cast("int").alias("y"), (F.col("vibration") / 20).alias("p"))
    return rounded_all(metrics.classification_metrics(rows, 0.45))


@query("q23_alert_rates", f"WITH {_nov}, li AS (SELECT quantile_cont(novelty, 0.95) AS w, quantile_cont(novelty, 0.99) AS a FROM rf) SELECT 'warning' AS kind, 0.05 AS target, {S.r('avg((novelty >= w)::INT)', 6)} AS measured FROM nv, li UNION ALL SELECT 'alarm', 0.01, {S.r('avg((novelty >= a)::INT)', 6)} FROM nv, li".replace("0.05 AS target", "CAST(0.05 AS DOUBLE) AS target").replace("'alarm', 0.01", "'alarm', CAST(0.01 AS DOUBLE)"))
def q23(spark, d):
    rows = novelty(spark, d)
    limits = anomaly.calibrate(rows.filter("operational_status = 'normal'")).select("warning", "alarm")
    both = rows.join(F.broadcast(limits)).agg(*(F.avg((F.col("novelty") >= F.col(c)).cast("double")).alias(c) for c in ("warning", "alarm")))
    target = F.when(F.col("kind") == "warning", 0.05).otherwise(0.01)
    return both.unpivot([], ["warning", "alarm"], "kind", "measured").select("kind", target.alias("target"), rounded("measured", 6).alias("measured"))


# what three modules say of each machine: failure from vibration, novelty from oil temperature, health from the scored view; each is silent about some
_ev = f"""{SCORED}, {LATEST}, fa AS (SELECT turbine_id, least(coalesce(vibration, 0.0) / 15, 1.0) AS failure_probability, (coalesce(vibration, 0.0) >= 9)::INT AS prediction FROM lt WHERE CAST(turbine_id AS BIGINT) % 7 <> 0),
an AS (SELECT turbine_id, oil_temperature / 100 AS anomaly_score, CASE WHEN oil_temperature >= 75 THEN 'alarm' WHEN oil_temperature >= 65 THEN 'warning' ELSE 'normal' END AS anomaly_severity, 0.9 AS anomaly_quality FROM lt WHERE CAST(turbine_id AS BIGINT) % 5 <> 0),
he AS (SELECT turbine_id, score AS health_score, health_class, 1 - coalesce(degradation_level, 0.0) / 2 AS health_quality, operational_status FROM lt WHERE CAST(turbine_id AS BIGINT) % 3 <> 0),
ev AS (SELECT * FROM fa FULL JOIN an USING (turbine_id) FULL JOIN he USING (turbine_id)),
e1 AS (SELECT *, (CASE WHEN failure_probability IS NOT NULL THEN 0.5 ELSE 0.0 END + CASE WHEN anomaly_score IS NOT NULL THEN 0.3 ELSE 0.0 END + CASE WHEN health_score IS NOT NULL THEN 0.2 ELSE 0.0 END)::DOUBLE AS coverage,
coalesce(prediction = 1, false)::INT + coalesce(health_class = 'critical', false)::INT + coalesce(anomaly_severity = 'alarm', false)::INT AS severe,
(coalesce(failure_probability, 0.0) * 0.5 + coalesce(anomaly_score, 0.0) * 0.3 + coalesce(1 - health_score / 100, 0.0) * 0.2)::DOUBLE AS w, coalesce(least(health_quality, anomaly_quality), 1.0)::DOUBLE AS quality FROM ev WHERE failure_probability IS NOT NULL OR anomaly_score IS NOT NULL OR health_score IS NOT NULL),
e2 AS (SELECT *, round_even(w / coverage, 6) AS score FROM e1), e3 AS (SELECT *, CASE WHEN severe > 0 THEN 'high' WHEN (coalesce(health_class IN ('monitor', 'degraded'), false) OR coalesce(anomaly_severity = 'warning', false)) AND score < 0.3 THEN 'medium' WHEN score < 0.3 THEN 'low' WHEN score < 0.65 THEN 'medium' ELSE 'high' END AS risk FROM e2),
e4 AS (SELECT *, CASE WHEN coverage >= 1 - 1e-9 AND quality >= 0.9 THEN 'high' WHEN coverage >= 0.8 - 1e-9 AND quality >= 0.75 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN coalesce(operational_status = 'fault', false) OR severe >= 2 THEN 0 WHEN severe >= 1 OR risk = 'high' THEN 1 WHEN risk = 'medium' THEN 2 ELSE 3 END AS step FROM e3)"""


def modules(spark, d):
    lt = latest(spark, d)
    number = F.col("turbine_id").cast("long")
    vib = F.coalesce("vibration", F.lit(0.0))
    failure = lt.filter(number % 7 != 0).select("turbine_id", F.least(vib / 15, F.lit(1.0)).alias("failure_probability"), (vib >= 9).cast("int").alias("prediction"))
    oil = F.col("oil_temperature")
    novel = lt.filter(number % 5 != 0).select("turbine_id", (oil / 100).alias("anomaly_score"), anomaly.severity(oil, F.lit(65.0), F.lit(75.0)).alias("anomaly_severity"), F.lit(0.9).alias("anomaly_quality"))
    well = lt.filter(number % 3 != 0).select("turbine_id", F.col("score").alias("health_score"), "health_class", (1 - F.coalesce("degradation_level", F.lit(0.0)) / 2).alias("health_quality"), "operational_status")
    return fusion.join_evidence(failure, novel, well)


def assessed(spark, d):
    return fusion.fused(modules(spark, d))


@query("p1_fused_risk", f"WITH {_ev} SELECT turbine_id, {S.r('coverage')} AS coverage, {S.r('quality')} AS quality, score, severe, risk, confidence FROM e4")
def p1(spark, d):
    return assessed(spark, d).select("turbine_id", rounded("coverage").alias("coverage"), rounded("quality").alias("quality"), "score", "severe", "risk", "confidence")


_actions = "CASE step WHEN 0 THEN 'immediate_engineering_review' WHEN 1 THEN 'urgent_review' WHEN 2 THEN 'plan_inspection' ELSE 'routine_monitoring' END"
_hours = "CASE step WHEN 0 THEN 8 WHEN 1 THEN 48 WHEN 2 THEN 168 END"


@query("p7_maintenance_queue", f"WITH {_ev} SELECT turbine_id, {_actions} AS action, {_hours} AS within_hours, 3 - step AS priority, score, risk FROM e4")
def p7(spark, d):
    return fusion.queue(assessed(spark, d)).select("turbine_id", "action", "within_hours", "priority", "score", "risk")


@query("p2_guardrails", f"WITH {_ev} SELECT turbine_id, concat_ws(',', CASE WHEN prediction = 1 THEN 'failure_prediction_positive' END, CASE WHEN health_class <> 'healthy' THEN 'health_' || health_class END, CASE WHEN anomaly_severity <> 'normal' THEN 'anomaly_' || anomaly_severity END) AS guardrails, concat_ws(',', CASE WHEN anomaly_score IS NULL THEN 'anomaly' END, CASE WHEN failure_probability IS NULL THEN 'failure' END, CASE WHEN health_score IS NULL THEN 'health' END) AS missing FROM e4")
def p2(spark, d):
    return assessed(spark, d).select("turbine_id", F.array_join("guardrails", ",").alias("guardrails"), F.array_join("missing", ",").alias("missing"))


_why = """concat_ws('; ', CASE WHEN prediction = 1 THEN 'failure model crossed its threshold' END, CASE WHEN health_class <> 'healthy' THEN 'health class is ' || health_class END, CASE WHEN anomaly_severity = 'alarm' THEN 'anomaly score crossed its alarm limit' END, CASE WHEN anomaly_severity = 'warning' THEN 'anomaly score crossed its warning limit' END,
CASE WHEN failure_probability IS NULL OR anomaly_score IS NULL OR health_score IS NULL THEN 'no evidence from ' || concat_ws(', ', CASE WHEN anomaly_score IS NULL THEN 'anomaly' END, CASE WHEN failure_probability IS NULL THEN 'failure' END, CASE WHEN health_score IS NULL THEN 'health' END) END, CASE WHEN quality < 0.75 THEN 'low data quality' END)"""


@query("n5_advice", f"WITH {_ev}, ad AS (SELECT turbine_id, replace({_actions}, '_', ' ') AS a, {_hours} AS h, {_why} AS w FROM e4) SELECT turbine_id, a || CASE WHEN h IS NULL THEN ' at the normal cadence' ELSE ' within ' || h || ' hours' END || CASE WHEN w = '' THEN '' ELSE ': ' || w END || '. Advisory only.' AS advice FROM ad")
def n5(spark, d):
    return explain.advice(assessed(spark, d)).select("turbine_id", "advice")


@query("p8_coverage_status", f"WITH {_ev} SELECT count(*) AS machines, count(failure_probability) AS failure_known, count(anomaly_score) AS anomaly_known, count(health_score) AS health_known, {S.r('count(failure_probability) / count(*)::DOUBLE', 6)} AS failure_share, {S.r('count(anomaly_score) / count(*)::DOUBLE', 6)} AS anomaly_share, {S.r('count(health_score) / count(*)::DOUBLE', 6)} AS health_share FROM ev")
def p8(spark, d):
    return rounded_all(fusion.coverage_status(modules(spark, d)))


_weights = " UNION ALL ".join(f"SELECT 'weight' AS kind, '{m}' AS name, {w}::DOUBLE AS value, count({c}) AS machines FROM e4" for (m, w), c in zip(fusion.WEIGHTS.items(), ("failure_probability", "anomaly_score", "health_score")))
_steps = " UNION ALL ".join(f"SELECT 'action_hours', '{a}', {h or 'NULL'}::DOUBLE, count(*) FILTER (step = {i}) FROM e4" for i, (a, h) in enumerate(fusion.ACTIONS))


@query("p10_policy", f"WITH {_ev} {_weights} UNION ALL {_steps}")
def p10(spark, d):
    """The policy's weights and deadlines, with the machines that each concerns."""
    return fusion.policy_in_use(fusion.policy(spark), assessed(spark, d)).select("kind", "name", "value", "machines")


@query("q24_evidence_rows", f"WITH {_ev} SELECT turbine_id, 'failure' AS module, {S.r('failure_probability')} AS value, failure_probability IS NOT NULL AS available FROM e4 UNION ALL SELECT turbine_id, 'anomaly', {S.r('anomaly_score')}, anomaly_score IS NOT NULL FROM e4 UNION ALL SELECT turbine_id, 'health', {S.r('health_score')}, health_score IS NOT NULL FROM e4")
def q24(spark, d):
    return fusion.evidence_rows(assessed(spark, d)).withColumn("value", rounded("value"))


@query("p5_target_components", f"WITH {_ev}, fc AS (SELECT turbine_id, 'drivetrain' AS component FROM lt WHERE vibration >= 9 UNION SELECT turbine_id, 'lubrication' FROM lt WHERE oil_temperature >= 65 UNION SELECT turbine_id, 'gearbox' FROM lt WHERE health_class <> 'healthy') SELECT turbine_id, string_agg(component, ',' ORDER BY component) AS components FROM fc GROUP BY 1")
def p5(spark, d):
    lt = latest(spark, d)
    factors = lt.filter("vibration >= 9").select("turbine_id", F.lit("vibration_mean_24h").alias("feature")).unionByName(lt.filter("oil_temperature >= 65").select("turbine_id", F.lit("oil_temperature_lag_6h").alias("feature")))
    unwell = lt.select("turbine_id", F.lit("gearbox").alias("component"), "health_class")
    return fusion.target_components(factors, unwell).withColumn("components", F.array_join("components", ","))


_probs = f"{S.MACHINES}, {_lastrow}, sp AS (SELECT turbine_id, least(coalesce(vibration, 0.0) / 15, 1.0) AS p FROM la)"


def machine_scores(spark, d):
    return health.latest_per_machine(keyed(spark, d)).select("turbine_id", F.least(F.coalesce("vibration", F.lit(0.0)) / 15, F.lit(1.0)).alias("p"))


@query("q1_risk_counts", f"WITH {_probs}, b AS (SELECT CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.65 THEN 'medium' ELSE 'high' END AS r FROM sp) SELECT t.risk, t.rank, count(b.r) AS n FROM {S.values([(x, i) for i, x in enumerate(fleet.LEVELS)], 'risk, rank')} LEFT JOIN b ON b.r = t.risk GROUP BY 1, 2")
def q1(spark, d):
    return fleet.risk_counts(machine_scores(spark, d))


@query("q2_executive_summary", f"WITH {_probs} SELECT count(*) AS machines, count(*) FILTER (p >= 0.65) AS high, {S.r('avg(p)')} AS mean_p, (SELECT turbine_id FROM sp ORDER BY p DESC, turbine_id DESC LIMIT 1) AS riskiest FROM sp")
def q2(spark, d):
    return fleet.executive_summary(machine_scores(spark, d)).withColumn("mean_p", rounded("mean_p"))


@query("n6_riskiest", f"WITH {_probs} SELECT {S.r('max(p)')} AS p FROM sp")
def n6(spark, d):
    return explain.riskiest(machine_scores(spark, d)).select(rounded("p").alias("p"))


@query("q4_time_slice", f"WITH {S.EVENTS} SELECT turbine_id, ordinal, {S.r('vibration')} AS vibration FROM raw WHERE turbine_id = '7' AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-20'")
def q4(spark, d):
    ntz = lambda x: F.lit(x).cast("timestamp_ntz")
    return fleet.time_slice(T.events(spark, d), "7", ntz("2024-01-10"), ntz("2024-01-20")).select(*ID, rounded("vibration").alias("vibration"))


@query("q5_last_history", f"WITH {S.MACHINES} SELECT turbine_id, ordinal, {S.r('power_output')} AS power_output, {S.r('lag(power_output, 24) ' + S.LAG)} AS power_output_lag_24h, {S.r(S.rolling('vibration', 24, 'mean'))} AS vibration_mean_24h FROM m QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp DESC, ordinal DESC) <= 1200")
def q5(spark, d):
    """The last 1,200 rows of every machine with features beside them."""
    from ..operators import nested

    rows = keyed(spark, d)
    made = {"power_output_lag_24h": W.lag("power_output", 24), "vibration_mean_24h": W.rolling("vibration", 24, "mean")}
    out = fleet.history_with_features(nested.last_rows(rows, 1200), X.with_bounded(rows, made, 24), list(made))
    return out.select(*ID, *(rounded(c).alias(c) for c in ("power_output", *made)))


@query("q7_attention", f"WITH {SCORED}, {LATEST} SELECT count(*) FILTER (health_class <> 'healthy') AS needs_attention, {S.r('avg(raw - score)')} AS mean_deduction, {S.r('avg((raw - score > 1e-6)::INT)', 6)} AS share_deducted FROM lt")
def q7(spark, d):
    return fleet.attention(latest(spark, d)).select("needs_attention", rounded("mean_deduction").alias("mean_deduction"), rounded("share_deducted", 6).alias("share_deducted"))


@query("q9_anomaly_ranking", f"WITH {_nov}, {_lastrow} SELECT turbine_id, {S.r('vibration')} AS novelty, CAST(rank() OVER (ORDER BY vibration DESC) AS INTEGER) AS rank FROM (SELECT * FROM nv QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp DESC, ordinal DESC) = 1)")
def q9(spark, d):
    rows = health.latest_per_machine(novelty(spark, d))
    return rows.select("turbine_id", rounded("novelty").alias("novelty"), F.rank().over(X.W.Window.orderBy(F.desc("novelty"))).alias("rank"))


_desc = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, {S.r(f'avg({c})')} AS mean, {S.r(f'stddev_samp({c})')} AS std, {S.r(f'min({c})')} AS min, {S.r(f'median({c})')} AS median, {S.r(f'max({c})')} AS max FROM m" for c in T.SENSORS)


@query("q10_describe", f"WITH {S.MACHINES} {_desc}")
def q10(spark, d):
    return rounded_all(fleet.describe(keyed(spark, d), list(T.SENSORS)), places=4)


@query("q12_class_balance", f"WITH {S.EVENTS}, l AS (SELECT {_target} AS target FROM m) SELECT target, count(*) AS n, {S.r('count(*) / sum(count(*)) OVER ()', 6)} AS share FROM l GROUP BY 1")
def q12(spark, d):
    return fleet.class_balance(labelled_events(spark, d), "target").withColumn("share", rounded("share", 6))


@query("q13_machine_positives", f"WITH {S.EVENTS}, l AS (SELECT turbine_id, failure_event, {_target} AS target FROM m) SELECT turbine_id, count(*) AS observations, CAST(sum(failure_event) AS BIGINT) AS failures, CAST(sum(target) AS BIGINT) AS positives, {S.r('avg(target)', 6)} AS positive_rate FROM l GROUP BY 1")
def q13(spark, d):
    return fleet.machine_positives(labelled_events(spark, d), "target").withColumn("positive_rate", rounded("positive_rate", 6))


_corr = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {S.r(f'corr({a}, {b})')} AS corr FROM m" for i, a in enumerate(_feat) for b in _feat[i + 1 :])


@query("q14_correlations", f"WITH {S.MACHINES} {_corr}")
def q14(spark, d):
    return fleet.correlations(keyed(spark, d), list(_feat)).withColumn("corr", rounded("corr"))


_means = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) FILTER (failure_event = 0) AS n, avg({c}) FILTER (failure_event = 1) AS p FROM m" for c in _feat)


@query("q15_class_means", f"WITH {S.MACHINES}, cm AS ({_means}) SELECT feature, {S.r('n')} AS negative, {S.r('p')} AS positive, {S.r('p - n')} AS difference, {S.r('100 * (p - n) / nullif(abs(n), 0)')} AS relative FROM cm")
def q15(spark, d):
    return rounded_all(fleet.class_means(keyed(spark, d), list(_feat), "failure_event"), places=4)


@query("q16_failure_profile", f"WITH {S.MACHINES} SELECT CAST(floor(hours_to_failure / 12) * 12 AS INTEGER) AS bucket, count(*) AS n, {', '.join(f'{S.r(f"avg({c})")} AS {c}' for c in _feat)} FROM m WHERE hours_to_failure BETWEEN 0 AND 240 GROUP BY 1")
def q16(spark, d):
    return rounded_all(fleet.failure_profile(keyed(spark, d), list(_feat)), places=4)


@query("q17_worst_timeline", f"WITH {S.MACHINES} SELECT turbine_id, ordinal, failure_event FROM m WHERE turbine_id = (SELECT turbine_id FROM m GROUP BY 1 ORDER BY sum(failure_event) DESC, turbine_id LIMIT 1)")
def q17(spark, d):
    return fleet.worst_timeline(keyed(spark, d)).select(*ID, "failure_event")


_tc = " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, failure_event::DOUBLE) AS c FROM m" for c in T.SENSORS)


@query("q18_target_correlations", f"WITH {S.MACHINES}, tc AS ({_tc}) SELECT feature, {S.r('c')} AS corr FROM tc WHERE c IS NOT NULL ORDER BY abs(c) DESC, feature LIMIT 25")
def q18(spark, d):
    return fleet.target_correlations(keyed(spark, d), list(T.SENSORS), "failure_event").withColumn("corr", rounded("corr"))


@query("q20_sampled_curve", f"WITH {S.MACHINES} SELECT turbine_id, ordinal, {S.r('wind_speed')} AS wind_speed, {S.r('power_output')} AS power_output FROM m WHERE (ordinal % 1000003 * 7919 + 42) % 1000 < 100")
def q20(spark, d):
    return fleet.sampled_curve(keyed(spark, d)).select(*ID, rounded("wind_speed").alias("wind_speed"), rounded("power_output").alias("power_output"))


@query("q25_positives_on_timeline", f"WITH {S.EVENTS}, l AS (SELECT *, {_target} AS target FROM m) SELECT turbine_id, ordinal FROM l WHERE target = 1")
def q25(spark, d):
    return labelled_events(spark, d).filter("target = 1").select(*ID)


@query("m18_dataset_summary", f"WITH {S.EVENTS}, {SPLIT}, l AS (SELECT *, {_target} AS target FROM s) SELECT count(*) AS rows, count(DISTINCT turbine_id) AS machines, min(t) AS first, max(t) AS last, {S.r('avg(target)', 6)} AS positive_rate, {', '.join(f'''count(*) FILTER (split = '{x}') AS {x}_rows''' for x in ('train', 'valid', 'test'))} FROM l")
def m18(spark, d):
    from ..operators import labels

    rows = labelled_events(spark, d)
    return fleet.dataset_summary(labels.assign_splits(rows, labels.split_bounds(rows))).withColumn("positive_rate", rounded("positive_rate", 6))


@query("n3_background", f"WITH {S.MACHINES}, b AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, median({c}) AS median, stddev_samp({c}) AS deviation FROM m''' for c in _feat)}) SELECT feature, {S.r('median')} AS median, {S.r('deviation')} AS deviation FROM b")
def n3(spark, d):
    return rounded_all(explain.background(keyed(spark, d), list(_feat)), places=4)


_imp = ", ".join(f"('{c}', {i + 1}.0)" for i, c in enumerate(_feat))


@query("n2_attributions", f"WITH {S.MACHINES}, b AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, median({c}) AS median, stddev_samp({c}) AS deviation FROM m''' for c in _feat)}), {_lastrow}, lo AS (UNPIVOT (SELECT turbine_id, {', '.join(f'coalesce({c}, {chr(39)}NaN{chr(39)}::DOUBLE) AS {c}' for c in _feat)} FROM la) ON {', '.join(_feat)} INTO NAME feature VALUE value), im AS (SELECT turbine_id, feature, CASE WHEN isnan(value) THEN 0.0 ELSE w * (value - median) / deviation END AS impact FROM lo JOIN b USING (feature) JOIN (VALUES {_imp}) i(feature, w) USING (feature)) SELECT turbine_id, CAST(row_number() OVER (PARTITION BY turbine_id ORDER BY abs(impact) DESC, feature) AS INTEGER) AS rank, feature, {S.r('impact')} AS impact FROM im QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY abs(impact) DESC, feature) <= 5")
def n2(spark, d):
    rows = keyed(spark, d)
    weights = spark.createDataFrame([(c, i + 1.0) for i, c in enumerate(_feat)], "feature string, importance double")
    return explain.attributions(health.latest_per_machine(rows), weights, explain.background(rows, list(_feat)), list(_feat)).withColumn("impact", rounded("impact"))


@query("q3_fleet_table", f"WITH {_probs}, top AS (SELECT turbine_id, feature FROM ({ORACLES['n2_attributions']}) WHERE rank = 1) SELECT turbine_id, {S.r('p')} AS p, CASE WHEN p < 0.65 THEN 'medium' ELSE 'high' END AS risk, feature AS top_factor FROM sp LEFT JOIN top USING (turbine_id) WHERE p >= 0.4")
def q3(spark, d):
    """Machines of medium and high risk from 0.4 on, with the factor that moves each most."""
    rows = keyed(spark, d)
    weights = spark.createDataFrame([(c, i + 1.0) for i, c in enumerate(_feat)], "feature string, importance double")
    factors = explain.attributions(health.latest_per_machine(rows), weights, explain.background(rows, list(_feat)), list(_feat))
    return fleet.fleet_table(machine_scores(spark, d), factors, least_p=0.4).withColumn("p", rounded("p"))


def _named(pattern: str, text: str) -> str:
    """SQL for the text of a name that fits."""
    out = "'" + text.replace("'", "''") + "'"
    for i in (0, 1):
        out = out.replace(f"{{{i}}}", f"' || replace(regexp_extract(f, '{pattern}', {i + 1}), '_', ' ') || '")
    return out


_case = f"CASE {' '.join(f'WHEN f = {chr(39)}{n}{chr(39)} THEN {chr(39)}{t}{chr(39)}' for n, t in explain.NAMED.items())} {' '.join(f'WHEN regexp_matches(f, {chr(39)}{p}{chr(39)}) THEN {_named(p, t)}' for p, t in explain.TEMPLATES)} ELSE replace(f, '_', ' ') END"
# names of features: statistics over hours, and what has no hours
_spans = ("lag", "mean", "median", "std", "range", "max", "min", "slope", "rate", "change", "diff", "off_mean")
_whole = ("off_past", "off_median", "off_normal", "robust_z", "regime_z", "z", "cusum_up", "ewma", "signals", "max_exceedance", "exceedance", "above_ambient", "rms", "crossings", "per_load", "of_no_pattern")
_fixed = tuple(explain.NAMED)[:6]


@query("n4_feature_labels", f"""WITH {S.EVENTS}, n AS (SELECT DISTINCT 'status_' || operational_status AS f FROM m
UNION SELECT DISTINCT 'vibration_' || s || '_' || (k % 24) || 'h' FROM m, {S.values([(x,) for x in _spans], 's').replace(') t(', ') q(')}
UNION SELECT DISTINCT 'oil_pressure_' || s FROM m, {S.values([(x,) for x in _whole], 's').replace(') t(', ') q(')} UNION SELECT DISTINCT s FROM m, {S.values([(x,) for x in _fixed], 's').replace(') t(', ') q(')}) SELECT f AS feature, {_case} AS label FROM n""")
def n4(spark, d):
    rows = keyed_events(spark, d)
    each = lambda names, made: F.explode(F.transform(F.array(*map(F.lit, names)), made))
    names = rows.select(F.concat(F.lit("status_"), "operational_status").alias("feature")).distinct()
    hours = rows.select((F.col("k") % 24).cast("string").alias("h")).distinct()
    names = names.union(hours.select(each(_spans, lambda s: F.concat(F.lit("vibration_"), s, F.lit("_"), "h", F.lit("h")))))
    there = rows.limit(1)
    names = names.union(there.select(each(_whole, lambda s: F.concat(F.lit("oil_pressure_"), s)))).union(there.select(each(_fixed, lambda s: s)))
    return names.distinct().select("feature", explain.feature_label("feature").alias("label"))


_ = (CLASS, INTERACTIONS, POWER, scored)
