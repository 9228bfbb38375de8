"""Fitting, calibrating, scoring and comparing, on small tables made for it."""

import pytest
from pyspark.sql import functions as F

from vanewright.functions.ordered import with_running
from vanewright.operators import drift, metrics, models
from vanewright.sources import files, shared


@pytest.fixture(scope="module")
def parts(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("turbine_id"), F.col("id").alias("timestamp"), ((F.col("id") * 7919) % 3000 / 3000.0).alias("a"), F.when(F.col("id") % 11 > 0, (F.col("id") % 7).cast("double")).alias("b"))
    rows = rows.withColumns({"target": (F.col("a") > 0.85).cast("int"), "split": F.element_at(F.array(*map(F.lit, ("train", "train", "valid", "test"))), (F.col("timestamp") % 4 + 1).cast("int"))})
    return models.to_split_data(rows.select("turbine_id", "timestamp", "a", "b"), rows, "target")


def test_parts_and_errors(spark, parts):
    assert {s: p.count() for s, p in parts.items()} == {"train": 1500, "valid": 750, "test": 750}
    features = parts["train"].select("turbine_id", "timestamp", "a")
    with pytest.raises(ValueError, match="no target"):
        models.to_split_data(features, parts["train"].drop("target"), "target")
    with pytest.raises(ValueError, match="valid is empty"):
        models.to_split_data(features, parts["train"], "target")


def test_fit_calibrate_compare_save(spark, parts, tmp_path):
    fitted, table = models.train_failure_models(parts, ["a", "b"], small=True)
    rows = {r["model"]: r for r in table.collect()}
    assert set(rows) == {"dummy", "logistic_regression", "random_forest", "gradient_boosting"}
    assert rows["random_forest"]["pr_auc"] > 0.95 > 0.5 > rows["dummy"]["pr_auc"]
    model = fitted["random_forest"]
    valid = models.scored(model, parts["valid"])
    for method in ("sigmoid", "isotonic"):
        out = models.calibrator(valid, method)(valid)
        assert out.filter("p < 0 or p > 1").count() == 0 and metrics.roc_auc(out.select(F.col("target").alias("y"), "p")).first()[0] > 0.95
    assert models.calibrator(valid.filter("target = 0")) is None
    with pytest.raises(ValueError, match="no calibration"):
        models.calibrator(valid, "other")
    compared = models.compared({"random_forest": model}, parts, table).collect()
    assert sorted((r["model"], r["split"]) for r in compared) == [(m, s) for m in ("dummy", "random_forest") for s in ("test", "train", "valid")]
    assert {(r["model"], r["rank"]) for r in compared} == {("random_forest", 1), ("dummy", 2)}
    for r in compared:
        if r["model"] == "random_forest":
            one = models.scored(model, parts[r["split"]]).select(F.col("target").alias("y"), "p")
            want = metrics.classification_metrics(one, rows["random_forest"]["threshold"]).first()
            assert (r["recall"], r["precision"], r["f2"]) == (want["recall"], want["precision"], want["f2"]) and r["rows"] == parts[r["split"]].count()
            assert r["brier"] == pytest.approx(want["brier"]) and r["pr_auc"] == pytest.approx(metrics.pr_auc(one).first()[0]) and r["roc_auc"] == pytest.approx(metrics.roc_auc(one).first()[0])
    with pytest.raises(ValueError, match="no feature b"):
        models.score_prepared(model, parts["test"].drop("b"), ["a", "b"])
    files.save_model(model, str(tmp_path / "m"))
    again = models.scored(files.load_model(str(tmp_path / "m")), parts["test"])
    assert again.join(models.scored(model, parts["test"]).select("timestamp", F.col("p").alias("q")), "timestamp").filter("p <> q").count() == 0


def test_health_models_and_vectors(spark, parts):
    named = {s: p.withColumn("health_score", 100 - 50 * F.col("a")) for s, p in parts.items()}
    _, table = models.train_health_models(named, ["a", "b"], small=True)
    mae = {r["model"]: r["mae"] for r in table.collect()}
    assert mae["ridge"] < 1 and mae["random_forest"] < mae["mean"]
    rows = parts["train"].withColumn("c", F.lit(None).cast("double"))
    out = models.robust_vectors(rows, rows, ["a", "b", "c"]).select("x").first()[0]
    assert len(out) == 3 and all(v == v for v in out)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("before", [False, True])
def test_running_sums(spark, descending, before):
    values = [(i * 37 % 500) / 7.0 for i in range(500)] + [None]
    frame = spark.createDataFrame([(v, 1 if v is None else int(v) + 1) for v in values], "k double, n int")
    got = {r["k"]: r["s"] for r in with_running(frame, "k", {"s": F.col("n")}, descending, before).collect()}
    want, total = {}, 0
    for k, n in sorted(((v, 1 if v is None else int(v) + 1) for v in values), key=lambda r: (r[0] is not None, r[0] or 0), reverse=descending):
        want[k] = total if before else total + n
        total += n
    assert got == want
    assert with_running(frame.limit(0), "k", {"s": F.col("n")}).count() == 0


def test_novelty_adds_points(spark):
    stats = spark.createDataFrame([("A", 1, 1, "vibration", 5.0, 0.0), ("A", 2, 2, "vibration", 0.0, 0.0)], "turbine_id string, timestamp long, ordinal long, sensor string, signals double, ewma double")
    novel = spark.createDataFrame([("A", 1, 0.9), ("A", 2, 0.7)], "turbine_id string, timestamp long, novelty double")
    got = {r["timestamp"]: r["penalty"] for r in drift.row_penalties(stats, None, novel).collect()}
    assert got == {1: 10.0, 2: 5.0}


def test_a_bundle_serves_what_was_trained(spark, parts, tmp_path):
    train = models.with_weight(parts["train"], "target", models.class_weight(parts["train"], "target"))
    fitted = models.failure_candidates(["a", "b"])["logistic_regression"].fit(train)
    bundle = models.bundled("logistic_regression", fitted, parts, ["a", "b"])
    # the closed form is the estimator's calibration, and the threshold is the least cost of calibrated scores
    raw = models.scored(fitted, parts["valid"])
    want = {r["timestamp"]: r["p"] for r in models.calibrator(raw)(raw).collect()}
    got = bundle.scored(parts["valid"])
    assert all(r["p"] == pytest.approx(want[r["timestamp"]], abs=1e-9) for r in got.collect())
    judged = got.select(F.col("target").alias("y"), "p")
    assert bundle.threshold == metrics.choose_threshold(metrics.threshold_curve(judged)).first()["least_cost"]
    assert got.filter((F.col("p") >= bundle.threshold) != (F.col("prediction") == 1)).count() == 0
    again = models.Bundle.load(spark, bundle.save(spark, str(tmp_path / "bundle")))
    assert (again.name, again.sigmoid, again.threshold, again.features, again.summary) == (bundle.name, bundle.sigmoid, bundle.threshold, bundle.features, bundle.summary)
    assert again.summary["rows_and_positives"]["train"] == [1500, parts["train"].filter("target = 1").count()]
    rows = lambda b: sorted(tuple(r) for r in b.scored(parts["test"]).select("timestamp", "p", "prediction").collect())
    assert rows(again) == rows(bundle)
    with pytest.raises(ValueError, match="no feature b"):
        again.scored(parts["test"].drop("b"))
    with pytest.raises(ValueError, match="no bundle of format"):
        files.write_document(spark, {"format": 0}, str(tmp_path / "old/about"))
        models.Bundle.load(spark, str(tmp_path / "old"))


def test_kept_results_end_with_their_tables(spark, tmp_path):
    calls = []
    kept = shared.kept_until_removal(lambda spark, d, n=1: calls.append(n) or len(calls))
    spark.range(3).write.parquet(f"{tmp_path}/t/x.parquet")
    d = f"{tmp_path}/t"
    assert kept(spark, d) == kept(spark, d) == 1 and kept(spark, d, 2) == 2
    spark.range(4).write.mode("overwrite").parquet(f"{d}/x.parquet")
    assert kept(spark, d) == 3
    shared._kept.clear()
    assert kept(spark, d) == 4
