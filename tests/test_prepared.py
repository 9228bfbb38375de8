"""Prepared tables join on their key, and windows by machine run, without a shuffle."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vanewright.operators import features, fleet, fusion, models, rules
from vanewright.sources import files, prepared


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    # one machine has most rows; keys repeat in neither table but where added
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 10)).alias("turbine_id"), F.col("id").alias("timestamp"))
    labels = rows.select("*", F.element_at(F.array(*map(F.lit, ("train", "valid", "test"))), (F.col("timestamp") % 3 + 1).cast("int")).alias("split"), (F.col("timestamp") % 5).alias("target"))
    matrix = rows.filter("timestamp % 7 <> 0").withColumn("x", F.col("timestamp") / 2)
    odd = spark.createDataFrame([(None, 1, 0.0), ("hot", None, 0.0), ("hot", 1, -1.0)], "turbine_id string, timestamp long, x double")
    return labels, matrix.unionByName(odd)


def test_join_of_prepared_tables_has_no_exchange(spark, tables):
    labels, matrix = tables
    made = prepared.write_aligned({"labels": labels, "features": matrix}, buckets=8)
    joined = models.with_labels(made["features"], made["labels"], "target")
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert "Exchange" in plan(models.with_labels(matrix, labels, "target"))
    both = [sorted(map(tuple, models.with_labels(f, t, "target").collect())) for f, t in ((made["features"], made["labels"]), (matrix, labels))]
    assert both[0] == both[1] and sum(r[:2] == ("hot", 1) for r in both[0]) == 2
    # the large machine's rows lie in all buckets
    spread = made["labels"].filter("turbine_id = 'hot'").groupBy(F.input_file_name()).count()
    assert spread.count() == 8
    parts = models.to_split_data(made["features"], made["labels"], "target")
    assert sum(p.count() for p in parts.values()) == len(both[0])


def test_tables_by_machine_feed_windows_without_exchange(spark, tables):
    made = prepared.write_aligned({"labels": tables[0]}, ("turbine_id",), 4)["labels"]
    w = Window.partitionBy("turbine_id").orderBy("timestamp")
    out = made.withColumn("before", F.lag("target").over(w))
    assert "Exchange" not in plan(out)
    want = tables[0].withColumn("before", F.lag("target").over(w))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_odd_tables(spark, tables):
    with pytest.raises(ValueError, match="labels has no turbine_id"):
        prepared.write_aligned({"labels": tables[0].drop("turbine_id")})
    empty = prepared.write_aligned({"labels": tables[0].limit(0), "features": tables[1]}, buckets=2)
    assert models.with_labels(empty["features"], empty["labels"], "target").count() == 0
    with pytest.raises(ValueError, match="no target other"):
        models.with_labels(*reversed(tables), "other")


def test_parts_by_split_read_their_own_files(spark, tables, tmp_path):
    path = files.write_prepared(tables[0], str(tmp_path / "p"))
    valid = spark.read.parquet(path).filter("split = 'valid'")
    assert "PartitionFilters: [isnotnull(split" in plan(valid) and valid.count() == tables[0].filter("split = 'valid'").count()


def test_loading_checks_columns(spark, tables, tmp_path):
    path = files.write_table(tables[0], str(tmp_path / "t.parquet"))
    loaded = files.load_telemetry(spark, path, ("turbine_id", "timestamp"))
    assert loaded.select("ordinal").distinct().count() == 4000
    with pytest.raises(files.MissingColumns, match="vibration"):
        files.load_telemetry(spark, path, ("turbine_id", "vibration"))


def test_small_reports(spark):
    assert [tuple(r) for r in features.history_status(spark.createDataFrame([("a",)] * 3 + [("b",)], "turbine_id string"), 2).orderBy("turbine_id").collect()] == [("a", 3, 2, True), ("b", 1, 2, False)]
    rows = spark.createDataFrame([("a", 1, 1, 8.0), ("a", 2, 2, 7.5), ("a", 3, 3, None)], "turbine_id string, timestamp long, ordinal long, vibration double")
    rows = rows.withColumns({s: F.lit(None).cast("double") for s in rules.SENSORS if s != "vibration"})
    got = {r["sensor"]: (r["readings"], r["past_warning"]) for r in rules.rule_records(rules.rule_table(spark), rows).collect()}
    assert len(got) == len(rules.RULES) and got.pop("vibration") == (2, 1) and set(got.values()) == {(0, 0)}
    some = spark.createDataFrame([("a", 0.5, None, None, "urgent_review"), ("b", 0.1, 0.2, None, "urgent_review")], "turbine_id string, failure_probability double, anomaly_score double, health_score double, action string")
    used = {r["name"]: r["machines"] for r in fusion.policy_in_use(fusion.policy(spark), some).collect()}
    assert used == {"failure": 2, "anomaly": 1, "health": 0, "immediate_engineering_review": 0, "urgent_review": 2, "plan_inspection": 0, "routine_monitoring": 0}
    scored = spark.createDataFrame([("a", 0.7), ("b", 0.5), ("c", 0.1)], "turbine_id string, p double")
    factors = spark.createDataFrame([("a", 1, "f"), ("a", 2, "g")], "turbine_id string, rank int, feature string")
    assert sorted(map(tuple, fleet.fleet_table(scored, factors).collect())) == [("a", 0.7, "high", "f"), ("b", 0.5, "medium", None)]
