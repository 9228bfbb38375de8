"""Labels that go along with the telemetry: the parts of a join by key, without one."""

import pytest
from pyspark.sql import functions as F

from vanewright.operators import features as X
from vanewright.operators import models, regimes

from test_passes import telemetry


def labelled(spark):
    rows = telemetry(spark)
    split = F.when(F.col("ordinal") < 30, "train").when(F.col("ordinal") < 45, "valid").otherwise("test")
    return rows.withColumns({"split": split, "target": (F.col("ordinal") % 3 == 0).cast("int"), "health_score": F.col("ordinal") * 1.0})


def plain(parts):
    return {s: sorted(tuple(str(r[c]) for c in sorted(p.columns)) for r in p.collect()) for s, p in parts.items()}


def test_carried_labels_give_the_parts_of_a_join(spark):
    rows = labelled(spark)
    matrix, spec = X.failure_features(rows, carry=("split", "target"))
    alone, same = X.failure_features(rows)
    assert spec == same and matrix.columns == [*alone.columns, "split", "target"]
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    own = models.to_split_data(matrix, None, "target")
    joined = models.to_split_data(alone, rows.select("turbine_id", "timestamp", "split", "target"), "target")
    assert {s: sorted(p.columns) for s, p in own.items()} == {s: sorted(p.columns) for s, p in joined.items()} and plain(own) == plain(joined)
    with pytest.raises(ValueError, match="no target"):
        models.to_split_data(matrix.drop("target"), None, "target")


def test_other_matrices_carry_labels_too(spark):
    rows = regimes.with_regime(labelled(spark))
    health, spec = X.health_features(rows, carry=("split", "health_score"))
    anomaly, names = X.anomaly_features(rows, carry=("split", "target"))
    assert "health_score" not in [n for b in spec.values() for n in b] and "target" not in names
    for made, label in ((health, "health_score"), (anomaly, "target")):
        want = {(r["turbine_id"], r["ordinal"]): (r["split"], r[label]) for r in rows.collect()}
        assert {(r["turbine_id"], r["ordinal"]): (r["split"], r[label]) for r in made.select("turbine_id", "ordinal", "split", label).collect()} == want
