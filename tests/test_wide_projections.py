"""Signal shape without sliding aggregates, and wide projections in short methods."""

import random

from pyspark.sql import functions as F

from vanewright.functions.expressions import each
from vanewright.operators import features as X


def test_each_gives_what_single_columns_give(spark):
    names = [f"c{i}" for i in range(30)]
    frame = spark.createDataFrame([[None if i == j else i * 1.5 + j for j in range(30)] for i in range(5)], ", ".join(f"{n} double" for n in names))
    f = lambda x: F.when(x > 20, x * 2)
    made = frame.select(*each(names, f))
    assert made.columns == names and made.dtypes == frame.dtypes
    assert sorted(map(str, made.collect())) == sorted(map(str, frame.select(*(f(F.col(n)).alias(n) for n in names)).collect()))
    assert "transform(" in made._jdf.queryExecution().optimizedPlan().toString()


def test_shape_has_no_sliding_aggregate_and_counts_turns(spark):
    rng = random.Random(6)
    rows = [(m, t, *(None if rng.random() < 0.1 else rng.choice((3.0, rng.random())) for _ in X.SHAPED)) for m in ("a", "b", "c") for t in range(40 if m != "c" else 1)]
    frame = spark.createDataFrame(rows, "turbine_id string, timestamp long, " + ", ".join(f"{c} double" for c in X.SHAPED))
    out, names = X.with_shape(frame)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame, -23" not in plan and out.columns == [*frame.columns, *names]
    c, n = X.SHAPED[0], 24
    got = {(r["turbine_id"], r["timestamp"]): r[f"{c}_crossings"] for r in out.collect()}
    for m in ("a", "b", "c"):
        x = [r[2] for r in rows if r[0] == m]
        sides, turns = [], []
        for t in range(len(x)):
            seen = [v for v in x[max(0, t - n + 1) : t + 1] if v is not None]
            side = None if x[t] is None or len(seen) < 12 else (lambda d: (d > 0) - (d < 0))(round(x[t] - sum(seen) / len(seen), 9))
            turns.append(float(t > 0 and side is not None and sides[-1] is not None and side != sides[-1]))
            sides.append(side)
            last = turns[max(0, t - n + 1) :]
            assert abs(got[m, t] - sum(last) / len(last)) < 1e-12, (m, t)
