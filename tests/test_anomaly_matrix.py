"""The anomaly matrix has every trend of every dynamic sensor."""

import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vanewright.operators import features
from vanewright.plans import registry
from vanewright.plans import sql as S

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
SENSORS = ("vibration", "gearbox_temperature", "bearing_temperature", "generator_temperature", "oil_temperature", "oil_pressure", "hydraulic_pressure", "power_output", "rotor_speed")


def test_anomaly_matrix_is_whole(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    want = {f"{c}_{s}_{h}h": S.rolling(c, h, s) for c in SENSORS for h in (6, 24, 72) for s in ("mean", "std")}
    want |= {f"{c}_diff_{h}h": f"{c} - lag({c}, {h}) {S.LAG}" for c in SENSORS for h in (6, 24)} | {f"{c}_slope_{h}h": S.slope(c, h) for c in SENSORS for h in (24, 72)}
    out = registry.queries()["l1_anomaly_features"](spark, DATA)
    made = [c for c in out.columns if re.search(r"_\d+h$", c)]
    assert sorted(made) == sorted(want) and len(made) == 54 + 18 + 18
    assert {c for c in out.columns if c.endswith("_regime_z")} == {f"{c}_regime_z" for c in SENSORS}
    assert set(features.SENSORS) < set(out.columns)
    rows = f"x AS (SELECT *, CAST(row_number() OVER ({S.BY}) AS DOUBLE) AS _row FROM m)"
    sql = con.execute(f"WITH {S.MACHINES}, {rows} SELECT turbine_id, ordinal, {', '.join(f'{e} AS {n}' for n, e in want.items())} FROM x").df()
    order = ["turbine_id", "ordinal"]
    got = out.select(*order, *(F.col(c).cast("double").alias(c) for c in want)).toPandas().sort_values(order)
    sql = sql.sort_values(order)
    assert len(got) == len(sql)
    np.testing.assert_allclose(got[list(want)].to_numpy(float), sql[list(want)].to_numpy(float), rtol=1e-6, atol=1e-6, equal_nan=True)


def test_physical_columns_are_unclipped(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    wind = "coalesce(wind_speed, 0.0)"
    want = {f"{c}_above_ambient": f"{c} - ambient_temperature" for c in ("generator_temperature", "gearbox_temperature", "bearing_temperature", "oil_temperature", "nacelle_temperature", "brake_temperature")}
    want |= {
        "power_residual": "power_output - ref",
        "power_ratio": "CASE WHEN ref > 1 THEN power_output / ref END",
        "generator_rotor_ratio": f"generator_speed / {S.at_least('abs(rotor_speed)', 0.5)}",
        "vibration_per_load": f"vibration / ({S.at_least('power_output', 0.0)} / 2000.0 + 0.1)",
        "oil_pressure_per_temperature": f"oil_pressure / {S.at_least('abs(oil_temperature)', 1.0)}",
    }
    ref = f"CASE WHEN {wind} >= 3 AND {wind} < 12.5 THEN 2000 * pow(({wind} - 3) / 9.5, 3) WHEN {wind} >= 12.5 AND {wind} <= 25 THEN 2000.0 ELSE 0.0 END"
    out = registry.queries()["l1_anomaly_features"](spark, DATA)
    order = ["turbine_id", "ordinal"]
    assert len([c for c in out.columns if c not in (*order, "timestamp")]) == 130
    got = out.select(*order, *want).toPandas().sort_values(order)
    sql = con.execute(f"WITH {S.MACHINES}, x AS (SELECT *, {ref} AS ref FROM m) SELECT turbine_id, ordinal, {', '.join(f'{e} AS {n}' for n, e in want.items())} FROM x").df().sort_values(order)
    np.testing.assert_allclose(got[list(want)].to_numpy(float), sql[list(want)].to_numpy(float), rtol=1e-6, atol=1e-6, equal_nan=True)
