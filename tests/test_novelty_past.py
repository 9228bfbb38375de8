"""Drift scores that go into the multivariate novelty have the operator's whole past."""

import os

import pytest
from pyspark.sql import functions as F

from vanewright.operators import drift
from vanewright.operators import regimes as G
from vanewright.plans import cleaning_queries, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_novelty_is_given_where_72_rows_of_past_are(spark):
    frame = G.with_regime(cleaning_queries.keyed(spark, DATA))
    z = drift.residuals(frame, G.producing(frame), least=72)
    whole = z.groupBy("turbine_id", "timestamp", "ordinal").agg(F.count("z").alias("n")).filter(F.col("n") == len(drift.SENSORS))
    want = {(r["turbine_id"], r["ordinal"]) for r in whole.collect()}
    got = {(r["turbine_id"], r["ordinal"]) for r in registry.queries()["j13_multivariate_novelty"](spark, DATA).collect()}
    assert want and got == want
