"""Model queries fit whole candidates on whole matrices."""

import os

import pytest

from vanewright.operators import features, models, regimes
from vanewright.plans import cleaning_queries, model_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_whole_matrices(spark):
    frame = cleaning_queries.keyed(spark, DATA)
    _, failure = features.failure_features(frame)
    matrix, spec = features.health_features(regimes.with_regime(frame))
    assert sum(map(len, failure.values())) == 395
    assert {b: len(n) for b, n in spec.items()} == {"condition": 15, "rolling": 81, "trend": 36, "shape": 21, "relative": 12, "rule": 36, "drift": 25, "physical": 13}
    assert matrix.count() == frame.count()


@pytest.mark.parametrize("name, fit, n", [("m4", "train_failure_models", 395), ("k16", "train_health_models", 239), ("k18", "train_health_models", 239)])
def test_queries_train_whole_candidates(spark, monkeypatch, name, fit, n):
    class Asked(Exception):
        pass

    def asked(split, names, *rest, small=False, **more):
        raise Asked(len(names), small)

    monkeypatch.setattr(models, "to_split_data", lambda matrix, labels, target: {})
    monkeypatch.setattr(models, fit, asked)
    with pytest.raises(Asked) as got:
        getattr(model_queries, name)(spark, DATA)
    assert got.value.args == (n, False)
