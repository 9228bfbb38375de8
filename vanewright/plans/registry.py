"""All registered queries by name, with the SQL that each is held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("cleaning_queries", "feature_queries", "condition_queries", "decision_queries", "model_queries")


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its SQL."""

    def add(f):
        FOUND[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict:
    load()
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    return FOUND["p7_maintenance_queue"](spark, sf_dir)
