"""Prepared outputs: labelled rows and feature matrices as tables that join on their key without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .shared import bucketed

KEY = ("turbine_id", "timestamp")


def write_aligned(tables: dict[str, DataFrame], key: tuple[str, ...] = KEY, buckets: int | None = None) -> dict[str, DataFrame]:
    """The frames, written to the shared folder as tables that are bucketed and sorted alike by the key, so that rows
    of one key are found by a merge of buckets and not by their position. Each table is shuffled once, when written.

    With time in the key a machine's rows lie in all buckets, and one with a third of all rows is no hot task. A key of
    the machine alone keeps it in one bucket: then windows by machine need no shuffle either, which is meant for tables
    without a very large machine. Rows that repeat a key stay; null keys are kept and join with nothing. `buckets` is
    the session's number of shuffle partitions unless given."""
    out = {}
    for name, frame in tables.items():
        missing = [c for c in key if c not in frame.columns]
        if missing:
            raise ValueError(f"{name} has no {missing[0]}")
        n = buckets or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # rows are dealt to tasks as they are to buckets, so each task writes one file
        out[name] = bucketed(frame.repartition(n, *key), f"prepared-{name}", key, n)
    return out
