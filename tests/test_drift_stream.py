"""The monitor that waits for stragglers: as the batch, however rows arrive within the delay."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vanewright.operators import drift
from vanewright.streaming import drift_monitor

START = datetime(2024, 1, 1)
SERIES = "turbine_id string, sensor string, timestamp timestamp, ordinal long, z double"


def drained(spark, parts, tmp_path, name, **more):
    """What the stream gives of files that arrive one a batch."""
    source = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SERIES).coalesce(1).write.mode("append").parquet(str(source / f"part={i:03d}"))
    stream = spark.readStream.schema(SERIES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    query = drift_monitor.monitor_in_order(stream, "6 hours", **more).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(150)
    assert query.exception() is None
    return spark.table(name)


def charts(frame):
    cell = lambda v: None if v is None or v != v else v.hex()
    return sorted((r["turbine_id"], r["sensor"], r["timestamp"], r["ordinal"], cell(r["cusum_up"]), cell(r["cusum_down"]), cell(r["ewma"])) for r in frame.collect())


def test_shuffled_arrival_gives_the_batch(spark, tmp_path):
    rng = random.Random(6)
    # a row arrives up to five hours after its time; two rows share a time now and then
    rows = [(m, "vibration", START + timedelta(hours=i // 2 if i % 9 == 0 else i / 2), i, None if rng.random() < 0.1 else rng.gauss(1 if m == "A" else 0, 2)) for m in "AB" for i in range(60)]
    arrival = sorted(rows, key=lambda r: r[2] + timedelta(hours=5 * rng.random()))
    parts = [arrival[i : i + 30] for i in range(0, len(arrival), 30)]
    parts.append([(m, "vibration", START + timedelta(days=9), 1000, 0.0) for m in "AB"])  # moves the watermark past all others
    got = charts(drained(spark, parts, tmp_path, "in_order"))
    want = charts(drift.control_charts(spark.createDataFrame(rows, SERIES)))
    assert got == want


def test_late_rows_are_left_out_and_idle_series_begin_anew(spark, tmp_path):
    day = timedelta(days=1)
    parts = [
        [("A", "vibration", START, 1, 3.0)],
        [("B", "vibration", START + 2 * day, 1, 1.0)],
        [("B", "vibration", START + 2 * day, 2, 1.0)],  # A's row is folded
        [("A", "vibration", START - timedelta(hours=1), 2, 3.0), ("B", "vibration", START + 2 * day, 3, 1.0)],  # A's is late
        [("B", "vibration", START + 8 * day, 4, 1.0)],  # A has been idle
        [("A", "vibration", START + 9 * day, 3, 3.0)],
        [("B", "vibration", START + 11 * day, 5, 1.0)],
    ]
    rows = drained(spark, parts, tmp_path, "idle", idle_hours=48)
    a = [(r["ordinal"], r["cusum_up"]) for r in rows.filter(F.col("turbine_id") == "A").orderBy("ordinal").collect()]
    assert a == [(1, 2.5), (3, 2.5)]
