"""The telemetry contract, and views that bind it to the tables at hand.

A telemetry table has one row per machine and time: the key (turbine_id, timestamp), an `ordinal` that keeps the order
of arrival, sensor columns, a status and an event flag. `events` and `lineitem` are read as such tables by projections
alone, so filters and column pruning reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sensors and the range of each that is physically possible.
RANGES = {
    "wind_speed": (0.0, 45.0),
    "rotor_speed": (0.0, 25.0),
    "generator_speed": (0.0, 2200.0),
    "power_output": (-100.0, 3600.0),
    "generator_temperature": (-30.0, 200.0),
    "gearbox_temperature": (-30.0, 160.0),
    "bearing_temperature": (-30.0, 160.0),
    "oil_temperature": (-30.0, 130.0),
    "oil_pressure": (0.0, 12.0),
    "vibration": (0.0, 25.0),
    "ambient_temperature": (-45.0, 55.0),
    "nacelle_temperature": (-45.0, 90.0),
    "hydraulic_pressure": (0.0, 300.0),
    "brake_temperature": (-30.0, 400.0),
}
SENSORS = tuple(RANGES)
#: Allowed states of a machine, in order.
STATUSES = ("normal", "idle", "derated", "maintenance", "fault")
KEY = ("turbine_id", "timestamp")
REQUIRED = (*KEY, *SENSORS, "operational_status", "failure_event")

#: The machine view as expressions over `lineitem` that Spark and DuckDB read alike. Values are scaled by pi so that
#: averages have no decimal ties; every so often a reading is missing or impossible, as in real telemetry.
MACHINE = {
    "turbine_id": "cast(l_suppkey as string)",
    "timestamp": "l_shipdate",
    "ordinal": "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey",
    "wind_speed": "case when l_orderkey % 101 = 0 then -5.0 else l_quantity * pi() / 6.4 end",
    "rotor_speed": "l_quantity * pi() / 9 + l_discount * 10",
    "generator_speed": "(l_quantity * pi() / 9 + l_discount * 10) * 95",
    "power_output": "l_extendedprice * pi() / 150",
    "generator_temperature": "60 + l_discount * 800 * pi() / 3",
    "gearbox_temperature": "case when l_orderkey % 41 = 0 then null else 40 + l_tax * 600 * pi() / 3 end",
    "bearing_temperature": "case when l_orderkey % 103 = 0 then 500.0 else 35 + (l_partkey % 50) * pi() / 3 end",
    "oil_temperature": "30 + (l_orderkey % 50) * pi() / 3",
    "oil_pressure": "case when l_orderkey % 29 = 0 then null else 2 + l_discount * 40 * pi() / 3 end",
    "vibration": "case when l_orderkey % 37 = 0 then null else l_quantity * pi() / 15 + l_discount * 10 end",
    "ambient_temperature": "(l_partkey % 35) - 5 + pi() / 10",
    "nacelle_temperature": "(l_partkey % 35) - 5 + l_tax * 100 * pi()",
    "hydraulic_pressure": "100 + (l_orderkey % 97) * pi() / 3",
    "brake_temperature": "20 + (l_partkey % 90) * pi()",
    "operational_status": "case when l_returnflag = 'R' and l_linenumber = 1 then 'fault' when l_returnflag = 'A' and l_linenumber = 2 then 'maintenance' "
    "when l_linenumber = 3 then 'idle' when l_linenumber = 4 then 'derated' else 'normal' end",
    "failure_event": "case when l_returnflag = 'R' and l_linenumber = 1 then 1 else 0 end",
    "degradation_level": "case when l_linenumber = 7 then null else l_discount * 8 end",
    "hours_to_failure": "case when l_linenumber = 6 then null else (l_partkey % 300) * 1.0 end",
}
#: The event view: one channel, status by event type.
EVENTS = {
    "turbine_id": "cast(user_id as string)",
    "timestamp": "ts",
    "ordinal": "event_id",
    "vibration": "case when event_id % 37 = 0 then null else value * pi() / 10 end",
    "k": "cast({json} as int)",
    "operational_status": "case event_type when 'click' then 'normal' when 'view' then 'idle' when 'purchase' then 'derated' when 'signup' then 'maintenance' when 'error' then 'fault' end",
    "failure_event": "case when event_type = 'error' then 1 else 0 end",
}
SPARK_JSON, DUCK_JSON = "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-sensor telemetry over `lineitem`, with repeated keys as they come."""
    return read(spark, sf_dir, "lineitem").select(*(F.expr(e).alias(c) for c, e in MACHINE.items()))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-channel telemetry over `events`."""
    return read(spark, sf_dir, "events").select(*(F.expr(e.format(json=SPARK_JSON)).alias(c) for c, e in EVENTS.items()))


def micros(column: str = "timestamp") -> F.Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def machines_sql() -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in MACHINE.items()) + " FROM lineitem"


def events_sql() -> str:
    return "SELECT " + ", ".join(f"{e.format(json=DUCK_JSON)} AS {c}" for c, e in EVENTS.items()) + " FROM events"


def keyed_sql(view: str) -> str:
    """One row per key: the first to arrive."""
    return f"SELECT * FROM ({view}) WHERE turbine_id IS NOT NULL AND timestamp IS NOT NULL QUALIFY row_number() OVER (PARTITION BY turbine_id, timestamp ORDER BY ordinal) = 1"
