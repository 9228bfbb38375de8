"""Pieces of SQL that the oracles share."""

from __future__ import annotations

from ..sources.telemetry import events_sql, keyed_sql, machines_sql

BY = "PARTITION BY turbine_id ORDER BY timestamp"
PAST = f"OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
LAG = f"OVER ({BY})"
#: Telemetry with one row per key; the raw views with all rows.
MACHINES = f"raw AS ({machines_sql()}), m AS ({keyed_sql('SELECT * FROM raw')})"
EVENTS = f"raw AS ({events_sql()}), m AS ({keyed_sql('SELECT * FROM raw')})"


def last(n: int, by: str = BY) -> str:
    return f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def r(x: str, places: int = 4) -> str:
    return f"round({x}, {places}) + 0.0"


STATS = {"mean": "avg({x})", "std": "stddev_samp({x})", "min": "min({x})", "max": "max({x})", "median": "quantile_cont({x}, 0.5)", "sum": "sum({x})"}


def rolling(x: str, n: int, stat: str, least: int | None = None, by: str = BY) -> str:
    least = max(n // 2, 1) if least is None else least
    w = last(n, by)
    value = f"max({x}) {w} - min({x}) {w}" if stat == "range" else f"{STATS[stat].format(x=x)} {w}"
    return f"CASE WHEN count({x}) {w} >= {least} THEN {value} END"


def slope(x: str, n: int) -> str:
    w = last(n)
    return f"CASE WHEN count({x}) {w} >= {max(n // 2, 2)} THEN regr_slope({x}, _row) {w} END"


def expanding(x: str, stat: str, least: int, past: str = PAST) -> str:
    return f"CASE WHEN count({x}) {past} >= {least} THEN {STATS[stat].format(x=x)} {past} END"


def clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) < {low} THEN {low} WHEN ({x}) > {high} THEN {high} ELSE ({x}) END"


def at_least(x: str, low: float) -> str:
    return f"CASE WHEN ({x}) < {low} THEN {low} ELSE ({x}) END"


def values(rows, names: str) -> str:
    """A table of literals."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, row)) + ')' for row in rows)}) t({names})"
