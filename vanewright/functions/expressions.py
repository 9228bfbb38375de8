"""Column expressions with the null semantics that the operators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def holds(condition: Column) -> Column:
    """A comparison with a missing value does not hold."""
    return F.coalesce(condition, F.lit(False))


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bounded; a missing value stays missing (greatest and least would invent one)."""
    c = col(c)
    out = c
    if low is not None:
        out = F.when(c < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(c > high, F.lit(float(high))).otherwise(out)
    return out


def floor_of(c: Column | str, least: float) -> Column:
    """At least so much; missing stays missing."""
    c = col(c)
    return F.when(c < least, F.lit(float(least))).otherwise(c)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; missing where b is 0 or the result is not finite."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


#: Scaled values that rounded() takes by a product: far from a tie, and small enough that its error is far below that.
FAST, OFF_TIE = 1e9, 0.499999


def rounded(c: Column | str, places: int = 4) -> Column:
    """For results that are compared: rounded, without negative zero. Spark rounds a double by way of decimal text, which
    takes some 2 microseconds; away from ties the quotient of two whole numbers is the same double at a twentieth."""
    c = col(c)
    scaled = c * F.lit(10.0**places)
    near = F.rint(scaled)
    fast = (F.abs(scaled) < FAST) & (F.abs(scaled - near) < OFF_TIE)
    return F.when(fast, near / F.lit(10.0**places)).otherwise(F.round(c, places)) + F.lit(0.0)


def half_even_steps(hours: float, step_hours: float) -> int:
    """Rows in so many hours, rounded half to even, at least one."""
    return max(int(round(hours / step_hours)), 1)


def cyclical(value: Column | str, period: float) -> tuple[Column, Column]:
    angle = col(value) * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def one_hot(value: Column | str, levels) -> list[Column]:
    """0/1 columns in a fixed order of levels; a missing value is 0 in all."""
    return [holds(col(value) == level).cast("int").alias(f"is_{level}") for level in levels]


#: Columns of a projection from which one of them goes by_array().
WIDE = 20


def by_array(x: Column | str, f) -> Column:
    """f of one value by way of an array. Spark writes a narrow plan's projections as one method, which the JVM never
    compiles once it is long (some forty computed columns) but interprets, ten times slower. A projection with one such
    column is written as many short methods."""
    return F.transform(F.array(col(x)), f)[0]


def each(names: list[str], f) -> list[Column]:
    """f of every double column, under its name; wide projections in short methods."""
    return [(by_array(n, f) if i == 0 and len(names) > WIDE else f(F.col(n))).alias(n) for i, n in enumerate(names)]
