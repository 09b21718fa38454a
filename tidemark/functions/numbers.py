"""Rounding and guarded arithmetic that give the same double on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, dp: int = 4) -> Column:
    """``floor(x * 10**dp + 0.5) / 10**dp`` in doubles; null stays null."""
    k = float(10**dp)
    return F.floor(x.cast("double") * k + 0.5).cast("double") / k


def to_fixed(x: float, dp: int) -> float:
    """Rounding by the exact decimal value of the double, as printing does: 1.005 to 2 places is 1.0."""
    return float(f"{x:.{dp}f}")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def percent_change(now: Column, then: Column) -> Column:
    """Null where ``then`` is missing or not positive."""
    return F.when(then > 0, (now - then) / then * 100)
