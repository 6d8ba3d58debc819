"""Null-safe arithmetic and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Averages of a few cent amounts land exactly on rounding ties, where engines disagree. The
# nudge lifts ties over the edge so that the same value comes out everywhere.
TIE_NUDGE = 1e-9


def rnd(col: Column, digits: int = 2) -> Column:
    return F.round(col + F.lit(TIE_NUDGE), digits)


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def pct_change(now: Column, then: Column) -> Column:
    """Change from ``then`` to ``now`` in percent; null unless ``then`` is positive."""
    return F.when(then > 0, (now - then) / then * 100)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def present(col: Column) -> Column:
    """1.0 where the value exists, else 0.0: weights of null-aware means."""
    return F.when(col.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
