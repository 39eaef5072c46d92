"""Scoring arithmetic on columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero(value: Column) -> Column:
    """Missing or unreadable numbers count as 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def zero_int(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(0))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def cap1(value: Column) -> Column:
    return F.least(F.lit(1.0), value)


def smoothstep(low: float, high: float, value: Column) -> Column:
    t = clamp01((value - low) / (high - low))
    return t * t * (3.0 - 2.0 * t)


def logistic(value: Column, centre: float, scale: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(value - centre) / scale))


def weighted(*terms: tuple[Column, float]) -> Column:
    """Sum of ``column * weight`` in the order given."""
    total = None
    for column, weight in terms:
        part = column * F.lit(weight)
        total = part if total is None else total + part
    return total


def joined_notes(*rules: tuple[Column, str]) -> Column:
    """Comma list of the notes whose condition holds, in rule order."""
    return F.concat_ws(",", *[F.when(cond, F.lit(note)) for cond, note in rules])
