"""Rounding that gives the same digits on every run and every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, scale: int) -> Column:
    """Half-even rounding of a double. The detour over DECIMAL hides last-bit float noise."""
    return F.bround(value.cast("decimal(28,12)"), scale).cast("double")


def percent(part: Column, whole: Column, empty: int) -> Column:
    """Whole-number percentage, half-even; ``empty`` when there is nothing to divide by."""
    share = part.cast("double") * 100 / F.nullif(whole, F.lit(0)).cast("double")
    return F.coalesce(F.bround(share.cast("decimal(28,12)"), 0).cast("long"), F.lit(empty).cast("long"))
