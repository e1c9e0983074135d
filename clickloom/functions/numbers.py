"""Ratios rounded half up to two places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_round(part: Column, whole: Column) -> Column:
    """``part / whole`` to two places, half up; NULL when ``whole`` is 0.

    Whole-number inputs keep the halves exact in binary, which rounding the
    quotient itself would not.
    """
    scaled = part * F.lit(100.0) / F.nullif(whole, F.lit(0))
    return F.floor(scaled + F.lit(0.5)) / F.lit(100.0)
