"""Rounding as the study tables do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Half away from zero for x >= 0. A hair is added, so that ties that binary fractions just miss go up, as decimals do."""
    return F.round(x + 10.0 ** -(digits + 6), digits)
