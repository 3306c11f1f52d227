"""Rounding that does not depend on the last bits of a sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """``x`` as a double rounded half up, by way of a decimal: a half stays one whatever order it was added up in."""
    return F.round(x.cast("decimal(28,9)"), places).cast("double")
