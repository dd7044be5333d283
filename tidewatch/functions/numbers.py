"""Sums and means whose rounding does not depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mean(value: Column, digits: int, scale: int = 6) -> Column:
    """Mean rounded half up, added up in decimals of ``scale`` digits.

    A mean of doubles that lies on a rounding border would fall to either side
    with the order of the additions.
    """
    return F.round(F.avg(value.cast(f"decimal(26,{scale})")), digits).cast("double")
