"""Window frames over period offsets and deviation from an entity's own past."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F


def history(entity: str, period: str, n: int) -> WindowSpec:
    """The ``n`` periods before the current one, by value: gaps stay gaps."""
    return Window.partitionBy(entity).orderBy(period).rangeBetween(-n, -1)


def trailing(entity: str, day: str, n: int) -> WindowSpec:
    """The current day and the ``n - 1`` calendar days before it."""
    return Window.partitionBy(entity).orderBy(day).rangeBetween(-(n - 1), 0)


def zscore(
    value: str,
    window: WindowSpec,
    digits: int = 2,
    clip: tuple[float, float] | None = (0, 5),
    method: str = "mean",
) -> Column:
    """Deviation from the window's centre in (rounded) sample deviations.

    Centre and spread are rounded before the division. Less than two periods
    of history, or a spread that rounds to zero, give NULL.
    """
    c = F.col(value)
    if method == "mean":
        centre = F.avg(c).over(window)
    elif method == "median":
        centre = F.percentile_approx(c, 0.5).over(window)
    else:
        raise ValueError(f"unknown method {method!r}")
    spread = F.round(F.stddev_samp(c).over(window), digits)
    z = F.round(F.try_divide(c - F.round(centre, digits), spread), digits)
    if clip is None:
        return z
    low, high = clip
    return F.when(z < low, F.lit(float(low))).when(z > high, F.lit(float(high))).otherwise(z)
