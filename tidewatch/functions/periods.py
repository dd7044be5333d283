"""Period arithmetic: offsets since 1970, their inverses, labels and date ranges.

Offsets are LONG so that window frames can use ``rangeBetween`` on them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Day 0 of every offset, and the first Monday after it.
EPOCH = dt.date(1970, 1, 1)
EPOCH_MONDAY = dt.date(1970, 1, 5)


def month_offset(c: Column) -> Column:
    """Whole months since January 1970."""
    return ((F.year(c) - 1970) * 12 + F.month(c) - 1).cast("long")


def day_offset(c: Column) -> Column:
    """Whole days since 1970-01-01."""
    return F.datediff(c, F.lit(EPOCH)).cast("long")


def week_offset(c: Column, first_day: dt.date = EPOCH_MONDAY) -> Column:
    """Whole weeks since ``first_day``; dates before it count down from -1."""
    return F.floor(F.datediff(c, F.lit(first_day)) / 7).cast("long")


def month_start(offset: Column) -> Column:
    return F.add_months(F.lit(EPOCH), offset.cast("int"))


def week_start(offset: Column) -> Column:
    return F.date_add(F.lit(EPOCH_MONDAY), (offset * 7).cast("int"))


def day_date(offset: Column) -> Column:
    return F.date_add(F.lit(EPOCH), offset.cast("int"))


def period_label(c: Column, level: str) -> Column:
    """``yyyy_MM`` for months, the Monday's date for weeks, the date for days."""
    if level == "month":
        return F.date_format(c, "yyyy_MM")
    if level == "week":
        return F.date_format(F.date_trunc("week", c), "yyyy-MM-dd")
    if level == "day":
        return F.date_format(c, "yyyy-MM-dd")
    raise ValueError(f"unknown period level {level!r}")


def period_number(c: Column, level: str, week_origin: dt.date = EPOCH) -> Column:
    """Running number of the period; weeks start on ``week_origin``'s weekday."""
    if level == "month":
        return month_offset(c)
    if level == "week":
        return week_offset(c, week_origin)
    if level == "day":
        return day_offset(c)
    raise ValueError(f"unknown period level {level!r}")


def _shift_months(d: dt.datetime, n: int) -> dt.datetime:
    m = d.year * 12 + d.month - 1 + n
    year, month = divmod(m, 12)
    last = (dt.datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return d.replace(year=year, month=month + 1, day=min(d.day, last))


@dataclass(frozen=True)
class DateRange:
    """Half-open range ``[start, end)``."""

    start: dt.datetime
    end: dt.datetime

    def apply(self, df: DataFrame, ts: str) -> DataFrame:
        """Keep the rows inside; bounds of the column's own type reach the scan."""
        dtype = df.schema[ts].dataType
        start, end = (F.lit(d).cast(dtype) for d in (self.start, self.end))
        return df.filter((F.col(ts) >= start) & (F.col(ts) < end))


def write_range(cadence: str, *, batch: str | None = None, train: tuple[str, str] | None = None) -> DateRange:
    """Periods a run writes: one batch period, or the whole training span."""
    if (batch is None) == (train is None):
        raise ValueError("give either a batch period or a training span")
    if cadence not in ("monthly", "weekly", "daily"):
        raise ValueError(f"unknown cadence {cadence!r}")
    if train is not None:
        start, end = (dt.datetime.fromisoformat(t) for t in train)
        return DateRange(start, end)
    start = dt.datetime.fromisoformat(f"{batch}-01" if len(batch) == 7 else batch)
    if cadence == "monthly":
        return DateRange(start, _shift_months(start, 1))
    if cadence == "weekly":
        if start.weekday() != 0:
            raise ValueError("a weekly batch starts on a Monday")
        return DateRange(start, start + dt.timedelta(weeks=1))
    return DateRange(start, start + dt.timedelta(days=1))


def read_range(cadence: str, look_back: int, **period) -> DateRange:
    """Write range widened backwards by ``look_back`` months (monthly) or days."""
    out = write_range(cadence, **period)
    if cadence == "monthly":
        return DateRange(_shift_months(out.start, -look_back), out.end)
    return DateRange(out.start - dt.timedelta(days=look_back), out.end)
