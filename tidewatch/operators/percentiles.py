"""Exact percentiles per group by radix selection.

Values become 64-bit keys in the same order. Rows are counted by the leading bits of the
key, the buckets that hold a wanted position are found by cumulating those counts, and
only rows of these buckets are counted by the next bits, and at last by value. A round
counts at most 2^22 buckets for each group or bucket it descends into, whatever the number
of rows, so no group is held or sorted in one task, and no sketch or estimate is used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.order import with_order_key
from tidewatch.session import shuffled, stored

#: Bits of the key that the second and the third round resolve; the first takes the rest.
SECOND, THIRD = 21, 21


def _indexes(probs: Mapping[str, float], method: str) -> list[tuple[str, Column]]:
    """(output, 0-based position among the sorted rows) for every probability."""
    total = F.col("_total")
    out = []
    for name, p in probs.items():
        if method == "discrete":
            out.append((name, F.greatest(F.ceil(total * F.lit(float(p))) - 1, F.lit(0))))
        elif method == "linear":
            spot = (total - 1) * F.lit(float(p))
            out += [(f"_l_{name}", F.floor(spot)), (f"_h_{name}", F.ceil(spot))]
        else:
            raise ValueError(f"unknown method {method!r}")
    return out


def percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    method: str = "linear",
    few_groups: bool = False,
    count_first: bool = True,
    weight: str | None = None,
    counted: bool = False,
) -> DataFrame:
    """One row per group and one column per named probability; NULL values do not count.

    A row stands for as many values as its ``weight`` says (1 without).

    ``linear`` interpolates between neighbours; ``discrete`` takes the smallest
    value that covers the share. ``few_groups`` says that the number of groups is
    bounded by the caller (such as one per listed feature), so that the buckets of each round,
    at most two for each group and probability, are broadcast. With ``count_first`` the
    distinct values are counted and their keys made once, in shared storage, which all rounds read; without it
    ``df`` is read in each of the three rounds and nothing of its size is shuffled, which
    suits a plain scan with nearly as many values as rows. ``counted`` says that ``df`` holds each value hardly more
    than once, with its weight: then it is not counted again, but the keys are stored all the same.
    """
    by = list(by)
    small = F.broadcast if few_groups or not by else shuffled
    rows = df.filter(F.col(value).isNotNull())
    if count_first and not counted:
        rows = rows.groupBy(*by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    else:
        rows = rows.select(*by, value, (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))
    bits = {
        "_k1": F.shiftright("_key", SECOND + THIRD),
        "_k2": F.shiftright("_key", THIRD).bitwiseAND(F.lit((1 << SECOND) - 1)),
    }
    rows = with_order_key(rows, value, "_key").withColumns(bits).drop("_key")
    if count_first or counted:
        # else the joins' filters on the keys move below the count, and each round makes keys of all rows again
        rows = stored(rows)
    wanted = _indexes(probs, method)
    holds = F.lit(False)
    for _, index in wanted:
        holds = holds | ((index >= F.col("_before")) & (index < F.col("_before") + F.col("_rows")))

    def cumulated(within: Sequence[str], order: str) -> Column:
        along = Window.partitionBy(*(within or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return F.sum("_rows").over(along) - F.col("_rows")

    first = rows.groupBy(*by, "_k1").agg(F.sum("n").alias("_rows"))
    whole = F.sum("_rows").over(Window.partitionBy(*(by or [F.lit(0)])))
    first = first.withColumns({"_before": cumulated(by, "_k1"), "_total": whole}).filter(holds).select(*by, "_k1", "_before", "_total")

    inside = [*by, "_k1"]
    second = rows.join(small(first), inside).groupBy(*inside, "_k2", "_total", F.col("_before").alias("_start")).agg(F.sum("n").alias("_rows"))
    second = second.withColumn("_before", F.col("_start") + cumulated(inside, "_k2")).filter(holds).select(*inside, "_k2", "_before", "_total")

    inside = [*inside, "_k2"]
    third = rows.join(small(second), inside).groupBy(*inside, value, "_total", F.col("_before").alias("_start")).agg(F.sum("n").alias("_rows"))
    third = third.withColumn("_before", F.col("_start") + cumulated(inside, value))
    at = [F.min(F.when((index >= F.col("_before")) & (index < F.col("_before") + F.col("_rows")), F.col(value))).alias(name) for name, index in wanted]
    out = third.groupBy(*by).agg(*at, F.max("_total").alias("_total"))
    if method == "discrete":
        return out.drop("_total")
    cols = []
    for name, p in probs.items():
        spot = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_l_{name}"), F.col(f"_h_{name}")
        cols.append((low + (high - low) * (spot - F.floor(spot))).cast("double").alias(name))
    return out.select(*by, *cols)
