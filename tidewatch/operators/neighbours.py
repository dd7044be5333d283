"""Previous and next row in an entity's value order, without one task per entity.

``lag``/``lead`` over a whole entity puts all of its rows in one task. Here the
order is cut into ranges shared by all entities (quantiles of the ordering value;
a value heavy enough to fill a range is cut further by its tie-break). Windows run
inside (entity, range); only the first and last row of each range travel on to
link neighbouring ranges. The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that one range should hold, over all entities, and the bounds of the number of ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1 << 20, 64, 1024


def _count_below(c: Column, edges: Sequence, strict: bool) -> Column:
    """How many of the sorted edges lie below ``c`` (or at it), by halving."""
    if not edges:
        return F.lit(0)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        below = F.lit(edges[mid]) < c if strict else F.lit(edges[mid]) <= c
        return F.when(below, search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(edges))


def range_cuts(df: DataFrame, value: str, tie: str, ranges: int | None = None) -> tuple[Column, Column]:
    """Two columns that split the order (value, tie) into ranges.

    The edges are a bounded sketch (``ranges`` numbers) read to the driver.
    """
    ranges = ranges or max(LEAST_RANGES, min(MOST_RANGES, df.count() // RANGE_ROWS))
    steps = [i / ranges for i in range(1, ranges)]
    marks = df.agg(
        F.percentile_approx(F.col(value).cast("double"), steps, 10 * ranges).alias("v"),
        F.percentile_approx(F.col(tie).cast("double"), steps, 10 * ranges).alias("t"),
    ).first()
    edges = marks["v"] or []
    heavy = sorted({a for a, b in zip(edges, edges[1:]) if a == b})
    cuts = sorted(set(edges))
    v = F.col(value).cast("double")
    below, upto = _count_below(v, cuts, True), _count_below(v, cuts, False)
    main = below + upto  # odd at an edge value, even between edges
    if not heavy:
        return main.cast("int"), F.lit(0)
    ties = _count_below(F.col(tie).cast("double"), sorted(set(marks["t"])), False)
    return main.cast("int"), F.when(v.isin(heavy), ties).otherwise(0).cast("int")


def with_neighbours(
    df: DataFrame,
    entity: str,
    value: str,
    tie: Sequence[str],
    carry: Sequence[str],
    ranges: int | None = None,
) -> DataFrame:
    """Adds ``prev`` and ``next`` structs of ``carry`` in (value, tie) order.

    ``tie`` starts with a numeric column; rows with a NULL value come first. The
    number of ranges follows the counted rows.
    """
    main, sub = range_cuts(df, value, tie[0], ranges)
    df = df.withColumns({"_r": F.coalesce(main, F.lit(-1)), "_s": F.coalesce(sub, F.lit(0))})
    order = [value, *tie]
    inside = Window.partitionBy(entity, "_r", "_s").orderBy(*order)
    here = F.struct(*carry)
    df = df.withColumns({"_p": F.lag(here).over(inside), "_n": F.lead(here).over(inside)})

    rank = F.struct(*order)
    ends = df.groupBy(entity, "_r", "_s").agg(
        F.min_by(here, rank).alias("_first"), F.max_by(here, rank).alias("_last")
    )
    along = Window.partitionBy(entity).orderBy("_r", "_s")
    links = ends.select(
        entity, "_r", "_s",
        F.lag("_last").over(along).alias("_before"),
        F.lead("_first").over(along).alias("_after"),
    )
    joined = df.join(links, [entity, "_r", "_s"])
    return joined.withColumns(
        {"prev": F.coalesce("_p", "_before"), "next": F.coalesce("_n", "_after")}
    ).drop("_r", "_s", "_p", "_n", "_before", "_after")
