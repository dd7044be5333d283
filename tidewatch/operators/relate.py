"""Joins and key-set comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.periods import month_offset
from tidewatch.session import cut_lineage


def entity_star(account: DataFrame, disp: DataFrame, loan: DataFrame, client: DataFrame, card: DataFrame) -> DataFrame:
    """Accounts with their dispositions, loan, client and card; only those with a loan.

    Outer joins keep incomplete sides; the closing filter on ``loan_id`` lets the
    optimiser narrow them.
    """
    star = account.join(disp, "account_id", "outer").join(loan, "account_id", "left")
    star = star.join(client, "client_id", "outer").join(card, "disp_id", "outer")
    return star.filter(F.col("loan_id").isNotNull())


def new_only(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet; known keys are reduced before they move."""
    return df.join(existing.select(key).distinct(), key, "left_anti")


#: Rows of one key that one task may join.
ROWS_PER_TASK = 1_000_000
#: Keys that are split, at most: the heaviest ones. Over that many, the others are light beside them.
MOST_HEAVY = 100_000


def heavy_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int) -> DataFrame | None:
    """(keys, _salts): how many parts each key with more than ``rows_per_task`` rows is split into; None if there
    is no such key. The table is counted, bounded and so broadcast."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
    parts = F.ceil(F.col("_n") / rows_per_task).cast("int")
    heavy = cut_lineage(sizes.orderBy(F.desc("_n"), *keys).limit(MOST_HEAVY).select(*keys, parts.alias("_salts")))
    return None if heavy.isEmpty() else F.broadcast(heavy)


def trace(
    activities: DataFrame,
    trx: DataFrame,
    entity: str,
    anchor: str,
    before: int = 0,
    after: int = 0,
    months_before: int = 0,
    months_after: int = 1,
    relevant: Column | None = None,
    ts: str = "txn_ts",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Transactions behind each activity.

    For an activity anchored at date d: rows of the same entity with
    ``d - months_before - before days <= ts < d + months_after + after days``.
    ``relevant`` marks the rows that made a feature fire.

    The range is cut into calendar months, so the join has the equi key (entity,
    month) and an entity's rows spread over its months. An entity-month with more than
    ``rows_per_task`` rows, by count, is split further, and only the activities that meet it are repeated.
    """
    d = F.col(anchor).cast("date")
    low = F.date_sub(F.add_months(d, -months_before), before)
    high = F.date_add(F.add_months(d, months_after), after)
    acts = activities.withColumns({"_low": low, "_high": high}).withColumn(
        "_month", F.explode(F.sequence(month_offset(F.col("_low")), month_offset(F.date_sub(F.col("_high"), 1))))
    )
    rows = trx.withColumn("_month", month_offset(F.col(ts)))
    keys = [entity, "_month"]
    heavy = heavy_keys(rows, keys, rows_per_task)
    if heavy is not None:
        acts = acts.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
        spread = F.pmod(F.xxhash64(*trx.columns), F.coalesce("_salts", F.lit(1))).cast("int")
        rows = rows.join(heavy, keys, "left").withColumn("_salt", spread).drop("_salts")
        keys.append("_salt")
    day = F.col(ts).cast("date")
    out = acts.join(rows, keys).filter((day >= F.col("_low")) & (day < F.col("_high")))
    flag = F.lit(True) if relevant is None else F.coalesce(relevant, F.lit(False))
    return out.withColumn("is_relevant", flag).drop("_low", "_high", "_month", "_salt")


def trace_features(
    activities: DataFrame, trx: DataFrame, entity: str, anchor: str, relevant: Mapping[str, Column | None], **kw
) -> DataFrame:
    """The traces of several features from one join: (activity, feature, transaction).

    ``relevant`` maps a feature to its own predicate over transactions; None traces
    every row, as the global trace does. A row is listed once for each feature that it is relevant to.
    """
    rows = trace(activities, trx, entity, anchor, **kw).drop("is_relevant")
    marks = [F.when(F.lit(True) if p is None else F.coalesce(p, F.lit(False)), F.lit(name)) for name, p in relevant.items()]
    return rows.withColumn("feature", F.explode(F.array_compact(F.array(*marks))))


def trace_group(
    activities: DataFrame, members: DataFrame, trx: DataFrame, group: str, entity: str, anchor: str, **kw
) -> DataFrame:
    """Trace of group activities: the rows of every member of the group."""
    return trace(activities.join(members.select(group, entity), group), trx, entity, anchor, **kw)


def join_report(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Row counts, unique keys, unmatched rows and match rates of a join, unjoined.

    Both sides are reduced to rows per key first; the size of the join is the sum
    of products, so a hot key costs one row.
    """
    a = left.groupBy(F.col(left_key).alias("k")).agg(F.count(F.lit(1)).alias("l"))
    b = right.groupBy(F.col(right_key).alias("k")).agg(F.count(F.lit(1)).alias("r"))
    keys = a.join(b, a.k.eqNullSafe(b.k), "full").select(
        F.coalesce(a.k, b.k).alias("k"), F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r")
    )
    keep_l, keep_r = how in ("left", "outer"), how in ("right", "outer")
    known = F.col("k").isNotNull()
    rows = F.when((F.col("l") > 0) & (F.col("r") > 0), F.col("l") * F.col("r"))
    if keep_l:
        rows = rows.when((F.col("l") > 0) & (F.col("r") == 0), F.col("l"))
    if keep_r:
        rows = rows.when((F.col("r") > 0) & (F.col("l") == 0), F.col("r"))
    joined_key = F.when(rows.isNotNull() & known, 1)
    no_l, no_r = F.when(F.col("r") == 0, F.col("l")), F.when(F.col("l") == 0, F.col("r"))

    def num(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    out = keys.agg(
        num(F.col("l")).alias("left_rows"),
        num(F.col("r")).alias("right_rows"),
        num(rows).alias("joined_rows"),
        F.count(F.when(known & (F.col("l") > 0), 1)).alias("left_unique_keys"),
        F.count(F.when(known & (F.col("r") > 0), 1)).alias("right_unique_keys"),
        F.count(joined_key).alias("joined_unique_keys"),
        (num(no_l) if keep_l else F.lit(0).cast("long")).alias("left_unmatched"),
        (num(no_r) if keep_r else F.lit(0).cast("long")).alias("right_unmatched"),
    )

    def rate(side: str) -> Column:
        share = F.try_divide(F.col(f"{side}_unmatched"), F.col(f"{side}_rows"))
        return F.round(F.coalesce((1 - share) * 100, F.lit(0.0)), 2).alias(f"match_rate_{side}")

    return out.select("*", rate("left"), rate("right"))


def key_coverage(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """For each ordered pair of tables: shared and missing keys, coverage and status."""
    names = list(tables)
    tagged = [
        t.select(F.col(key).alias("k"), *[F.lit(int(n == name)).alias(f"n{i}") for i, n in enumerate(names)])
        for name, t in tables.items()
    ]
    flags = reduce(DataFrame.unionAll, tagged).groupBy("k").agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))]
    )

    def n(i: int) -> Column:
        return F.col(f"n{i}") > 0

    pairs = [(i, j) for i in range(len(names)) for j in range(len(names)) if i != j]
    sums = flags.agg(
        *[F.count(F.when(n(i), 1)).alias(f"k{i}") for i in range(len(names))],
        *[F.sum(f"n{i}").alias(f"rows{i}") for i in range(len(names))],
        *[F.count(F.when(n(i) & n(j), 1)).alias(f"o{i}_{j}") for i, j in pairs],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(names[i]).alias("left_table"),
                F.lit(names[j]).alias("right_table"),
                F.col(f"rows{i}").alias("left_rows"),
                F.col(f"k{i}").alias("left_keys"),
                F.col(f"o{i}_{j}").alias("overlap"),
            )
            for i, j in pairs
        ]
    )
    missing = F.col("left_keys") - F.col("overlap")
    return (
        sums.select(F.explode(rows).alias("p")).select("p.*")
        .withColumns(
            {
                "missing": missing,
                "coverage_pct": F.round(F.coalesce(F.try_divide("overlap", "left_keys"), F.lit(0.0)) * 100, 2),
                "status": F.when(missing == 0, "PASS").otherwise("FAIL"),
            }
        )
    )


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop duplicates, keeping the smallest row by ``order``; decomposable."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)
