"""Aggregated profiles of entities, accounts, columns and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch.operators.features import aggregate_measures, count, distinct, largest, total
from tidewatch.operators.percentiles import percentiles


def lookback_stats(
    df: DataFrame, entity: str, ts: str, anchor: str, value: str, n: int = 6, days: int = 30
) -> DataFrame:
    """Min, max and mean of ``value`` in the last 1..n blocks of days before ``anchor``.

    The mean is taken over distinct (value, blocks) pairs, as balances repeat on
    days without movement.
    """
    gap = F.datediff(F.col(anchor), F.col(ts))
    # block k holds gaps in [k*days, (k+1)*days); window x covers blocks 0..x-1
    rows = (
        df.withColumn("_gap", gap)
        .filter((F.col("_gap") > 0) & (F.col("_gap") < n * days))
        .select(entity, value, F.floor(F.col("_gap") / days).alias("_block"))
        .distinct()
    )
    aggs = []
    for x in range(1, n + 1):
        v = F.when(F.col("_block") < x, F.col(value))
        aggs += [F.min(v).alias(f"min{x}"), F.max(v).alias(f"max{x}"), F.round(F.avg(v), 4).alias(f"mean{x}")]
    return rows.groupBy(entity).agg(*aggs)


def customer_insights(df: DataFrame, entity: str, attributes: Sequence[str] = ()) -> DataFrame:
    """Monthly in/out counts and sums, countries by risk level, carried attributes.

    The first grouping keeps countries and attributes as keys, so the collected
    sets are built from a few rows per entity and month.
    """
    credit, debit = F.col("direction") == "credit", F.col("direction") == "debit"
    first = df.groupBy(entity, "month_offset", "cp_country_risk_level", "cp_jurisdiction", *attributes).agg(
        F.count(F.when(credit, 1)).alias("tr_in_count"), F.sum(F.when(credit, F.col("amount_usd"))).alias("tr_in"),
        F.count(F.when(debit, 1)).alias("tr_out_count"), F.sum(F.when(debit, F.col("amount_usd"))).alias("tr_out"),
    )

    def countries(level: str) -> Column:
        hit = F.when(F.col("cp_country_risk_level") == level, F.col("cp_jurisdiction"))
        return F.array_sort(F.collect_set(hit))

    start = F.add_months(F.lit("1970-01-01").cast("date"), F.col("month_offset").cast("int"))
    return (
        first.groupBy(entity, "month_offset")
        .agg(
            F.sum("tr_in_count").alias("tr_in_count"),
            F.round(F.sum("tr_in"), 2).alias("tr_in"),
            F.sum("tr_out_count").alias("tr_out_count"),
            F.round(F.sum("tr_out"), 2).alias("tr_out"),
            countries("High").alias("hr_cc"),
            countries("Medium").alias("mr_cc"),
            countries("Low").alias("lr_cc"),
            *[F.max(a).alias(a) for a in attributes],
        )
        .withColumns({"trx_to_date": start, "trx_from_date": F.add_months(start, -1)})
    )


def account_insights(
    versions: DataFrame, transfers: DataFrame, country_risk: DataFrame, alerts: DataFrame
) -> DataFrame:
    """One row per account from both sides of its transfers.

    ``versions``: account_id, name, country, tr_job_ts (one row per load);
    ``transfers``: account_id, receiver_id, amount, ts; ``country_risk``:
    country_code, risk; ``alerts``: account_id, state_id, resolution_code.
    """
    latest = versions.groupBy("account_id").agg(
        F.max_by(F.struct("name", "country"), "tr_job_ts").alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    home = latest.select("account_id", "_v.*", "_n").join(
        country_risk, F.col("country") == F.col("country_code"), "left"
    )
    place = home.select(F.col("account_id").alias("_id"), F.col("country").alias("_c"), F.col("risk").alias("_r"))
    # Both parties of a transfer see the countries of both sides.
    with_out = transfers.join(
        place.select(F.col("_id").alias("account_id"), F.col("_c").alias("_c1"), F.col("_r").alias("_r1")), "account_id", "left"
    )
    both = with_out.join(
        place.select(F.col("_id").alias("receiver_id"), F.col("_c").alias("_c2"), F.col("_r").alias("_r2")), "receiver_id", "left"
    )
    sides = F.array(
        F.struct(F.col("account_id").alias("id"), F.lit(False).alias("incoming")),
        F.struct(F.col("receiver_id").alias("id"), F.lit(True).alias("incoming")),
    )
    seen = both.select(F.explode(sides).alias("p"), "amount", "ts", "_c1", "_r1", "_c2", "_r2").select("p.*", "amount", "ts", "_c1", "_r1", "_c2", "_r2")

    def countries(level: str) -> Column:
        a = F.collect_set(F.when(F.col("_r1") == level, F.col("_c1")))
        b = F.collect_set(F.when(F.col("_r2") == level, F.col("_c2")))
        return F.array_sort(F.array_union(a, b))

    # per account, side and country pair first: a hot account shrinks before it moves
    first = seen.groupBy(F.col("id").alias("account_id"), "incoming", "_c1", "_r1", "_c2", "_r2").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"), F.min("ts").alias("t0"), F.max("ts").alias("t1")
    )
    incoming = F.col("incoming")
    flows = first.groupBy("account_id").agg(
        F.sum(F.when(incoming, F.col("n"))).alias("tr_in_count"),
        F.round(F.sum(F.when(incoming, F.col("s"))), 2).alias("tr_in"),
        F.sum(F.when(~incoming, F.col("n"))).alias("tr_out_count"),
        F.round(F.sum(F.when(~incoming, F.col("s"))), 2).alias("tr_out"),
        F.min("t0").alias("trx_from_date"),
        F.max("t1").alias("trx_to_date"),
        countries("High").alias("hr_cc"),
        countries("Medium").alias("mr_cc"),
        countries("Low").alias("lr_cc"),
    )
    closed = F.col("state_id") == "state_closed"
    cases = alerts.groupBy("account_id").agg(
        F.count(F.when(~closed, 1)).alias("tm_open"),
        F.count(F.when(closed, 1)).alias("tm_closed"),
        F.count(F.when(F.col("resolution_code") == "Non_Issue", 1)).alias("tm_false_positives"),
    )
    out = home.join(flows, "account_id", "left").join(cases, "account_id", "left")
    zero = ["tr_in_count", "tr_in", "tr_out_count", "tr_out", "tm_open", "tm_closed", "tm_false_positives"]
    empty = F.array().cast("array<string>")
    return out.select(
        "account_id",
        F.col("name").alias("kyc_name"),
        F.col("risk").alias("kyc_classification"),
        (F.col("_n") == 1).alias("kyc_is_new"),
        (F.col("_n") > 1).alias("kyc_recently_updated"),
        *[F.coalesce(c, empty).alias(c) for c in ("hr_cc", "mr_cc", "lr_cc")],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
        "trx_from_date",
        "trx_to_date",
    )


# The percentiles of a distribution profile.
PROFILE_PROBS = (10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 99)


def distribution(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Counts, share of positives, range, percentiles and spread per group."""
    v = F.col(column).cast("double")
    rows = df.select(*by, v.alias(column))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count_all"),
        F.count(F.when(F.col(column) > 0, 1)).alias("count_positive"),
        F.min(column).alias("min"),
        F.round(F.max(column), 2).alias("max"),
        F.round(F.avg(column), 2).alias("avg"),
        F.round(F.stddev_samp(column), 2).alias("stddev"),
    )
    perc = percentiles(rows, by, column, {f"perc_{p}": p / 100 for p in PROFILE_PROBS}, "discrete")
    out = base.join(perc, list(by), "left")
    return out.select(
        F.lit(column).alias("feature_name"),
        *by,
        "count_positive",
        "count_all",
        F.round(F.col("count_positive") / F.col("count_all"), 2).alias("positive_prop"),
        "min",
        *[F.round(f"perc_{p}", 2).alias(f"perc_{p}") for p in PROFILE_PROBS],
        "max",
        "avg",
        "stddev",
        F.round(F.round("perc_75", 2) - F.round("perc_25", 2), 2).alias("iqr"),
        (F.col("max") - F.col("min")).alias("value_range"),
    )


_FUNCS = {"count": F.count, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}


def aggregate(
    df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None, funcs: Sequence[str] = ("count", "mean", "sum")
) -> DataFrame:
    """Named functions over the given (default: all numeric) columns, plus group size."""
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in by]
    aggs = [_FUNCS[fn](c).alias(f"{c}_{fn}") for c in columns for fn in funcs]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("group_size"), *aggs)


def baseline_profile(df: DataFrame, entity: str, month: int, before: int = 3) -> DataFrame:
    """Entities active in ``month``: that month against the ``before`` months ahead.

    Turnover, count, largest amount, counterparties and high-risk turnover, all in
    one two-level pass (entity, counterparty) -> (entity).
    """
    now = F.col("month_offset") == month
    past = (F.col("month_offset") < month) & (F.col("month_offset") >= month - before)
    high = F.col("cp_country_risk_level") == "High"
    amount = F.abs("amount_usd")
    measures = {}
    for name, when in (("cur", now), ("base", past)):
        measures |= {
            f"{name}_turnover": total(amount, when),
            f"{name}_count": count(when),
            f"{name}_max": largest(amount, when),
            f"{name}_partners": distinct("cp_id", when),
            f"{name}_high_risk": total(amount, when & high),
        }
    out = aggregate_measures(df.filter(now | past), [entity], measures).filter("cur_count > 0")
    return out.select(
        entity, *[F.round(F.coalesce(F.col(c), F.lit(0)), 2).alias(c) for c in measures]
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, distinct-free null counts and null share per column, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
    return counts.select(F.explode(entries).alias("e"), "_rows").select(
        "e.column",
        F.col("_rows").alias("rows"),
        "e.nulls",
        F.round(F.coalesce(F.try_divide(F.col("e.nulls"), F.col("_rows")), F.lit(0.0)) * 100, 2).alias("null_pct"),
    )


def zero_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether each column holds a single value (NULL counts as one), in one pass."""
    aggs = []
    for c in columns:
        values = F.when(F.min(c).isNull(), 0).when(F.min(c) == F.max(c), 1).otherwise(2)
        has_null = F.max(F.col(c).isNull().cast("int"))
        aggs.append((values + F.coalesce(has_null, F.lit(0)) == 1).alias(c))
    flags = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("constant")) for c in columns])
    return df.agg(*aggs).select(F.explode(flags).alias("e")).select("e.*")
