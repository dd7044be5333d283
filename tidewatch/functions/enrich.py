"""Row-level enrichment: recodes, guards, fills and casts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def risk_level(country: Column, levels: Mapping[str, str]) -> Column:
    """Literal map lookup; countries outside the map give NULL."""
    pairs = [F.lit(x) for kv in levels.items() for x in kv]
    return F.create_map(*pairs)[country]


def is_new_account(open_months: Column, limit: int = 6) -> Column:
    return F.coalesce(open_months <= limit, F.lit(False))


def min_amount_guard(indicator: Column, amount: Column, threshold: float = 5.0) -> Column:
    """Keep the indicator only where the amount exceeds the threshold."""
    return F.when(amount > threshold, indicator).otherwise(0)


def recode(c: Column, mapping: Mapping[str, int], default: int | None = None) -> Column:
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def has_value(c: Column) -> Column:
    return c.isNotNull().cast("long")


def risk_class(c: Column, high: Iterable[str]) -> Column:
    return F.when(c.isin(list(high)), "High").otherwise("Low")


def fill_numeric(df: DataFrame, value: float = 0) -> DataFrame:
    """NULL to a constant in numeric columns only."""
    return df.na.fill(value)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c)
            for c in df.columns
        ]
    )


def cast_cols(df: DataFrame, columns: Sequence[str], dtype: str | T.DataType) -> DataFrame:
    """Cast the listed columns that exist, in one projection."""
    wanted = set(columns)
    return df.select(*[F.col(c).cast(dtype).alias(c) if c in wanted else F.col(c) for c in df.columns])
