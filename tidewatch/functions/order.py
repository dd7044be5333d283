"""Numbers as 64-bit integers in the same order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ByteType, DateType, DecimalType, IntegerType, LongType, ShortType

# The layout of a 64-bit floating-point number.
MANTISSA_BITS = 52
LEAST_EXPONENT, GREATEST_EXPONENT = -1022, 1023
INFINITE = 2047 << MANTISSA_BITS


def _with_double_key(df: DataFrame, value: str, key: str) -> DataFrame:
    """The bits of a double as a long that sorts like the double (NaN last, -0.0 equal to 0.0).

    The exponent is taken by logarithm and corrected by comparing with powers of two, which
    are exact; so is the division by one of them. Each step is a column of its own, so that
    none is computed twice.
    """
    v = F.col(value).cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    steps = [
        {"_size": F.when(odd, F.lit(0.0)).otherwise(F.abs(v))},
        {"_rough": F.greatest(F.least(F.floor(F.log2(F.greatest("_size", F.lit(5e-324)))), F.lit(GREATEST_EXPONENT)), F.lit(LEAST_EXPONENT))},
        {"_two": F.pow(F.lit(2.0), F.col("_rough"))},
        {"_exp": F.greatest(F.lit(LEAST_EXPONENT), F.col("_rough") + F.when(F.col("_size") < F.col("_two"), -1).when(F.col("_size") >= F.col("_two") * 2, 1).otherwise(0))},
        # 0 to 1 below the least normal number, 1 to 2 above it
        {"_fraction": F.col("_size") / F.pow(F.lit(2.0), F.col("_exp"))},
        {"_bits": (F.col("_exp") - LEAST_EXPONENT).cast("long") * (1 << MANTISSA_BITS) + (F.col("_fraction") * float(1 << MANTISSA_BITS)).cast("long")},
        {"_bits": F.when(odd, F.when(F.isnan(v), F.lit((1 << 63) - 1)).otherwise(F.lit(INFINITE))).otherwise(F.col("_bits"))},
        {key: F.when(v < 0, -F.col("_bits")).otherwise(F.col("_bits"))},
    ]
    columns = df.columns
    for step in steps:
        df = df.withColumns(step)
    return df.select(*columns, key)


def with_order_key(df: DataFrame, value: str, key: str) -> DataFrame:
    """Adds a long that grows with the value. Equal keys mean equal values, except for decimals of more than 18 digits."""
    kind = df.schema[value].dataType
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return df.withColumn(key, F.col(value).cast("long"))
    if isinstance(kind, DecimalType) and kind.precision <= 18:
        return df.withColumn(key, (F.col(value) * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long"))
    if isinstance(kind, DateType):
        return df.withColumn(key, F.unix_date(value).cast("long"))
    return _with_double_key(df, value, key)
