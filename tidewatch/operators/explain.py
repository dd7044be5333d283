"""Population comparison and category explanations of an entity's period.

The long form (one row per entity, period and category) is the working result.
``packed`` turns it into the JSON text consumers read; a list longer than a page
is spread over several rows so that no row or task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.numbers import mean

PAGE = 10_000


def population_stats(
    df: DataFrame, period: str, means: Mapping[str, str], holders: Mapping[str, str]
) -> DataFrame:
    """Per period: mean over positive values and number of entities with one.

    ``df`` has one row per entity and period, so counting rows counts entities.
    """
    aggs = [mean(F.when(F.col(c) > 0, F.col(c)), 2).alias(out) for out, c in means.items()]
    aggs += [F.count(F.when(F.col(c) > 0, F.lit(1))).alias(out) for out, c in holders.items()]
    return df.groupBy(period).agg(*aggs)


def with_population(df: DataFrame, period: str, means: Mapping[str, str], holders: Mapping[str, str]) -> DataFrame:
    """The statistics beside every entity; one row per calendar period is broadcast."""
    return df.join(F.broadcast(population_stats(df, period, means, holders)), period, "left")


def explain_by(
    df: DataFrame,
    keys: Sequence[str],
    category: str,
    amount: str,
    where: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Count and rounded sum per (keys, category), with the largest ``carry`` texts.

    Carried texts are keys of a first grouping: kept in the buffers they would
    turn the aggregation of all rows into a sort.
    """
    rows = df.filter(F.col(category).isNotNull() if where is None else where)
    first = rows.groupBy(*keys, category, *carry).agg(F.count(F.lit(1)).alias("c"), F.sum(amount).alias("s"))
    if carry:
        first = first.groupBy(*keys, category).agg(
            F.sum("c").alias("c"), F.sum("s").alias("s"), *[F.max(t).alias(t) for t in carry]
        )
    return first.withColumn("s", F.round("s", 2))


def explain_many(
    df: DataFrame, keys: Sequence[str], category: str, amount: str, views: Mapping[str, Column]
) -> DataFrame:
    """Several explanations over the same category in one aggregation.

    Columns ``<view>_c`` and ``<view>_s``; a view without rows in a category has
    count 0 and NULL sum.
    """
    aggs = []
    for name, where in views.items():
        aggs += [
            F.count(F.when(where, F.lit(1))).alias(f"{name}_c"),
            F.round(F.sum(F.when(where, F.col(amount))), 2).alias(f"{name}_s"),
        ]
    return df.groupBy(*keys, category).agg(*aggs)


def packed(rows: DataFrame, keys: Sequence[str], fields: Mapping[str, str], name: str, page: int = PAGE) -> DataFrame:
    """``{"data": [...]}`` JSON per key, entries sorted by their first field.

    Keys with more than ``page`` entries get several rows, told apart by ``part``. They are broadcast: there is
    at most one for ``page`` entries.
    """
    keys = list(keys)
    entry = F.struct(*[F.col(c).alias(n) for n, c in fields.items()])
    big = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > page)
        .withColumn("_parts", F.ceil(F.col("_n") / (page / 2)).cast("long"))
        .select(*keys, "_parts")
    )
    first = next(iter(fields.values()))
    return (
        rows.join(F.broadcast(big), keys, "left")
        .withColumn("part", F.coalesce(F.pmod(F.xxhash64(first), F.col("_parts")), F.lit(0)))
        .groupBy(*keys, "part")
        .agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("data"))).alias(name))
    )


def concentration(rows: DataFrame, keys: Sequence[str], category: str, total: str = "s") -> DataFrame:
    """Largest category of each key and its share of the key's total.

    Works on the long form with a decomposable top-1; ties go to the last category.
    """
    s = F.col(total)
    top = F.max_by(F.struct(F.col(category).alias("cn"), F.col("c"), s.alias("s")), F.struct(s, F.col(category)))
    out = rows.groupBy(*keys).agg(top.alias("_top"), F.round(F.sum(s), 2).alias("_sum"))
    return out.select(
        *keys,
        F.col("_top.cn").alias("cp_concentration_cn"),
        F.col("_top.c").alias("cp_concentration_c"),
        F.col("_top.s").alias("cp_concentration_s"),
        F.try_divide(F.col("_top.s"), F.col("_sum")).alias("cp_concentration"),
    )


def explain_country(
    df: DataFrame, entity: str, country: str, level: str, amount: str, risky: Sequence[str] = ("High", "Very High")
) -> tuple[DataFrame, DataFrame]:
    """Long form per (entity, country, level), and the any-risky flag per entity."""
    rows = df.groupBy(entity, country, level).agg(
        F.count(F.lit(1)).alias("c"), F.round(F.sum(amount), 2).alias("s")
    )
    flags = rows.groupBy(entity).agg(
        F.bool_or(F.coalesce(F.col(level).isin(list(risky)), F.lit(False))).alias("high_risk_countries")
    )
    return rows, flags


def explain_keyword(df: DataFrame, entity: str, group: str, amount: str) -> DataFrame:
    """Long form per (entity, keyword group); rows without a group are left out."""
    return explain_by(df, [entity], group, amount)


def with_keyword_flag(entities: DataFrame, rows: DataFrame, entity: str) -> DataFrame:
    hit = rows.select(entity).distinct().withColumn("keyword_matches", F.lit(True))
    return entities.join(hit, entity, "left").withColumn(
        "keyword_matches", F.coalesce("keyword_matches", F.lit(False))
    )
