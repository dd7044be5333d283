"""Unsupervised anomaly scores with per-feature ratings.

The score is transparent: how far each feature lies above the training median, in
robust deviations; the three largest make the fused score. Only the fitted centre
and spread per feature (two numbers each) come to the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.operators.percentiles import percentiles
from tidewatch.session import cut_lineage, stored

# Consistency factor of the MAD, and the scale of ratings.
MAD_FACTOR = 1.4826
RATING_SCALE = 10000


def split_by_time(df: DataFrame, ts: str, cut: dt.datetime | dt.date) -> tuple[DataFrame, DataFrame]:
    at = F.lit(cut).cast(df.schema[ts].dataType)
    return df.filter(F.col(ts) < at), df.filter(F.col(ts) >= at)


def numeric_features(df: DataFrame, columns: Sequence[str], strategy: str = "constant", fill: float = 0.0) -> DataFrame:
    """Fill gaps with a constant or with the column's mean."""
    if strategy == "constant":
        values = {c: fill for c in columns}
    elif strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        values = {c: fill if row[c] is None else row[c] for c in columns}  # a column without values has no mean
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in values.items()})


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="keep").transform(df)


def labels_by_rank(df: DataFrame, column: str) -> DataFrame:
    """(label, index): the distinct labels in alphabetical order, from 0, ranked range by range."""
    labels = df.select(F.col(column).alias("label")).filter("label is not null").distinct()
    ranged = cut_lineage(labels.repartitionByRange("label").withColumn("_range", F.spark_partition_id()))
    # one row per range: the labels before it
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("label"))
    return ranged.withColumn("_rank", rank).join(before, "_range").select("label", (F.col("_before") + F.col("_rank") - 1).alias("index"))


def categorical_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<c>_index`` (alphabetical; an unknown or NULL label takes the number of labels) and
    ``<c>_vec``, the one-hot vector as its size and the position of the one (NULL: all zeros).

    Labels are ranked and joined, never listed on the driver, so the output is the same for
    any number of labels.
    """
    for c in columns:
        ranked = labels_by_rank(df, c)
        n = ranked.count()
        found = df.join(ranked.withColumnRenamed("label", c), c, "left").select(*df.columns, F.col("index").alias("_index"))
        df = found.withColumns(
            {
                f"{c}_index": F.coalesce(F.col("_index"), F.lit(n)).cast("double"),
                f"{c}_vec": F.struct(F.lit(n).cast("long").alias("size"), F.col("_index").cast("long").alias("position")),
            }
        ).drop("_index")
    return df


def long_features(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, value): one row per feature, NULL kept."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


@dataclass(frozen=True)
class ScoreModel:
    """Centre and spread per feature, and how they turn into scores."""

    centre: Mapping[str, float]
    spread: Mapping[str, float]
    top: int = 3
    scale: float = 4.0

    @property
    def features(self) -> list[str]:
        return sorted(self.centre)

    def excess(self, feature: str) -> Column:
        """Robust deviations above the centre; below it, or unknown, 0."""
        spread = self.spread[feature]
        if not spread:
            return F.lit(0.0)
        z = (F.col(feature).cast("double") - self.centre[feature]) / spread
        return F.round(F.greatest(F.coalesce(z, F.lit(0.0)), F.lit(0.0)), 6)

    def score(self, df: DataFrame, step: str = "algo") -> DataFrame:
        """Adds ``<step>_score``, ``_pattern`` and per feature ``_rank``, ``_rating``."""
        names = self.features
        parts = {f"_z_{f}": self.excess(f) for f in names}
        df = df.withColumns(parts)
        # descending excess, then name; no entry is NULL (sort_array is compiled, array_sort compares by a lambda)
        ranked = F.sort_array(
            F.array(*[F.struct((-F.col(f"_z_{f}")).alias("z"), F.lit(f).alias("f")) for f in names])
        )
        df = df.withColumn("_order", ranked).withColumns(
            {
                "_names": F.col("_order.f"),
                "_total": sum((F.col(f"_z_{f}") for f in names), F.lit(0.0)),
            }
        )
        best = sum((-F.col("_order")[i]["z"] for i in range(min(self.top, len(names)))), F.lit(0.0))
        cols = {
            f"{step}_score": F.round(1 - F.exp(-best / (self.top * self.scale)), 6),
            f"{step}_pattern": F.array_join(F.slice("_names", 1, self.top), "|"),
        }
        for f in names:
            cols[f"{step}_{f}_rank"] = F.array_position("_names", f).cast("int")
            share = F.coalesce(F.try_divide(F.col(f"_z_{f}"), F.col("_total")), F.lit(0.0))
            cols[f"{step}_{f}_rating"] = F.round(share * RATING_SCALE).cast("int")
        return df.withColumns(cols).drop(*parts, "_order", "_names", "_total")


def fit_scores(train: DataFrame, features: Sequence[str], top: int = 3, scale: float = 4.0) -> ScoreModel:
    """Median and MAD per feature; a zero MAD falls back to the standard deviation.

    Values are counted once, in shared storage: medians and deviations from them are taken of the counts. The
    training rows are read again only where a standard deviation is needed.
    """
    counts = stored(long_features(train, [], features).filter("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    median = percentiles(counts, ["feature"], "value", {"m": 0.5}, few_groups=True, weight="n", counted=True)
    centre = {r["feature"]: r["m"] for r in median.collect()}  # one row per feature
    known = [f for f in features if centre.get(f) is not None]
    middle = F.lit(None).cast("double")
    for f in known:
        middle = F.when(F.col("feature") == f, F.lit(centre[f])).otherwise(middle)
    off = counts.select("feature", F.abs(F.col("value") - middle).alias("value"), "n")
    mad = percentiles(off, ["feature"], "value", {"m": 0.5}, few_groups=True, weight="n", counted=True)
    mads = {r["feature"]: r["m"] for r in mad.collect()}
    flat = [f for f in known if not mads.get(f)]
    devs = train.agg(*[F.stddev_pop(F.col(f).cast("double")).alias(f) for f in flat]).first() if flat else {}
    spread = {f: (mads.get(f) or 0.0) * MAD_FACTOR or (devs[f] or 0.0) for f in known}
    return ScoreModel({f: centre[f] for f in known}, spread, top, scale)


def top_triggers(df: DataFrame, step: str, features: Sequence[str], k: int = 3, values: bool = False) -> DataFrame:
    """The k features of lowest rank as (name, rating[, value]) columns."""
    cols: dict[str, Column] = {}
    for i in range(1, k + 1):
        name = F.lit(None).cast("string")
        rating = F.lit(None).cast("double")
        value = F.lit(None).cast("double")
        for f in features:
            hit = F.col(f"{step}_{f}_rank") == i
            name = F.when(hit, F.lit(f)).otherwise(name)
            rating = F.when(hit, F.col(f"{step}_{f}_rating") / RATING_SCALE).otherwise(rating)
            value = F.when(hit, F.col(f).cast("double")).otherwise(value)
        cols[f"trigger_{i}"] = name
        cols[f"trigger_{i}_rating"] = rating
        if values:
            cols[f"trigger_{i}_value"] = value
    return df.withColumns(cols)
