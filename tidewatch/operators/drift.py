"""Stability of features and scores between a reference and a current period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.numbers import mean
from tidewatch.operators.percentiles import percentiles
from tidewatch.operators.scoring import long_features, top_triggers


def split_reference(df: DataFrame, period: str, start, end) -> tuple[DataFrame, DataFrame]:
    """Rows with the period in [start, end], and those after it."""
    p = F.col(period)
    return df.filter((p >= start) & (p <= end)), df.filter(p > end)


def value_counts(df: DataFrame, period: str, columns: Sequence[str]) -> DataFrame:
    """(period, feature, value, n): how often each value of each column occurs in a period, NULL included.

    Such tables merge: a new period is appended to the stored ones, and stability over any
    periods is computed from the counts without the rows behind them.
    """
    return long_features(df, [period], columns).groupBy(period, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def _stability(counts: DataFrame, bins: int, zeros: bool) -> DataFrame:
    """Per feature: sum of (a - e) * ln(a / e) over bins filled on both sides.

    ``counts`` is (is_ref, feature, value, n); edges come from the reference, without zeros if so asked.
    """
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    edge_rows = counts.filter("is_ref" if zeros else "is_ref AND value <> 0")
    marks = percentiles(edge_rows, ["feature"], "value", probs, "discrete", few_groups=True, weight="n")
    edges = marks.select("feature", F.array_distinct(F.array(*probs)).alias("edges"))
    # one row of at most ``bins`` numbers per listed feature
    binned = counts.join(F.broadcast(edges), "feature").withColumn(
        "bin",
        F.when(F.col("value").isNull(), F.lit(-1)).otherwise(
            F.size(F.filter("edges", lambda e: e <= F.col("value")))
        ),
    )
    filled = binned.groupBy("feature", "bin").agg(
        F.sum(F.when(F.col("is_ref"), F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(F.col("is_ref"), 0).otherwise(F.col("n"))).alias("a")
    )
    sizes = filled.groupBy("feature").agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    a, e = F.col("a") / F.col("ta"), F.col("e") / F.col("te")
    part = F.when((F.col("a") > 0) & (F.col("e") > 0), (a - e) * F.ln(a / e))
    return filled.join(sizes, "feature").groupBy("feature").agg(F.round(F.sum(part), 6).alias("stability"))


def _tagged(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    sides = [d.select(F.lit(r).alias("is_ref"), *columns) for d, r in ((ref, True), (cur, False))]
    return long_features(sides[0].unionByName(sides[1]), ["is_ref"], columns).withColumn("n", F.lit(1).cast("long"))


def csi_of_counts(counts: DataFrame, bins: int = 10, threshold: float = 0.25) -> DataFrame:
    """Characteristic stability per feature from (is_ref, feature, value, n), see ``value_counts``; deciles of
    non-zero reference values. A feature without non-zero values is left out; FAIL from the threshold on."""
    return _stability(counts, bins, zeros=False).select(
        "feature", F.col("stability").alias("csi"), F.when(F.col("stability") >= threshold, "FAIL").otherwise("PASS").alias("result")
    )


def csi(ref: DataFrame, cur: DataFrame, features: Sequence[str], bins: int = 10, threshold: float = 0.25) -> DataFrame:
    """``csi_of_counts`` of two sets of rows; all features run in one pass."""
    return csi_of_counts(_tagged(ref, cur, features), bins, threshold)


def psi_of_counts(counts: DataFrame, bins: int = 10, threshold: float = 0.25) -> DataFrame:
    """Population stability from (is_ref, feature, value, n); FAIL above the threshold."""
    return _stability(counts, bins, zeros=True).select(
        "feature", F.col("stability").alias("psi"), F.when(F.col("stability") > threshold, "FAIL").otherwise("PASS").alias("result")
    )


def psi(ref: DataFrame, cur: DataFrame, column: str, bins: int = 10, threshold: float = 0.25) -> DataFrame:
    """``psi_of_counts`` of one column of two sets of rows."""
    return psi_of_counts(_tagged(ref, cur, [column]), bins, threshold)


def anomaly_rate(df: DataFrame, score: str, threshold: float, by: str) -> DataFrame:
    hit = F.when(F.col(score) > threshold, 1).otherwise(0)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.sum(hit).alias("anomalies"), F.round(F.avg(hit), 6).alias("ratio")
    )


def trigger_share(df: DataFrame, period: str, step: str, features: Sequence[str], k: int = 3) -> DataFrame:
    """Per period and feature: share of anomalies with the feature in the top k."""
    hits = [F.count(F.when(F.col(f"{step}_{f}_rank") <= k, 1)).alias(f) for f in features]
    wide = df.groupBy(period).agg(F.count(F.lit(1)).alias("anomalies"), *hits)
    entries = F.array(*[F.struct(F.lit(f).alias("trigger_feature"), F.col(f).alias("hits")) for f in features])
    return (
        wide.select(period, "anomalies", F.explode(entries).alias("e")).select(period, "anomalies", "e.*")
        .filter("hits > 0").withColumn("share", F.col("hits") / F.col("anomalies"))
    )


def trigger_drift(
    ref: DataFrame, cur: DataFrame, period: str, step: str, features: Sequence[str], alpha: float = 0.05, k: int = 3
) -> DataFrame:
    """Deviation of each current period's trigger share from the reference periods."""
    stats = trigger_share(ref, period, step, features, k).groupBy("trigger_feature").agg(
        F.avg("share").alias("ref_avg"), F.stddev_samp("share").alias("ref_std")
    )
    limit = NormalDist().inv_cdf(1 - alpha)
    now = trigger_share(cur, period, step, features, k)
    z = F.round(F.try_divide(F.col("share") - F.col("ref_avg"), F.col("ref_std")), 2)
    return now.join(stats, "trigger_feature").select(
        "trigger_feature", period, "anomalies", F.round("share", 6).alias("share"), F.coalesce(z, F.lit(0.0)).alias("zscore"),
        F.when(F.abs(z) >= limit, "FAIL").otherwise("PASS").alias("result"),
    )


def never_triggered(df: DataFrame, step: str, features: Sequence[str], k: int = 3) -> DataFrame:
    """Features that are in no anomaly's top k; one flag per feature, one pass."""
    flags = df.agg(
        *[F.coalesce(F.bool_or(F.col(f"{step}_{f}_rank") <= k), F.lit(False)).alias(f) for f in features]
    )
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("seen")) for f in features])
    return flags.select(F.explode(rows).alias("e")).select("e.*").filter(~F.col("seen")).select("feature")


def histogram_compare(ref: DataFrame, cur: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Share of rows per equal-width bin over the joint range, for both sets; a constant column is one bin."""
    v = F.col(column).cast("double")
    both = ref.select(F.lit(True).alias("is_ref"), v.alias("v")).unionByName(
        cur.select(F.lit(False).alias("is_ref"), v.alias("v"))
    )
    ends = both.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    low = ends["lo"] or 0.0
    width = ((ends["hi"] or 0.0) - low) / bins or 1.0  # a constant column fills one bin
    index = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
    counts = both.filter("v IS NOT NULL").groupBy(index.alias("bin")).agg(
        F.count(F.when(F.col("is_ref"), 1)).alias("r"), F.count(F.when(~F.col("is_ref"), 1)).alias("c")
    )
    sizes = both.agg(
        F.count(F.when(F.col("is_ref"), 1)).alias("tr"), F.count(F.when(~F.col("is_ref"), 1)).alias("tc")
    ).first()
    return counts.select(
        "bin",
        F.round(F.lit(low) + F.col("bin") * width, 6).alias("bin_start"),
        F.round(F.try_divide(F.col("r"), F.lit(sizes["tr"])), 6).alias("rate_ref"),
        F.round(F.try_divide(F.col("c"), F.lit(sizes["tc"])), 6).alias("rate_cur"),
    )


# Limits of the overall drift verdict.
DRIFT_LIMITS = {
    "anomaly_percentage": 5.0,
    "iqr_score": 0.1,
    "csi_features": 0.25,
    "max_csi": 0.5,
    "trigger_features": 0.25,
}


def drift_verdict(metrics: DataFrame, limits: Mapping[str, float] = DRIFT_LIMITS) -> DataFrame:
    """(test, value) rows against their limits."""
    pairs = [F.lit(x) for kv in limits.items() for x in (kv[0], float(kv[1]))]
    limit = F.create_map(*pairs)[F.col("test")]
    return metrics.select(
        "test",
        F.round("value", 6).alias("value"),
        limit.alias("threshold"),
        F.when(F.col("value") > limit, "FAIL").otherwise("PASS").alias("result"),
    )


def drift_metrics(
    ref: DataFrame, cur: DataFrame, period: str, score: str, step: str, features: Sequence[str],
    anomaly: float = 0.5, csi_limit: float = 0.25, alpha: float = 0.05,
) -> DataFrame:
    """The five overall drift figures as (test, value) rows."""
    # mean and spread of the reference rates: two numbers, inlined
    rate = anomaly_rate(ref, score, anomaly, period).agg(F.avg("ratio").alias("m"), F.stddev_samp("ratio").alias("s")).first()
    off = F.abs(F.round(F.try_divide(F.col("ratio") - F.lit(rate["m"]), F.lit(rate["s"])), 4))
    worst = anomaly_rate(cur, score, anomaly, period).agg(F.lit("anomaly_percentage").alias("test"), F.max(off).alias("value"))
    both = ref.select(F.lit(True).alias("is_ref"), score).unionByName(cur.select(F.lit(False).alias("is_ref"), score))
    spread = F.col("q3") - F.col("q1")
    iqr = percentiles(both, ["is_ref"], score, {"q1": 0.25, "q3": 0.75}, "discrete", few_groups=True).agg(
        F.lit("iqr_score").alias("test"),
        F.round(F.abs(F.max(F.when(F.col("is_ref"), spread)) - F.max(F.when(~F.col("is_ref"), spread))), 6).alias("value"),
    )
    shifts = csi(ref, cur, features, threshold=csi_limit)
    failed = shifts.agg(
        F.lit("csi_features").alias("test"), F.avg(F.when(F.col("result") == "FAIL", 1.0).otherwise(0.0)).alias("value")
    )
    largest = shifts.agg(F.lit("max_csi").alias("test"), F.max("csi").alias("value"))
    hot = lambda d: d.filter(F.col(score) > anomaly)
    moved = trigger_drift(hot(ref), hot(cur), period, step, features, alpha).groupBy("trigger_feature").agg(
        F.max(F.when(F.col("result") == "FAIL", 1.0).otherwise(0.0)).alias("f")
    ).agg(F.lit("trigger_features").alias("test"), F.avg("f").alias("value"))
    out = worst
    for d in (iqr, failed, largest, moved):
        out = out.unionByName(d)
    return out


def alert_overview(df: DataFrame, date: str, score: str, threshold: float, features: int) -> DataFrame:
    """Dates, months, anomalies and evaluated rows of a scored table, one pass."""
    hit = F.count(F.when(F.col(score) > threshold, 1))
    out = df.agg(
        F.min(date).alias("min_date"), F.max(date).alias("max_date"), hit.alias("anomalies"), F.count(F.lit(1)).alias("investigated")
    )
    return out.select(
        "min_date",
        "max_date",
        F.round(F.months_between("max_date", "min_date")).cast("long").alias("months"),
        "anomalies",
        "investigated",
        F.round(F.try_divide(F.col("anomalies"), F.col("investigated")) * 100, 4).alias("anomaly_pct"),
        F.lit(features).cast("long").alias("features"),
    )


def alert_overview_by(df: DataFrame, period: str, score: str, threshold: float) -> DataFrame:
    hit = F.count(F.when(F.col(score) > threshold, 1))
    return df.groupBy(period).agg(hit.alias("anomalies"), F.count(F.lit(1)).alias("investigated")).withColumn(
        "anomaly_pct", F.round(F.col("anomalies") / F.col("investigated") * 100, 2)
    )


def alert_report(
    df: DataFrame, step: str, features: Sequence[str], keys: Sequence[str], forensic: Sequence[str] = (),
    threshold: float = 0.5, k: int = 5,
) -> DataFrame:
    """Anomalous rows with their top-k features' names, values and ratings."""
    rows = top_triggers(df.filter(F.col(f"{step}_score") > threshold), step, features, k, values=True)
    cols = [f"trigger_{i}{s}" for i in range(1, k + 1) for s in ("", "_value", "_rating")]
    return rows.select(*keys, f"{step}_score", *cols, *forensic)


def bin_counts(report: DataFrame, column: str, by: str, start: float = 0.5, step: float = 0.05, bins: int = 10) -> DataFrame:
    """Rows per (start, start + step], .. bin and trigger feature, with totals.

    Long form; totals carry ``total`` in the place of the bin or the feature.
    """
    index = F.ceil(F.round((F.col(column) - start) / step, 9)).cast("int")
    rows = report.withColumn("_b", index).filter((F.col("_b") >= 1) & (F.col("_b") <= bins) & F.col(by).isNotNull())
    upper = F.format_number(F.lit(start) + F.col("_b") * step, 2)
    counts = rows.groupBy(upper.alias("bin"), F.col(by).alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    return counts.cube("bin", "feature").agg(F.sum("n").alias("n")).select(
        F.coalesce("bin", F.lit("total")).alias("bin"), F.coalesce("feature", F.lit("total")).alias("feature"), "n"
    )


def trigger_history(report: DataFrame, score: str, values: Sequence[str], k: int = 3) -> DataFrame:
    """Per feature in a top-k place: alerts, share, places, mean score and rating.

    Value columns get min, max and the average over the alerts.
    """
    size = report.count()
    places = F.array(
        *[F.struct(F.lit(i).alias("place"), F.col(f"trigger_{i}").alias("f"), F.col(f"trigger_{i}_rating").alias("rating")) for i in range(1, k + 1)]
    )
    long = report.select(score, *values, F.explode(places).alias("p")).filter(F.col("p.f").isNotNull())
    aggs = [F.count(F.when(F.col("p.place") == i, 1)).alias(f"n_trigger_{i}") for i in range(1, k + 1)]
    for v in values:
        aggs += [F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}"), mean(F.col(v), 2).alias(f"avg_{v}")]
    return long.groupBy(F.col("p.f").alias("trigger_feature")).agg(
        F.count(F.lit(1)).alias("alerts"),
        F.round(F.lit(100.0) * F.count(F.lit(1)) / F.lit(max(size, 1)), 2).alias("alerts_pct"),
        mean(F.col(score), 4).alias("avg_score"),
        mean(F.col("p.rating"), 4).alias("avg_rating"),
        *aggs,
    )


def pattern_stats(report: DataFrame, values: Sequence[str], k: int = 3) -> DataFrame:
    """Frequency of top-k patterns, share of all alerts, and value ranges."""
    size = report.count()
    aggs = []
    for v in values:
        aggs += [F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}"), mean(F.col(v), 2).alias(f"avg_{v}")]
    return report.groupBy(*[f"trigger_{i}" for i in range(1, k + 1)]).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.lit(100.0) * F.count(F.lit(1)) / F.lit(max(size, 1)), 2).alias("pct"), *aggs
    )
