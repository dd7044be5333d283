"""Checks of an alert set against its activities and risks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators.percentiles import percentiles
from tidewatch.session import cut_lineage


def _entries(triggers: Column) -> Column:
    """Elements of the trigger list as texts; malformed lists are empty."""
    return F.coalesce(F.from_json(triggers, "array<string>"), F.array().cast("array<string>"))


def _trigger_id(e: Column) -> Column:
    found = F.coalesce(*[F.get_json_object(e, f"$.{k}") for k in ("triggerID", "triggerId", "tr_id")])
    return F.when(e.startswith("{"), found).otherwise(e)


def trigger_ids(triggers: Column) -> Column:
    """Ids of a trigger list: objects with an id field, or plain ids."""
    return F.filter(F.transform(_entries(triggers), _trigger_id), lambda t: t.isNotNull())


def explode_triggers(alerts: DataFrame, id: str = "id") -> DataFrame:
    """One row per alert and trigger id."""
    return alerts.select(F.col(id).alias("alert_id"), F.explode(trigger_ids(F.col("triggers"))).alias("trigger_id"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    n = alerts.select(F.size(trigger_ids(F.col("triggers"))).alias("n"))
    many, one = F.count(F.when(F.col("n") > 1, 1)), F.count(F.when(F.col("n") == 1, 1))
    return n.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        many.alias("consolidated"),
        one.alias("single"),
        F.round(F.coalesce(F.try_divide(many, F.count(F.lit(1))) * 100, F.lit(0.0)), 2).alias("consolidation_rate"),
        F.round(F.avg("n"), 2).alias("avg_triggers"),
        F.min("n").cast("long").alias("min_triggers"),
        F.max("n").cast("long").alias("max_triggers"),
    )


def duplicate_triggers(alerts: DataFrame) -> DataFrame:
    """Triggers of more than one alert, with those alerts, one row each.

    Long form: a trigger repeated in very many alerts stays spread over rows.
    """
    rows = explode_triggers(alerts)
    often = rows.groupBy("trigger_id").agg(F.count(F.lit(1)).alias("alert_count")).filter("alert_count > 1")
    return rows.join(often, "trigger_id")


def duplicate_summary(alerts: DataFrame) -> DataFrame:
    counts = explode_triggers(alerts).groupBy("trigger_id").agg(F.count(F.lit(1)).alias("n"))
    dup = F.count(F.when(F.col("n") > 1, 1))
    return counts.agg(
        F.count(F.lit(1)).alias("triggers_checked"),
        dup.alias("duplicates"),
        F.round(F.coalesce(F.try_divide(dup, F.count(F.lit(1))) * 100, F.lit(0.0)), 2).alias("duplicate_rate"),
    )


def with_total(df: DataFrame, n: str, out: str) -> DataFrame:
    """Adds the share (percent) of ``n`` in its total; the total is one number."""
    size = df.agg(F.sum(n)).first()[0] or 0
    return df.withColumn(out, F.round(F.coalesce(F.try_divide(F.col(n) * 100.0, F.lit(size)), F.lit(0.0)), 2))


def alerts_by_month(alerts: DataFrame, created: str = "createdate") -> DataFrame:
    months = alerts.groupBy(F.date_format(created, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("alerts"))
    return with_total(months, "alerts", "pct")


def monthly_alert_pct(alerts: DataFrame, activities: DataFrame, partition: str = "tr_partition") -> DataFrame:
    """Share of analysed activities that raised an alert, per month.

    Activities are reduced to one row per (month, tr_id) before the join, so a
    month's distinct counts are plain counts.
    """
    acts = activities.select(F.date_format(partition, "yyyy-MM").alias("month"), "tr_id").distinct()
    hit = explode_triggers(alerts).select(F.col("trigger_id").alias("tr_id")).distinct().withColumn("hit", F.lit(1))
    return (
        acts.join(hit, "tr_id", "left")
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("total_entities"), F.count("hit").alias("alert_count"))
        .withColumn("alert_pct", F.round(F.col("alert_count") / F.col("total_entities") * 100, 2))
    )


def monthly_alert_summary(months: DataFrame) -> DataFrame:
    """Overall and average share, best and worst month (ties: earliest)."""
    order_up = F.struct(F.col("alert_pct"), F.col("month"))
    order_down = F.struct(-F.col("alert_pct"), F.col("month"))
    return months.agg(
        F.sum("alert_count").alias("total_alerts"),
        F.sum("total_entities").alias("total_entities"),
        F.round(F.try_divide(F.sum("alert_count"), F.sum("total_entities")) * 100, 2).alias("overall_pct"),
        F.round(F.avg("alert_pct"), 2).alias("average_pct"),
        F.count(F.lit(1)).alias("months"),
        F.min_by("month", order_down).alias("highest_month"),
        F.max("alert_pct").alias("highest_pct"),
        F.min_by("month", order_up).alias("lowest_month"),
        F.min("alert_pct").alias("lowest_pct"),
    )


def consistency(alerts: DataFrame, risks: DataFrame, activities: DataFrame) -> DataFrame:
    """Trigger ids against risk and activity ids, both ways, in one grouping."""
    parts = [
        (explode_triggers(alerts).select(F.col("trigger_id").alias("k")), "t"),
        (risks.select(F.col("tr_id").alias("k")), "r"),
        (activities.select(F.col("tr_id").alias("k")), "a"),
    ]
    tagged = None
    for d, name in parts:
        d = d.select("k", *[F.lit(n == name).alias(n) for n in "tra"])
        tagged = d if tagged is None else tagged.unionByName(d)
    keys = tagged.filter(F.col("k").isNotNull()).groupBy("k").agg(*[F.bool_or(c).alias(c) for c in "tra"])

    def n(c: str) -> Column:
        return F.count(F.when(F.expr(c), 1))

    out = keys.agg(
        n("t").alias("triggers"), n("r").alias("risk_ids"), n("a").alias("activity_ids"),
        n("t AND NOT r").alias("triggers_without_risk"), n("t AND NOT a").alias("triggers_without_activity"),
        n("r AND NOT t").alias("risks_without_alert"),
    )
    bad = (F.col("triggers_without_risk") > 0) | (F.col("triggers_without_activity") > 0)
    return out.withColumn("status", F.when(bad, "FAIL").otherwise("PASS"))


def _alert_entities(alerts: DataFrame, id: str) -> DataFrame:
    rows = alerts.select(F.col(id).alias("alert_id"), F.explode(_entries(F.col("triggers"))).alias("e"))
    # keys in one order, so that an entity has one spelling
    keys = F.from_json(F.get_json_object("e", "$.primaryKeySet"), "map<string,string>")
    sorted_keys = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(keys))))
    return rows.select("alert_id", sorted_keys.alias("entity")).filter(
        F.col("entity").isNotNull() & (F.col("entity") != "{}")
    ).distinct()


def split_entities(alerts: DataFrame, id: str = "id") -> DataFrame:
    """Entities found in more than one alert, with those alerts (long form)."""
    rows = _alert_entities(alerts, id)
    often = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("alert_count")).filter("alert_count > 1")
    return rows.join(often, "entity")


def consolidation(alerts: DataFrame, id: str = "id") -> DataFrame:
    """Whether alerts of one entity are kept together, as one verdict row."""
    per_entity = _alert_entities(alerts, id).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    # two counts, read to the driver and inlined
    e = per_entity.agg(F.count(F.lit(1)).alias("entities"), F.count(F.when(F.col("n") > 1, 1)).alias("in_several")).first()
    a = alert_counts(alerts).withColumns({"entities": F.lit(e["entities"]), "in_several": F.lit(e["in_several"])})
    share = F.try_divide(F.col("in_several"), F.col("entities"))
    status = (
        F.when((F.col("consolidated") == 0) | (F.col("in_several") == 0), "PASS")
        .when(share <= 0.10, "WARNING")
        .otherwise("FAIL")
    )
    return a.select(
        status.alias("status"),
        (F.col("consolidated") > 0).alias("active"),
        F.col("entities").alias("total_entities"),
        F.col("in_several").alias("entities_in_several_alerts"),
        F.round(F.coalesce((1 - share) * 100, F.lit(0.0)), 2).alias("consolidation_rate"),
        "total_alerts", F.col("consolidated").alias("consolidated_alerts"), "avg_triggers",
    )


def value_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, rows) for all columns in one grouping."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def alert_metadata(alerts: DataFrame) -> DataFrame:
    """Open and closed, assignment, suppression, flag against trigger count."""
    size = F.size(trigger_ids(F.col("triggers")))
    flag = F.coalesce(F.col("isconsolidated"), F.lit(False))
    out = alerts.select("isclosed", "assignee", "suppressioncount", flag.alias("flag"), (size > 1).alias("many")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("isclosed"), 1)).alias("closed"),
        F.count("assignee").alias("assigned"),
        F.count(F.when(F.col("suppressioncount") > 0, 1)).alias("with_suppression"),
        F.round(F.avg("suppressioncount"), 2).alias("avg_suppression"),
        F.count(F.when(F.col("flag"), 1)).alias("by_flag"),
        F.count(F.when(F.col("many"), 1)).alias("by_triggers"),
    )
    return out.select(
        "total", "closed", (F.col("total") - F.col("closed")).alias("open"), "assigned",
        (F.col("total") - F.col("assigned")).alias("unassigned"),
        F.round(F.coalesce(F.try_divide("assigned", "total") * 100, F.lit(0.0)), 2).alias("assignment_rate"),
        "with_suppression", "avg_suppression",
        "by_flag", F.abs(F.col("by_flag") - F.col("by_triggers")).alias("flag_mismatch"),
    )


def risk_metadata(risks: DataFrame) -> DataFrame:
    out = risks.agg(F.count(F.lit(1)).alias("risks"), F.count("suppression_identifier").alias("with_suppression"))
    return out.withColumn(
        "suppression_pct", F.round(F.coalesce(F.try_divide("with_suppression", "risks") * 100, F.lit(0.0)), 2)
    )


def score_distribution(activities: DataFrame, score: str, alerts: DataFrame | None = None) -> DataFrame:
    """Range, moments, interpolated percentiles, and rows at or above the 95th."""
    s = F.col(score)
    probs = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    # five numbers, read to the driver and inlined
    cut = percentiles(activities.select(score), [], score, probs).first()
    rows = activities.agg(
        F.count(F.lit(1)).alias("activities"), F.count(s).alias("scored"), F.round(F.min(s), 6).alias("min"),
        F.round(F.max(s), 6).alias("max"), F.round(F.avg(s), 4).alias("mean"), F.round(F.stddev_samp(s), 4).alias("std"),
        *[F.round(F.lit(cut[p]), 4).alias(p) for p in probs],
        F.count(F.when(s >= F.lit(cut["p95"]), 1)).alias("high_scores"),
    )
    if alerts is None:
        return rows
    return rows.withColumn("alert_ratio_pct", F.round(F.try_divide(F.lit(alerts.count()), F.col("activities")) * 100, 2))


def temporal_pattern(alerts: DataFrame, created: str = "createdate") -> DataFrame:
    """(unit, value, alerts, pct): by weekday (0 is Monday) and by hour."""
    c = F.col(created)
    units = F.array(
        F.struct(F.lit("weekday").alias("unit"), F.weekday(c).alias("value")),
        F.struct(F.lit("hour").alias("unit"), F.hour(c).alias("value")),
    )
    size = alerts.count()
    return (
        alerts.select(F.explode(units).alias("u")).select("u.*").filter(F.col("value").isNotNull())
        .groupBy("unit", "value").agg(F.count(F.lit(1)).alias("alerts"))
        .withColumn("pct", F.round(F.col("alerts") * 100.0 / F.lit(max(size, 1)), 2))
    )


# Limits of the alert quality report.
REPORT_LIMITS = {
    "consolidation_rate": ("<", 30.0, "Low consolidation rate"),
    "duplicates": (">", 0.0, "Duplicate triggers found"),
    "triggers_without_risk": (">", 0.0, "Triggers without risk metadata"),
    "triggers_without_activity": (">", 0.0, "Triggers without activity"),
    "assignment_rate": ("<", 50.0, "Low assignment rate"),
    "suppression_pct": ("<", 80.0, "Low suppression coverage"),
    "alert_ratio_pct": (">", 5.0, "High alert rate"),
    "max_hour_pct": (">", 80.0, "Alerts created in one hour"),
}


def alert_quality_report(
    alerts: DataFrame, risks: DataFrame, activities: DataFrame, limits: Mapping[str, tuple[str, float, str]] = REPORT_LIMITS
) -> DataFrame:
    """One row per figure: value, whether it needs attention, and the overall status.

    Every figure reads the three inputs, so they are written once to the checkpoint folder.
    """
    alerts, risks, activities = (cut_lineage(d) for d in (alerts, risks, activities))
    one = [
        alert_counts(alerts).select("consolidation_rate"),
        duplicate_summary(alerts).select("duplicates"),
        consistency(alerts, risks, activities).select("triggers_without_risk", "triggers_without_activity"),
        alert_metadata(alerts).select("assignment_rate"),
        risk_metadata(risks).select("suppression_pct"),
        temporal_pattern(alerts).filter("unit = 'hour'").agg(F.max("pct").alias("max_hour_pct")),
        activities.agg(
            F.round(F.try_divide(F.lit(alerts.count()), F.count(F.lit(1))) * 100, 2).alias("alert_ratio_pct")
        ),
    ]
    rows = None
    for d in one:
        entries = F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in d.columns])
        part = d.select(F.explode(entries).alias("e")).select("e.*")
        rows = part if rows is None else rows.unionByName(part)
    attention, text = F.lit(False), F.lit(None).cast("string")
    for name, (op, limit, message) in limits.items():
        over = F.col("value") < limit if op == "<" else F.col("value") > limit
        attention = F.when(F.col("figure") == name, over).otherwise(attention)
        text = F.when((F.col("figure") == name) & over, F.lit(message)).otherwise(text)
    breaking = ["duplicates", "triggers_without_risk", "triggers_without_activity"]
    return rows.select(
        "figure", "value", attention.alias("attention"), text.alias("recommendation"),
        F.when(F.col("figure").isin(breaking) & attention, "FAIL").otherwise("PASS").alias("status"),
    )


# Seconds below which a timing earns 100, 80 or 60 points.
TIMING_STEPS = {
    "alert_details": (1.0, 2.0, 3.0),
    "feature_loading": (2.0, 3.0, 5.0),
    "network_view": (2.0, 4.0, 6.0),
}


def timing_score(df: DataFrame, steps: Mapping[str, tuple[float, float, float]] = TIMING_STEPS) -> DataFrame:
    """Points per timing column (100, 80, 60 or 40) and their rounded mean."""
    cols = {}
    for name, (a, b, c) in steps.items():
        t = F.col(name)
        cols[f"{name}_score"] = F.when(t < a, 100).when(t < b, 80).when(t < c, 60).otherwise(40)
    out = df.withColumns(cols)
    mean = sum((F.col(c) for c in cols), F.lit(0)) / len(cols)
    return out.withColumn("overall_score", F.round(mean).cast("long"))
