"""Risk rules over scored activities, suppression and alerts."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Enrichment:
    """Aggregates of a table looked up per activity by equal keys."""

    source: str
    keys: tuple[str, ...]
    outputs: Mapping[str, str]  # output name -> aggregate expression


@dataclass(frozen=True)
class RiskRule:
    """Boolean variables over an activity; the rule fires when all conditions hold.

    Expressions may name ``activity.<column>``, ``{parameters.<name>}`` and
    ``{enrichments.<name>}``. Parameters are typed Python values.
    """

    id: str
    category: str
    severity: float
    variables: Mapping[str, str]
    conditions: Mapping[str, bool]
    parameters: Mapping[str, object] = field(default_factory=dict)
    enrichments: tuple[Enrichment, ...] = ()
    analysis_method: str = "AI"
    dynamic_severity: Callable[[], Column] | None = None
    dynamic_name: Callable[[], Column] | None = None
    dynamic_category: Callable[[], Column] | None = None
    suppression_key: Callable[[], Column] | None = None
    suppression_days: int = -1


def _literal(v: object) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, dt.datetime):
        return f"timestamp '{v.isoformat(sep=' ')}'"
    if isinstance(v, dt.date):
        return f"date '{v.isoformat()}'"
    escaped = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _expression(rule: RiskRule, text: str) -> Column:
    def value(m: re.Match) -> str:
        kind, name = m.group(1), m.group(2)
        if kind == "parameters":
            return _literal(rule.parameters[name])
        return f"`{rule.id}__{name}`"

    return F.expr(re.sub(r"\{(parameters|enrichments)\.(\w+)\}", value, text))


def enrich(activities: DataFrame, source: DataFrame, keys: Sequence[str], outputs: Mapping[str, Column]) -> DataFrame:
    """Aggregate ``source`` per key and look the result up per activity."""
    found = source.groupBy(*keys).agg(*[c.alias(n) for n, c in outputs.items()])
    return activities.join(found, list(keys), "left")


def identify_risks(
    activities: DataFrame, rules: Sequence[RiskRule], sources: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """One row per activity and fired rule, all rules tested in one projection."""
    df = activities
    for rule in rules:
        for e in rule.enrichments:
            outputs = {f"{rule.id}__{n}": F.expr(x) for n, x in e.outputs.items()}
            df = enrich(df, (sources or {})[e.source], e.keys, outputs)
    df = df.alias("activity")
    entries = []
    for rule in rules:
        fired = F.lit(True)
        for variable, wanted in rule.conditions.items():
            fired = fired & F.coalesce(_expression(rule, rule.variables[variable]) == F.lit(wanted), F.lit(False))

        def attr(dynamic, static) -> Column:
            return dynamic() if dynamic is not None else F.lit(static)

        entries.append(
            F.when(
                fired,
                F.struct(
                    F.lit(rule.id).alias("risk_id"),
                    attr(rule.dynamic_name, rule.id).cast("string").alias("risk_name"),
                    attr(rule.dynamic_category, rule.category).cast("string").alias("risk_category"),
                    attr(rule.dynamic_severity, rule.severity).cast("double").alias("risk_severity"),
                    F.lit(rule.analysis_method).alias("risk_analysis_method"),
                    attr(rule.suppression_key, None).cast("string").alias("suppression_identifier"),
                    F.lit(rule.suppression_days).alias("suppression_days"),
                ),
            )
        )
    fired = df.withColumn("_risks", F.array_compact(F.array(*entries)))
    return fired.select(*activities.columns, F.explode("_risks").alias("_r")).select(*activities.columns, "_r.*")


def label_lookup(labels: Mapping[str, str], feature: Column) -> Column:
    """Display text of a feature name; one literal map, as many entries as features."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.create_map(*pairs)[feature]


def suppress(
    alerts: DataFrame, entity: str, key: str, ts: str, days: Column | int, rule: str | None = None, tie: Sequence[str] = ()
) -> DataFrame:
    """Flags alerts whose (entity, key) was last *emitted* at most ``days`` before, by the same rule if one is named.

    The period runs from the last emitted alert, not from the last one that fired: an entity
    that fires every month with a period of 90 days is heard again after 90 days. Of several
    alerts of one day the first by time (then by ``tie``) is the one emitted; alerts equal in
    both are treated alike. A negative period turns suppression off for its alerts; an alert
    without key or time is never suppressed.

    The scan is over days: alerts are first reduced to one entry for each group, day and period, so
    a group's list is bounded by the calendar, whatever the number of its alerts.
    """
    days = F.lit(days) if isinstance(days, int) else days
    keys = [entity, key, *([rule] if rule else [])]
    rows = alerts.withColumns({"_days": days.cast("int"), "_day": F.to_date(ts), "_at": F.struct(ts, *tie)})
    known = rows.filter(F.col(key).isNotNull() & F.col("_day").isNotNull() & F.col("_days").isNotNull())
    entries = known.groupBy(*keys, "_day", "_days").agg(F.min("_at").alias("_at"))
    lists = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_day", "_days"))).alias("_list"))
    kind = rows.schema["_at"].dataType.simpleString()
    nothing = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(state: Column, e: Column) -> Column:
        near = (e["_days"] >= 0) & state["last"].isNotNull() & (F.datediff(e["_day"], state["last"]) <= e["_days"])
        emit = F.struct(e["_day"].alias("last"), F.array_append(state["out"], e["_at"]).alias("out"))
        return F.when(near, state).otherwise(emit)

    emitted = lists.select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode(F.aggregate("_list", nothing, step, lambda s: s["out"])).alias("_first")).distinct()
    same = F.col("_at") == F.col("_first")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    hidden = F.col("_first").isNull() & F.col(key).isNotNull() & F.col("_day").isNotNull() & (F.col("_days") >= 0)
    return rows.join(emitted, same, "left").select(*alerts.columns, F.coalesce(hidden, F.lit(False)).alias("is_suppressed"))


def build_alerts(risks: DataFrame, entity: str, created: str, window: str | None = None) -> DataFrame:
    """One alert per entity (and consolidation window, if a column is named) from its unsuppressed risks.

    The alert is created with its latest trigger. ``triggers`` lists the activities behind it
    (JSON); the list is bounded by the periods and rules of one entity.
    """
    trigger = F.struct(
        F.col("tr_id").alias("triggerID"), F.struct(F.col(entity).cast("string").alias(entity)).alias("primaryKeySet")
    )
    hidden = F.col("is_suppressed")
    keys = [entity, *([window] if window else [])]
    out = risks.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(~hidden, trigger))).alias("_t"),
        F.max(F.when(~hidden, F.col(created))).alias("createdate"),
        F.round(F.max(F.when(~hidden, F.col("risk_severity"))), 2).alias("severity"),
        F.count(F.when(hidden, 1)).alias("suppressioncount"),
    ).filter(F.size("_t") > 0)
    return out.select(
        F.concat_ws("_", F.lit("alert"), *keys).alias("id"),
        *keys,
        "createdate",
        F.to_json("_t").alias("triggers"),
        F.size("_t").cast("long").alias("trigger_count"),
        (F.size("_t") > 1).alias("isconsolidated"),
        "severity",
        "suppressioncount",
    )
