"""Alert-quality checks over an alert set derived from the transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import quality as q
from tidewatch.plans.detection import ACTS_SQL, activities
from tidewatch.plans.registry import query
from tidewatch.sources.model import ENTITY, PERIOD, table

LARGE = 400000


def alert_set(spark, sf):
    """(alerts, risks, activities) with planted duplicates, gaps and bad lists."""
    acts = activities(spark, sf)
    large = acts.filter(F.col("sum_trx") > LARGE)
    entity = F.col(ENTITY)
    trigger = F.struct(F.col("tr_id").alias("triggerID"), F.struct(entity.cast("string").alias(ENTITY)).alias("primaryKeySet"))
    # a quarter has at most three activities of an entity
    grouped = large.withColumn("quarter", F.floor(F.col(PERIOD) / 3)).groupBy(ENTITY, "quarter").agg(
        F.array_sort(F.collect_list(trigger)).alias("t")
    )
    good = grouped.select(
        F.concat(F.lit("A"), entity, F.lit("-"), F.col("quarter")).alias("id"), ENTITY, "quarter",
        F.to_json("t").alias("triggers"), (F.size("t") > 1).alias("isconsolidated"),
    )
    again = grouped.filter(entity % 10 == 0).select(
        F.concat(F.lit("D"), entity, F.lit("-"), F.col("quarter")).alias("id"), ENTITY, "quarter",
        F.to_json(F.array(F.col("t")[0]["triggerID"])).alias("triggers"), F.lit(True).alias("isconsolidated"),
    )
    broken = table(spark, sf, "supplier").filter("s_suppkey % 17 = 0").select(
        F.concat(F.lit("B"), F.col("s_suppkey")).alias("id"), F.col("s_suppkey").alias(ENTITY), F.lit(115).cast("long").alias("quarter"),
        F.lit("[{not json").alias("triggers"), F.lit(False).alias("isconsolidated"),
    )
    alerts = good.unionByName(again).unionByName(broken)
    day = F.add_months(F.lit("1970-01-01").cast("date"), (F.col("quarter") * 3 + 3).cast("int"))
    alerts = alerts.select(
        "id", "triggers", "isconsolidated",
        (F.date_add(day, (entity % 7).cast("int")).cast("timestamp_ntz") + F.make_dt_interval(hours=(entity % 24).cast("int"))).alias("createdate"),
        F.when(entity % 3 == 0, "High").when(entity % 3 == 1, "Medium").otherwise("Low").alias("severity"),
        F.when(entity % 2 == 0, "state_closed").otherwise("state_new").alias("stateid"),
        (entity % 2 == 0).alias("isclosed"),
        F.when(entity % 5 != 0, F.concat(F.lit("user"), entity % 4)).alias("assignee"),
        (entity % 3).alias("suppressioncount"),
    )
    risks = large.filter(entity % 13 != 0).select(
        "tr_id",
        F.when(entity % 2 == 0, 90).otherwise(27).alias("risk_severity"),
        F.when(entity % 3 == 0, "dynamic_risk").otherwise("default").alias("risk_category"),
        F.lit("AI").alias("risk_analysis_method"),
        F.when(entity % 6 != 0, "pattern").alias("suppression_identifier"),
    )
    evaluated = acts.filter(F.col(PERIOD) % 29 != 0).select(
        "tr_id", F.col("year_month").alias("tr_partition"), F.round(F.least(F.col("sum_trx") / 1000000, F.lit(1.0)), 6).alias("algo_score")
    )
    return alerts, risks, evaluated


SET_SQL = f"""
{ACTS_SQL},
large AS (SELECT * FROM acts WHERE sum_trx > {LARGE}),
grouped AS (SELECT customer_id, month_offset // 3 AS quarter, list(tr_id ORDER BY tr_id) AS t FROM large GROUP BY 1, 2),
raw AS (
  SELECT 'A' || customer_id || '-' || quarter AS id, customer_id, quarter, t AS ids, true AS has_entity, len(t) > 1 AS isconsolidated FROM grouped
  UNION ALL SELECT 'D' || customer_id || '-' || quarter, customer_id, quarter, t[1:1], false, true FROM grouped WHERE customer_id % 10 = 0
  UNION ALL SELECT 'B' || s_suppkey, s_suppkey, 115, []::VARCHAR[], false, false FROM supplier WHERE s_suppkey % 17 = 0),
alerts AS (SELECT id, ids, has_entity, customer_id, isconsolidated,
  (DATE '1970-01-01' + to_months((quarter * 3 + 3)::INT))::TIMESTAMP + to_days((customer_id % 7)::INT) + to_hours((customer_id % 24)::INT) AS createdate,
  CASE customer_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS severity,
  CASE customer_id % 2 WHEN 0 THEN 'state_closed' ELSE 'state_new' END AS stateid, customer_id % 2 = 0 AS isclosed,
  CASE WHEN customer_id % 5 <> 0 THEN 'user' || (customer_id % 4) END AS assignee, customer_id % 3 AS suppressioncount FROM raw),
risk_rows AS (SELECT tr_id, CASE WHEN customer_id % 2 = 0 THEN 90 ELSE 27 END AS risk_severity, CASE WHEN customer_id % 3 = 0 THEN 'dynamic_risk' ELSE 'default' END AS risk_category,
  'AI' AS risk_analysis_method, CASE WHEN customer_id % 6 <> 0 THEN 'pattern' END AS suppression_identifier FROM large WHERE customer_id % 13 <> 0),
evaluated AS (SELECT tr_id, year_month AS tr_partition, round(least(sum_trx / 1000000, 1.0), 6) AS algo_score FROM acts WHERE month_offset % 29 <> 0),
trig AS (SELECT id AS alert_id, unnest(ids) AS trigger_id FROM alerts)"""


@query("SELECT * FROM trig", trx=True, ctes=SET_SQL)
def exploded_triggers(spark, sf):
    return q.explode_triggers(alert_set(spark, sf)[0])


@query("""
SELECT count(*) AS total_alerts, count(*) FILTER (WHERE len(ids) > 1) AS consolidated, count(*) FILTER (WHERE len(ids) = 1) AS single,
       round(count(*) FILTER (WHERE len(ids) > 1) / count(*) * 100, 2) AS consolidation_rate, round(avg(len(ids)), 2) AS avg_triggers, min(len(ids)) AS min_triggers, max(len(ids)) AS max_triggers
FROM alerts""", trx=True, ctes=SET_SQL)
def alert_count_summary(spark, sf):
    return q.alert_counts(alert_set(spark, sf)[0])


@query("""
SELECT trigger_id, alert_id, n AS alert_count FROM trig JOIN (SELECT trigger_id, count(*) AS n FROM trig GROUP BY 1 HAVING count(*) > 1) USING (trigger_id)""", trx=True, ctes=SET_SQL)
def duplicated_triggers(spark, sf):
    return q.duplicate_triggers(alert_set(spark, sf)[0])


@query("""
SELECT count(*) AS triggers_checked, count(*) FILTER (WHERE n > 1) AS duplicates, round(count(*) FILTER (WHERE n > 1) / count(*) * 100, 2) AS duplicate_rate
FROM (SELECT trigger_id, count(*) AS n FROM trig GROUP BY 1)""", trx=True, ctes=SET_SQL)
def duplicated_trigger_summary(spark, sf):
    return q.duplicate_summary(alert_set(spark, sf)[0])


@query("""
SELECT strftime(createdate, '%Y-%m') AS month, count(*) AS alerts, round(count(*) * 100.0 / (SELECT count(*) FROM alerts), 2) AS pct FROM alerts GROUP BY 1""", trx=True, ctes=SET_SQL)
def alerts_per_month(spark, sf):
    return q.alerts_by_month(alert_set(spark, sf)[0])


_MONTHLY_CTES = SET_SQL + """,
monthly AS (SELECT month, count(*) AS total_entities, count(*) FILTER (WHERE tr_id IN (SELECT trigger_id FROM trig)) AS alert_count,
  round(count(*) FILTER (WHERE tr_id IN (SELECT trigger_id FROM trig)) / count(*) * 100, 2) AS alert_pct
  FROM (SELECT DISTINCT strftime(tr_partition, '%Y-%m') AS month, tr_id FROM evaluated) GROUP BY 1)"""


@query("SELECT * FROM monthly", trx=True, ctes=_MONTHLY_CTES)
def monthly_alert_percentage(spark, sf):
    alerts, _, acts = alert_set(spark, sf)
    return q.monthly_alert_pct(alerts, acts)


@query("""
SELECT sum(alert_count)::BIGINT AS total_alerts, sum(total_entities)::BIGINT AS total_entities, round(sum(alert_count) / sum(total_entities) * 100, 2) AS overall_pct,
       round(avg(alert_pct), 2) AS average_pct, count(*) AS months, min_by(month, (-alert_pct, month)) AS highest_month, max(alert_pct) AS highest_pct,
       min_by(month, (alert_pct, month)) AS lowest_month, min(alert_pct) AS lowest_pct FROM monthly""", trx=True, ctes=_MONTHLY_CTES)
def monthly_alert_percentage_summary(spark, sf):
    alerts, _, acts = alert_set(spark, sf)
    return q.monthly_alert_summary(q.monthly_alert_pct(alerts, acts))


@query("""
SELECT *, CASE WHEN triggers_without_risk > 0 OR triggers_without_activity > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (
  SELECT (SELECT count(DISTINCT trigger_id) FROM trig) AS triggers, (SELECT count(DISTINCT tr_id) FROM risk_rows) AS risk_ids, (SELECT count(DISTINCT tr_id) FROM evaluated) AS activity_ids,
    (SELECT count(DISTINCT trigger_id) FROM trig WHERE trigger_id NOT IN (SELECT tr_id FROM risk_rows)) AS triggers_without_risk,
    (SELECT count(DISTINCT trigger_id) FROM trig WHERE trigger_id NOT IN (SELECT tr_id FROM evaluated)) AS triggers_without_activity,
    (SELECT count(DISTINCT tr_id) FROM risk_rows WHERE tr_id NOT IN (SELECT trigger_id FROM trig)) AS risks_without_alert)""", trx=True, ctes=SET_SQL)
def cross_table_consistency(spark, sf):
    return q.consistency(*alert_set(spark, sf))


_ENTITY_CTES = SET_SQL + """,
owners AS (SELECT DISTINCT customer_id, id FROM alerts WHERE has_entity),
per_owner AS (SELECT customer_id, count(*) AS n FROM owners GROUP BY 1)"""


@query("""
SELECT CASE WHEN several = 0 OR multi = 0 THEN 'PASS' WHEN several / entities <= 0.1 THEN 'WARNING' ELSE 'FAIL' END AS status, multi > 0 AS active,
       entities AS total_entities, several AS entities_in_several_alerts, round((1 - several / entities) * 100, 2) AS consolidation_rate,
       total AS total_alerts, multi AS consolidated_alerts, avg_triggers
FROM (SELECT count(*) AS entities, count(*) FILTER (WHERE n > 1) AS several FROM per_owner),
     (SELECT count(*) AS total, count(*) FILTER (WHERE len(ids) > 1) AS multi, round(avg(len(ids)), 2) AS avg_triggers FROM alerts)""", trx=True, ctes=_ENTITY_CTES)
def consolidation_effectiveness(spark, sf):
    return q.consolidation(alert_set(spark, sf)[0])


@query("""
SELECT '{"customer_id":"' || customer_id || '"}' AS entity, id AS alert_id, n AS alert_count FROM owners JOIN per_owner USING (customer_id) WHERE n > 1""", trx=True, ctes=_ENTITY_CTES)
def entities_in_several_alerts(spark, sf):
    return q.split_entities(alert_set(spark, sf)[0])


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE isclosed) AS closed, count(*) FILTER (WHERE NOT isclosed) AS open, count(assignee) AS assigned,
       count(*) - count(assignee) AS unassigned, round(count(assignee) / count(*) * 100, 2) AS assignment_rate, count(*) FILTER (WHERE suppressioncount > 0) AS with_suppression,
       round(avg(suppressioncount), 2) AS avg_suppression, count(*) FILTER (WHERE isconsolidated) AS by_flag,
       abs(count(*) FILTER (WHERE isconsolidated) - count(*) FILTER (WHERE len(ids) > 1)) AS flag_mismatch FROM alerts""", trx=True, ctes=SET_SQL)
def alert_metadata_quality(spark, sf):
    return q.alert_metadata(alert_set(spark, sf)[0])


@query("""
SELECT 'severity' AS "column", severity AS value, count(*) AS n FROM alerts GROUP BY 2
UNION ALL SELECT 'stateid', stateid, count(*) FROM alerts GROUP BY 2""", trx=True, ctes=SET_SQL)
def alert_value_distributions(spark, sf):
    return q.value_distribution(alert_set(spark, sf)[0], ["severity", "stateid"])


@query("""
SELECT count(*) AS risks, count(suppression_identifier) AS with_suppression, round(count(suppression_identifier) / count(*) * 100, 2) AS suppression_pct FROM risk_rows""", trx=True, ctes=SET_SQL)
def risk_metadata_quality(spark, sf):
    return q.risk_metadata(alert_set(spark, sf)[1])


@query("""
SELECT 'risk_severity' AS "column", risk_severity::VARCHAR AS value, count(*) AS n FROM risk_rows GROUP BY 2
UNION ALL SELECT 'risk_category', risk_category, count(*) FROM risk_rows GROUP BY 2
UNION ALL SELECT 'risk_analysis_method', risk_analysis_method, count(*) FROM risk_rows GROUP BY 2""", trx=True, ctes=SET_SQL)
def risk_value_distributions(spark, sf):
    return q.value_distribution(alert_set(spark, sf)[1], ["risk_severity", "risk_category", "risk_analysis_method"])


@query("""
SELECT count(*) AS activities, count(algo_score) AS scored, round(min(algo_score), 6) AS min, round(max(algo_score), 6) AS max, round(avg(algo_score), 4) AS mean,
       round(stddev_samp(algo_score), 4) AS std, round(quantile_cont(algo_score, 0.5), 4) AS p50, round(quantile_cont(algo_score, 0.75), 4) AS p75, round(quantile_cont(algo_score, 0.9), 4) AS p90,
       round(quantile_cont(algo_score, 0.95), 4) AS p95, round(quantile_cont(algo_score, 0.99), 4) AS p99,
       count(*) FILTER (WHERE algo_score >= (SELECT quantile_cont(algo_score, 0.95) FROM evaluated)) AS high_scores,
       round((SELECT count(*) FROM alerts) / count(*) * 100, 2) AS alert_ratio_pct FROM evaluated""", trx=True, ctes=SET_SQL)
def activity_score_distribution(spark, sf):
    alerts, _, acts = alert_set(spark, sf)
    return q.score_distribution(acts, "algo_score", alerts)


@query("""
SELECT 'weekday' AS unit, (isodow(createdate) - 1)::INT AS value, count(*) AS alerts, round(count(*) * 100.0 / (SELECT count(*) FROM alerts), 2) AS pct FROM alerts GROUP BY 2
UNION ALL SELECT 'hour', hour(createdate)::INT, count(*), round(count(*) * 100.0 / (SELECT count(*) FROM alerts), 2) FROM alerts GROUP BY 2""", trx=True, ctes=SET_SQL)
def alert_time_pattern(spark, sf):
    return q.temporal_pattern(alert_set(spark, sf)[0])


@query("""
SELECT figure, value::DOUBLE AS value, hit AS attention, CASE WHEN hit THEN msg END AS recommendation, CASE WHEN hit AND breaking THEN 'FAIL' ELSE 'PASS' END AS status FROM (
  SELECT 'consolidation_rate' AS figure, v AS value, v < 30 AS hit, 'Low consolidation rate' AS msg, false AS breaking FROM (SELECT round(count(*) FILTER (WHERE len(ids) > 1) / count(*) * 100, 2) AS v FROM alerts)
  UNION ALL SELECT 'duplicates', v, v > 0, 'Duplicate triggers found', true FROM (SELECT count(*) FILTER (WHERE n > 1) AS v FROM (SELECT count(*) AS n FROM trig GROUP BY trigger_id))
  UNION ALL SELECT 'triggers_without_risk', v, v > 0, 'Triggers without risk metadata', true FROM (SELECT count(DISTINCT trigger_id) AS v FROM trig WHERE trigger_id NOT IN (SELECT tr_id FROM risk_rows))
  UNION ALL SELECT 'triggers_without_activity', v, v > 0, 'Triggers without activity', true FROM (SELECT count(DISTINCT trigger_id) AS v FROM trig WHERE trigger_id NOT IN (SELECT tr_id FROM evaluated))
  UNION ALL SELECT 'assignment_rate', v, v < 50, 'Low assignment rate', false FROM (SELECT round(count(assignee) / count(*) * 100, 2) AS v FROM alerts)
  UNION ALL SELECT 'suppression_pct', v, v < 80, 'Low suppression coverage', false FROM (SELECT round(count(suppression_identifier) / count(*) * 100, 2) AS v FROM risk_rows)
  UNION ALL SELECT 'max_hour_pct', v, v > 80, 'Alerts created in one hour', false FROM (SELECT max(p) AS v FROM (SELECT round(count(*) * 100.0 / (SELECT count(*) FROM alerts), 2) AS p FROM alerts GROUP BY hour(createdate)))
  UNION ALL SELECT 'alert_ratio_pct', v, v > 5, 'High alert rate', false FROM (SELECT round((SELECT count(*) FROM alerts) / (SELECT count(*) FROM evaluated) * 100, 2) AS v))""", trx=True, ctes=SET_SQL)
def alert_quality_report(spark, sf):
    return q.alert_quality_report(*alert_set(spark, sf))


@query("""
SELECT *, round((alert_details_score + feature_loading_score + network_view_score) / 3.0)::BIGINT AS overall_score FROM (
  SELECT *, CASE WHEN alert_details < 1 THEN 100 WHEN alert_details < 2 THEN 80 WHEN alert_details < 3 THEN 60 ELSE 40 END AS alert_details_score,
    CASE WHEN feature_loading < 2 THEN 100 WHEN feature_loading < 3 THEN 80 WHEN feature_loading < 5 THEN 60 ELSE 40 END AS feature_loading_score,
    CASE WHEN network_view < 2 THEN 100 WHEN network_view < 4 THEN 80 WHEN network_view < 6 THEN 60 ELSE 40 END AS network_view_score
  FROM (SELECT event_id, value / 10 AS alert_details, value / 5 AS feature_loading, (event_id % 80) / 10.0::DOUBLE AS network_view FROM events))""")
def timing_scores(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", (F.col("value") / 10).alias("alert_details"), (F.col("value") / 5).alias("feature_loading"), ((F.col("event_id") % 80) / 10.0).alias("network_view")
    )
    return q.timing_score(df)
