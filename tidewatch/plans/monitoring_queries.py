"""Drift tests and model reports over the scored activities."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.operators import drift
from tidewatch.plans.detection import ACTS_SQL, FEATURES, SCORED_SQL, STEP, THRESHOLD, activities, scored
from tidewatch.plans.registry import mean_sql, query
from tidewatch.session import checkpoint_folder, cut_lineage
from tidewatch.sources.model import ENTITY, PERIOD
from tidewatch.sources.versions import VersionedTable

# The reference period: months 300 (January 1995) to 359 (December 1999).
FIRST, LAST = 300, 359


def _halves(df):
    return drift.split_reference(df, PERIOD, FIRST, LAST)


def _hot(df):
    return df.filter(F.col("algo_score") > THRESHOLD)


@query("SELECT is_ref, count(*) AS n FROM (SELECT month_offset BETWEEN 300 AND 359 AS is_ref FROM acts) GROUP BY 1", trx=True, ctes=ACTS_SQL)
def reference_split(spark, sf):
    ref, cur = _halves(activities(spark, sf))
    n = F.count(F.lit(1)).alias("n")
    return ref.agg(n).select(F.lit(True).alias("is_ref"), "n").unionByName(cur.agg(n).select(F.lit(False).alias("is_ref"), "n"))


def _stability_sql(columns, source: str, zero_filter: str) -> str:
    """Decile edges on the reference, bin shares on both sides, stability sum."""
    deciles = ", ".join(f"quantile_disc(v, {i / 10})" for i in range(1, 10))
    return f"""
lng AS (SELECT month_offset <= 359 AS is_ref, f AS feature, v FROM (UNPIVOT (SELECT month_offset, {', '.join(columns)} FROM {source}) ON {', '.join(columns)} INTO NAME f VALUE v)),
edges AS (SELECT feature, list_distinct([{deciles}]) AS e FROM lng WHERE is_ref {zero_filter} GROUP BY 1),
bins AS (SELECT feature, is_ref, len(list_filter(e, lambda x: x <= v)) AS b FROM lng JOIN edges USING (feature)),
filled AS (SELECT feature, b, count(*) FILTER (WHERE is_ref) AS er, count(*) FILTER (WHERE NOT is_ref) AS ac FROM bins GROUP BY 1, 2),
shares AS (SELECT feature, er / sum(er) OVER (PARTITION BY feature) AS ex, ac / sum(ac) OVER (PARTITION BY feature) AS ac FROM filled),
stability AS (SELECT feature, round(sum(CASE WHEN ex > 0 AND ac > 0 THEN (ac - ex) * ln(ac / ex) END), 6) AS s FROM shares GROUP BY 1)"""


@query("SELECT feature, s AS csi, CASE WHEN s >= 0.25 THEN 'FAIL' ELSE 'PASS' END AS result FROM stability", trx=True,
       ctes=ACTS_SQL + "," + _stability_sql(FEATURES, "acts", "AND v <> 0"))
def feature_stability(spark, sf):
    return drift.csi(*_halves(cut_lineage(activities(spark, sf))), FEATURES)


@query("SELECT feature, s AS psi, CASE WHEN s > 0.25 THEN 'FAIL' ELSE 'PASS' END AS result FROM stability", trx=True,
       ctes=SCORED_SQL + "," + _stability_sql(["algo_score"], "scored", ""))
def score_stability(spark, sf):
    return drift.psi(*_halves(cut_lineage(scored(spark, sf))), "algo_score")


# The counts of each period are stored as they come in; stability over all periods needs no old rows.
@query("SELECT feature, s AS csi, CASE WHEN s >= 0.25 THEN 'FAIL' ELSE 'PASS' END AS result FROM stability", trx=True,
       ctes=ACTS_SQL + "," + _stability_sql(FEATURES, "acts", "AND v <> 0"))
def stability_of_stored_counts(spark, sf):
    acts = cut_lineage(activities(spark, sf))
    counted = drift.value_counts(acts, PERIOD, FEATURES)
    folder = f"{checkpoint_folder(spark)}/counts-{uuid.uuid4().hex}"
    stored = VersionedTable(spark, folder, counted.schema, [PERIOD])
    p = F.col(PERIOD)
    for months in (p <= 340, (p > 340) & (p <= 359), (p > 359) & (p <= 370), p > 370):
        stored.append(drift.value_counts(acts.filter(months), PERIOD, FEATURES))
    counts = stored.read()
    return drift.csi_of_counts(counts.select((p <= 359).alias("is_ref"), "feature", "value", "n"))


@query("""
SELECT month_offset, count(*) AS total, count(*) FILTER (WHERE algo_score > 0.5) AS anomalies, round(count(*) FILTER (WHERE algo_score > 0.5) / count(*), 6) AS ratio
FROM scored GROUP BY 1""", trx=True, ctes=SCORED_SQL)
def anomaly_rates(spark, sf):
    return drift.anomaly_rate(scored(spark, sf), "algo_score", THRESHOLD, PERIOD)


_TRIGGER_CTES = SCORED_SQL + """,
hot AS (SELECT * FROM scored WHERE algo_score > 0.5),
size AS (SELECT month_offset, count(*) AS anomalies FROM hot GROUP BY 1),
share AS (SELECT month_offset, f AS trigger_feature, count(*) / any_value(anomalies) AS share, any_value(anomalies) AS anomalies
  FROM hot JOIN ranked USING (tr_id) JOIN size USING (month_offset) WHERE rnk <= 3 GROUP BY 1, 2),
refs AS (SELECT trigger_feature, avg(share) AS m, stddev_samp(share) AS sd FROM share WHERE month_offset <= 359 GROUP BY 1),
drifts AS (SELECT trigger_feature, month_offset, anomalies, round(share, 6) AS share, round((share - m) / nullif(sd, 0), 2) AS z
  FROM share JOIN refs USING (trigger_feature) WHERE month_offset > 359)"""


@query("""
SELECT trigger_feature, month_offset, anomalies, share, coalesce(z, 0) AS zscore, CASE WHEN abs(z) >= 1.6448536269514722 THEN 'FAIL' ELSE 'PASS' END AS result FROM drifts""",
       trx=True, ctes=_TRIGGER_CTES)
def trigger_feature_drift(spark, sf):
    ref, cur = _halves(_hot(scored(spark, sf)))
    return drift.trigger_drift(ref, cur, PERIOD, STEP, FEATURES)


@query(f"""
SELECT f AS feature FROM (SELECT unnest([{', '.join(repr(f) for f in FEATURES)}]) AS f) WHERE f NOT IN (
  SELECT f FROM scored JOIN ranked USING (tr_id) WHERE rnk <= 1 AND algo_score > 0.5)""", trx=True, ctes=SCORED_SQL)
def never_triggered_features(spark, sf):
    return drift.never_triggered(scored(spark, sf).filter("algo_score > 0.5"), STEP, FEATURES, k=1)


@query("""
SELECT b AS bin, round(lo + b * w, 6) AS bin_start, round(count(*) FILTER (WHERE r) / any_value(tr), 6) AS rate_ref, round(count(*) FILTER (WHERE NOT r) / any_value(tc), 6) AS rate_cur
FROM (SELECT month_offset <= 359 AS r, least(floor((sum_trx - lo) / w), 19)::INT AS b, lo, w, tr, tc FROM acts,
  (SELECT min(sum_trx) AS lo, (max(sum_trx) - min(sum_trx)) / 20 AS w, count(*) FILTER (WHERE month_offset <= 359) AS tr, count(*) FILTER (WHERE month_offset > 359) AS tc FROM acts))
GROUP BY b, lo, w""", trx=True, ctes=ACTS_SQL)
def histogram_comparison(spark, sf):
    return drift.histogram_compare(*_halves(cut_lineage(activities(spark, sf))), "sum_trx")


_VERDICT_CTES = (
    _TRIGGER_CTES + "," + _stability_sql(FEATURES, "acts", "AND v <> 0") + """,
rate AS (SELECT month_offset, round(count(*) FILTER (WHERE algo_score > 0.5) / count(*), 6) AS r FROM scored GROUP BY 1),
figures AS (
  SELECT 'anomaly_percentage' AS test, max(abs(round((r - m) / nullif(s, 0), 4))) AS value, 5.0 AS threshold FROM rate, (SELECT avg(r) AS m, stddev_samp(r) AS s FROM rate WHERE month_offset <= 359) WHERE month_offset > 359
  UNION ALL SELECT 'iqr_score', round(abs(a.q - b.q), 6), 0.1 FROM (SELECT quantile_disc(algo_score, 0.75) - quantile_disc(algo_score, 0.25) AS q FROM scored WHERE month_offset <= 359) a,
    (SELECT quantile_disc(algo_score, 0.75) - quantile_disc(algo_score, 0.25) AS q FROM scored WHERE month_offset > 359) b
  UNION ALL SELECT 'csi_features', avg(CASE WHEN s >= 0.25 THEN 1.0 ELSE 0.0 END), 0.25 FROM stability
  UNION ALL SELECT 'max_csi', max(s), 0.5 FROM stability
  UNION ALL SELECT 'trigger_features', avg(x), 0.25 FROM (SELECT max(CASE WHEN abs(z) >= 1.6448536269514722 THEN 1.0 ELSE 0.0 END) AS x FROM drifts GROUP BY trigger_feature))"""
)


@query("""
SELECT test, round(value::DOUBLE, 6) AS value, threshold::DOUBLE AS threshold, CASE WHEN value > threshold THEN 'FAIL' ELSE 'PASS' END AS result FROM figures""", trx=True, ctes=_VERDICT_CTES)
def drift_test_verdicts(spark, sf):
    # both halves of every test read the scores: written once to the checkpoint folder
    df = cut_lineage(scored(spark, sf))
    return drift.drift_verdict(drift.drift_metrics(*_halves(df), PERIOD, "algo_score", STEP, FEATURES))


@query("""
SELECT min(year_month) AS min_date, max(year_month) AS max_date, date_diff('month', min(year_month), max(year_month)) AS months,
       count(*) FILTER (WHERE algo_score > 0.5) AS anomalies, count(*) AS investigated, round(count(*) FILTER (WHERE algo_score > 0.5) / count(*) * 100, 4) AS anomaly_pct, 6::BIGINT AS features
FROM scored""", trx=True, ctes=SCORED_SQL)
def anomaly_overview(spark, sf):
    return drift.alert_overview(scored(spark, sf), "year_month", "algo_score", THRESHOLD, len(FEATURES))


@query("""
SELECT year_month, count(*) FILTER (WHERE algo_score > 0.5) AS anomalies, count(*) AS investigated, round(count(*) FILTER (WHERE algo_score > 0.5) / count(*) * 100, 2) AS anomaly_pct
FROM scored GROUP BY 1""", trx=True, ctes=SCORED_SQL)
def anomaly_overview_by_month(spark, sf):
    return drift.alert_overview_by(scored(spark, sf), "year_month", "algo_score", THRESHOLD)


_REPORT = SCORED_SQL + """,
trig AS (SELECT tr_id, f, rnk, CASE f """ + " ".join(f"WHEN '{f}' THEN {f}" for f in FEATURES) + """ END AS val,
  CASE f """ + " ".join(f"WHEN '{f}' THEN algo_{f}_rating / 10000" for f in FEATURES) + """ END AS rating, algo_score, cnt_trx, sum_trx
  FROM scored JOIN (SELECT tr_id, f, rnk FROM ranked) USING (tr_id) WHERE algo_score > 0.5)"""


def _report(spark, sf, k=5):
    return drift.alert_report(scored(spark, sf), STEP, FEATURES, [ENTITY, "tr_id"], ["sum_trx", "cnt_trx"], THRESHOLD, k)


@query(f"""
SELECT s.customer_id, tr_id, algo_score, sum_trx, cnt_trx, {', '.join(f"t{i}.f AS trigger_{i}, t{i}.val AS trigger_{i}_value, t{i}.rating AS trigger_{i}_rating" for i in range(1, 6))}
FROM scored s {' '.join(f"JOIN (SELECT tr_id, f, val, rating FROM trig WHERE rnk = {i}) t{i} USING (tr_id)" for i in range(1, 6))}""", trx=True, ctes=_REPORT)
def anomaly_report(spark, sf):
    return _report(spark, sf)


@query("""
SELECT coalesce(b, 'total') AS bin, coalesce(f, 'total') AS feature, count(*) AS n FROM (
  SELECT f, format('{:.2f}', 0.5 + ceil(round((algo_score - 0.5) / 0.05, 9)) * 0.05) AS b FROM trig WHERE rnk = 1)
GROUP BY CUBE (b, f)""", trx=True, ctes=_REPORT)
def score_bins_by_trigger(spark, sf):
    return drift.bin_counts(_report(spark, sf, 1), "algo_score", "trigger_1")


@query(f"""
SELECT f AS trigger_feature, count(*) AS alerts, round(100.0 * count(*) / (SELECT count(DISTINCT tr_id) FROM trig), 2) AS alerts_pct,
       {mean_sql("algo_score", 4)} AS avg_score, {mean_sql("rating", 4)} AS avg_rating,
       count(*) FILTER (WHERE rnk = 1) AS n_trigger_1, count(*) FILTER (WHERE rnk = 2) AS n_trigger_2, count(*) FILTER (WHERE rnk = 3) AS n_trigger_3,
       min(sum_trx) AS min_sum_trx, max(sum_trx) AS max_sum_trx, {mean_sql("sum_trx", 2)} AS avg_sum_trx, min(cnt_trx) AS min_cnt_trx, max(cnt_trx) AS max_cnt_trx, {mean_sql("cnt_trx", 2)} AS avg_cnt_trx
FROM trig WHERE rnk <= 3 GROUP BY 1""", trx=True, ctes=_REPORT)
def trigger_feature_history(spark, sf):
    return drift.trigger_history(_report(spark, sf, 3), "algo_score", ["sum_trx", "cnt_trx"])


@query(f"""
SELECT split_part(algo_pattern, '|', 1) AS trigger_1, split_part(algo_pattern, '|', 2) AS trigger_2, split_part(algo_pattern, '|', 3) AS trigger_3, count(*) AS n,
       round(100.0 * count(*) / (SELECT count(*) FROM scored WHERE algo_score > 0.5), 2) AS pct, min(sum_trx) AS min_sum_trx, max(sum_trx) AS max_sum_trx, {mean_sql("sum_trx", 2)} AS avg_sum_trx
FROM scored WHERE algo_score > 0.5 GROUP BY 1, 2, 3""", trx=True, ctes=_REPORT)
def trigger_patterns(spark, sf):
    return drift.pattern_stats(_report(spark, sf, 3), ["sum_trx"])
