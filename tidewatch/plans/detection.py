"""Activities, scores, risks and alerts over the driver tables, and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.functions.periods import month_start
from tidewatch.operators import risks as rk, scoring
from tidewatch.operators.catalogue import features
from tidewatch.operators.features import heavy_entities, run_features
from tidewatch.plans.monthly_queries import PARAMS
from tidewatch.session import stored
from tidewatch.sources.model import ENTITY, PERIOD, transactions

FEATURES = ["cnt_trx", "many_to_one", "max_trx", "one_to_many", "sum_trx", "sum_trx_cash"]
TRAIN_END = dt.date(2000, 1, 1)
THRESHOLD = 0.5
STEP = "algo"

LABELS = {f: f.replace("_", " ").title() for f in FEATURES}
CATEGORIES = {f: "Cash" if f.endswith("cash") else "Volume" if f.startswith(("cnt", "sum", "max")) else "Network" for f in FEATURES}


def activities(spark, sf):
    """One row per entity and month with an id and the scored features."""
    chosen = features("cnt_trx", "many_to_one", "max_trx", "one_to_many", "z_score_sum_trx", "sum_trx_cash")
    need = {ENTITY, PERIOD}.union(*[f.requires for f in chosen])
    # a counterparty seldom comes twice in an entity's month
    heavy = heavy_entities(transactions(spark, sf, [ENTITY]), ENTITY)
    out = run_features(transactions(spark, sf, sorted(need)), chosen, PARAMS, heavy=heavy)
    return out.select(
        F.concat_ws("-", ENTITY, PERIOD).alias("tr_id"),
        ENTITY,
        PERIOD,
        month_start(F.col(PERIOD)).alias("year_month"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES],
    )


def scored(spark, sf):
    """Activities scored by a model fitted on the training period.

    Fitting and scoring both read the activities: they are written once, like the stored
    feature table they stand for.
    """
    acts = stored(activities(spark, sf))
    train, _ = scoring.split_by_time(acts, "year_month", TRAIN_END)
    return scoring.fit_scores(train, FEATURES).score(acts, STEP)


ACTS_SQL = f"""
acts AS (SELECT customer_id || '-' || month_offset AS tr_id, customer_id, month_offset,
  (DATE '1970-01-01' + to_months(month_offset::INT))::DATE AS year_month, count(*)::DOUBLE AS cnt_trx,
  count(DISTINCT CASE WHEN direction = 'credit' THEN cp_id END)::DOUBLE AS many_to_one, max(amount_usd) AS max_trx,
  count(DISTINCT CASE WHEN direction = 'debit' THEN cp_id END)::DOUBLE AS one_to_many, round(sum(amount_usd), 2) AS sum_trx,
  coalesce(round(sum(CASE WHEN method LIKE 'cash%' THEN amount_usd END), 2), 0) AS sum_trx_cash
  FROM trx GROUP BY customer_id, month_offset)"""

_wide = lambda pattern: ", ".join(pattern.format(f=f) for f in FEATURES)

SCORED_SQL = f"""
{ACTS_SQL},
long AS (UNPIVOT acts ON {', '.join(FEATURES)} INTO NAME f VALUE v),
med AS (SELECT f, quantile_cont(v, 0.5) AS m, stddev_pop(v) AS sd FROM long WHERE year_month < DATE '2000-01-01' GROUP BY f),
spread AS (SELECT f, m, CASE WHEN quantile_cont(abs(v - m), 0.5) > 0 THEN quantile_cont(abs(v - m), 0.5) * 1.4826 ELSE any_value(sd) END AS s
  FROM long JOIN med USING (f) WHERE year_month < DATE '2000-01-01' GROUP BY f, m),
zs AS (SELECT tr_id, f, v, round(greatest((v - m) / nullif(s, 0), 0), 6) AS z FROM long JOIN spread USING (f)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tr_id ORDER BY z DESC, f) AS rnk, sum(z) OVER (PARTITION BY tr_id) AS total FROM zs),
scores AS (SELECT tr_id, round(1 - exp(-sum(z) FILTER (WHERE rnk <= 3) / 12.0), 6) AS algo_score,
  string_agg(f, '|' ORDER BY rnk) FILTER (WHERE rnk <= 3) AS algo_pattern,
  {_wide("max(rnk) FILTER (WHERE f = '{f}')::INT AS algo_{f}_rank")},
  {_wide("coalesce(round(max(z / nullif(total, 0)) FILTER (WHERE f = '{f}') * 10000), 0)::INT AS algo_{f}_rating")}
  FROM ranked GROUP BY tr_id),
scored AS (SELECT * FROM acts JOIN scores USING (tr_id))"""


RULES = [
    rk.RiskRule(
        id="monthly_anomaly",
        category="dynamic_risk",
        severity=90,
        parameters={"fusion_threshold": THRESHOLD, "since": dt.date(1997, 1, 1)},
        variables={"is_anomaly": "activity.algo_score >= {parameters.fusion_threshold} AND activity.year_month > {parameters.since}"},
        conditions={"is_anomaly": True},
        dynamic_severity=lambda: F.round(F.col("algo_score") * 100, 2),
        dynamic_name=lambda: F.concat_ws(
            " | ", *[rk.label_lookup(LABELS, F.split("algo_pattern", r"\|")[i]) for i in (0, 1)]
        ),
        dynamic_category=lambda: rk.label_lookup(CATEGORIES, F.split("algo_pattern", r"\|")[0]),
        suppression_key=lambda: F.split("algo_pattern", r"\|")[0],
        suppression_days=365,
    ),
    rk.RiskRule(
        id="record_turnover",
        category="default",
        severity=27,
        analysis_method="Rule",
        parameters={"floor": 400000},
        enrichments=(rk.Enrichment("activities", (ENTITY,), {"best": "max(sum_trx)"}),),
        variables={
            "is_best": "activity.sum_trx >= {enrichments.best}",
            "is_large": "activity.sum_trx > {parameters.floor}",
        },
        conditions={"is_best": True, "is_large": True},
    ),
]


def risks(spark, sf):
    df = scored(spark, sf)
    return rk.identify_risks(df, RULES, {"activities": df})


def suppressed(spark, sf):
    return rk.suppress(risks(spark, sf), ENTITY, "suppression_identifier", "year_month", F.col("suppression_days"), "risk_id", ["tr_id"])


def _case(mapping: dict[str, str], expr: str) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


RISKS_SQL = f"""
{SCORED_SQL},
risks AS (
  SELECT tr_id, customer_id, year_month, 'monthly_anomaly' AS risk_id,
    {_case(LABELS, "split_part(algo_pattern, '|', 1)")} || ' | ' || {_case(LABELS, "split_part(algo_pattern, '|', 2)")} AS risk_name,
    {_case(CATEGORIES, "split_part(algo_pattern, '|', 1)")} AS risk_category, round(algo_score * 100, 2) AS risk_severity,
    'AI' AS risk_analysis_method, split_part(algo_pattern, '|', 1) AS suppression_identifier, 365 AS suppression_days
  FROM scored WHERE algo_score >= 0.5 AND year_month > DATE '1997-01-01'
  UNION ALL SELECT tr_id, customer_id, year_month, 'record_turnover', 'record_turnover', 'default', 27.0, 'Rule', NULL, -1
  FROM scored WHERE sum_trx > 400000 AND sum_trx >= (SELECT max(b.sum_trx) FROM acts b WHERE b.customer_id = scored.customer_id)),
flagged AS (
  WITH RECURSIVE fired AS (SELECT DISTINCT customer_id, risk_id, suppression_identifier AS k, suppression_days AS d, year_month AS m
    FROM risks WHERE suppression_days >= 0 AND suppression_identifier IS NOT NULL),
  emitted AS (SELECT customer_id, risk_id, k, min(m) AS m FROM fired GROUP BY 1, 2, 3
    UNION ALL SELECT f.customer_id, f.risk_id, f.k, min(f.m) FROM emitted e JOIN fired f ON f.customer_id = e.customer_id AND f.risk_id = e.risk_id AND f.k = e.k
      AND date_diff('day', e.m, f.m) > f.d GROUP BY 1, 2, 3)
  SELECT r.*, r.suppression_days >= 0 AND r.suppression_identifier IS NOT NULL AND e.m IS NULL AS is_suppressed
  FROM risks r LEFT JOIN emitted e ON e.customer_id = r.customer_id AND e.risk_id = r.risk_id AND e.k = r.suppression_identifier AND e.m = r.year_month)"""
