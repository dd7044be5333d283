"""Scoring, rules, alerts and graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import graph, risks as rk, scoring
from tidewatch.plans.detection import (
    ACTS_SQL, FEATURES, RISKS_SQL, SCORED_SQL, STEP, TRAIN_END, activities, risks, scored, suppressed,
)
from tidewatch.plans.registry import query
from tidewatch.sources.model import ENTITY, table, transactions


@query("""
SELECT c_custkey, coalesce(x, (SELECT avg(x) FROM c)) AS x, coalesce(y, 0) AS y FROM c""", ctes="""
c AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(c_acctbal) END AS x, CASE WHEN c_nationkey > 3 THEN c_nationkey::DOUBLE END AS y FROM customer)""")
def numeric_feature_fill(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.round("c_acctbal")).alias("x"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("double")).alias("y")
    )
    return scoring.numeric_features(scoring.numeric_features(df, ["x"], "mean"), ["y"])


@query(f"SELECT tr_id, {', '.join(f'{f}::DOUBLE AS {f}' for f in FEATURES)} FROM acts", trx=True, ctes=ACTS_SQL)
def feature_vectors(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = scoring.numeric_features(activities(spark, sf).withColumnsRenamed({f: f"_{f}" for f in FEATURES}), [f"_{f}" for f in FEATURES])
    v = vector_to_array("features")
    return scoring.assemble(df, [f"_{f}" for f in FEATURES]).select("tr_id", *[v[i].alias(f) for i, f in enumerate(FEATURES)])


@query("""
SELECT c_custkey, coalesce(i, n)::DOUBLE AS idx, n AS size, i AS position FROM (
  SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_mktsegment || c_nationkey END AS label FROM customer)
LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM (
  SELECT DISTINCT c_mktsegment || c_nationkey AS label FROM customer WHERE c_nationkey < 20)) USING (label),
(SELECT count(DISTINCT c_mktsegment || c_nationkey) AS n FROM customer WHERE c_nationkey < 20)""")
def categorical_vectors(spark, sf):
    label = F.when(F.col("c_nationkey") < 20, F.concat("c_mktsegment", F.col("c_nationkey").cast("string")))
    df = scoring.categorical_features(table(spark, sf, "customer").select("c_custkey", label.alias("label")), ["label"])
    return df.select("c_custkey", F.col("label_index").alias("idx"), "label_vec.size", "label_vec.position")


@query("SELECT year_month < DATE '2000-01-01' AS is_train, count(*) AS n FROM acts GROUP BY 1", trx=True, ctes=ACTS_SQL)
def time_split(spark, sf):
    train, test = scoring.split_by_time(activities(spark, sf), "year_month", TRAIN_END)
    n = F.count(F.lit(1)).alias("n")
    return train.agg(n).select(F.lit(True).alias("is_train"), "n").unionByName(test.agg(n).select(F.lit(False).alias("is_train"), "n"))


_SCORE_COLS = ["algo_score", "algo_pattern", *[f"algo_{f}_{s}" for f in FEATURES for s in ("rank", "rating")]]


@query(f"SELECT tr_id, {', '.join(_SCORE_COLS)} FROM scored", trx=True, ctes=SCORED_SQL)
def scored_activities(spark, sf):
    return scored(spark, sf).select("tr_id", *_SCORE_COLS)


@query(f"""
SELECT tr_id, {', '.join(f"(SELECT f FROM ranked r WHERE r.tr_id = s.tr_id AND rnk = {i}) AS trigger_{i}" for i in (1, 2, 3))},
  {', '.join("CASE split_part(algo_pattern, '|', " + str(i) + ") " + " ".join(f"WHEN '{f}' THEN algo_{f}_rating / 10000" for f in FEATURES) + f" END AS trigger_{i}_rating" for i in (1, 2, 3))}
FROM scored s""", trx=True, ctes=SCORED_SQL)
def top_trigger_features(spark, sf):
    df = scored(spark, sf)
    cols = [f"trigger_{i}{s}" for i in (1, 2, 3) for s in ("", "_rating")]
    return scoring.top_triggers(df, STEP, FEATURES, 3).select("tr_id", *cols)


@query("""
SELECT tr_id, risk_id, risk_name, risk_category, risk_severity, risk_analysis_method, suppression_identifier FROM risks""", trx=True, ctes=RISKS_SQL)
def identified_risks(spark, sf):
    return risks(spark, sf).select(
        "tr_id", "risk_id", "risk_name", "risk_category", "risk_severity", "risk_analysis_method", "suppression_identifier"
    )


@query("""
SELECT tr_id, sum_trx, min_amount, max_amount FROM acts JOIN (
  SELECT customer_id, min(sum_trx) AS min_amount, max(sum_trx) AS max_amount FROM acts GROUP BY 1) USING (customer_id)""", trx=True, ctes=ACTS_SQL)
def rule_enrichment(spark, sf):
    acts = activities(spark, sf)
    out = rk.enrich(acts, acts, [ENTITY], {"min_amount": F.min("sum_trx"), "max_amount": F.max("sum_trx")})
    return out.select("tr_id", "sum_trx", "min_amount", "max_amount")


@query("SELECT tr_id, risk_id, is_suppressed FROM flagged", trx=True, ctes=RISKS_SQL)
def suppressed_risks(spark, sf):
    return suppressed(spark, sf).select("tr_id", "risk_id", "is_suppressed")


@query("""
SELECT 'alert_' || customer_id AS id, customer_id, max(year_month) AS createdate,
       '[' || string_agg(DISTINCT '{"triggerID":"' || tr_id || '","primaryKeySet":{"customer_id":"' || customer_id || '"}}', ',' ORDER BY '{"triggerID":"' || tr_id || '","primaryKeySet":{"customer_id":"' || customer_id || '"}}') || ']' AS triggers,
       count(DISTINCT tr_id) AS trigger_count, count(DISTINCT tr_id) > 1 AS isconsolidated, round(max(risk_severity), 2) AS severity,
       (SELECT count(*) FROM flagged g WHERE g.is_suppressed AND g.customer_id = f.customer_id) AS suppressioncount
FROM flagged f WHERE NOT is_suppressed GROUP BY customer_id""", trx=True, ctes=RISKS_SQL)
def built_alerts(spark, sf):
    return rk.build_alerts(suppressed(spark, sf), ENTITY, "year_month")


# --- graph -------------------------------------------------------------------------


def _graph_trx(spark, sf):
    trx = transactions(spark, sf)
    return trx.withColumns(
        {"customer_id": F.concat(F.lit("S"), F.col("customer_id")), "cp_id": F.concat(F.lit("C"), F.col("cp_id"))}
    )


@query("""
SELECT id, id AS AN, min_by(nm, (ts, nm)) AS NM, min_by(ct, (ts, ct)) AS CT, min(ts)::DATE AS effective_date FROM (
  SELECT 'S' || customer_id AS id, customer_name AS nm, cp_jurisdiction AS ct, txn_ts AS ts FROM trx
  UNION ALL SELECT 'C' || cp_id, counterparty_name, cp_jurisdiction, txn_ts FROM trx) GROUP BY id""", trx=True)
def account_nodes(spark, sf):
    return graph.account_nodes(_graph_trx(spark, sf)).withColumn("effective_date", F.col("effective_date").cast("date"))


@query("""
SELECT txn_id AS id, txn_ts::DATE AS effective_date, CASE direction WHEN 'debit' THEN 'S' || customer_id ELSE 'C' || cp_id END AS source_node,
       CASE direction WHEN 'debit' THEN 'C' || cp_id ELSE 'S' || customer_id END AS target_node, amount_usd AS "AM", 'USD' AS "CR", 1::BIGINT AS "CT" FROM trx""", trx=True)
def transaction_edges(spark, sf):
    return graph.txn_edges(_graph_trx(spark, sf)).withColumn("effective_date", F.col("effective_date").cast("date"))


@query("""
SELECT tr_id || '_' || risk_id AS id, tr_id AS "AI", risk_id AS "RI", is_suppressed AS "SP", year_month AS effective_date FROM flagged""", trx=True, ctes=RISKS_SQL)
def alert_nodes(spark, sf):
    return graph.alert_graph(suppressed(spark, sf), activities(spark, sf), ENTITY, "year_month")[0]


@query("""
SELECT tr_id || '_' || risk_id AS id, tr_id || '_' || risk_id AS source_node, customer_id AS target_node, year_month AS effective_date FROM flagged""", trx=True, ctes=RISKS_SQL)
def alert_account_edges(spark, sf):
    return graph.alert_graph(suppressed(spark, sf), activities(spark, sf), ENTITY, "year_month")[1]


@query("SELECT tr_id, risk_id, year_month, is_suppressed, customer_id FROM flagged", trx=True, ctes=RISKS_SQL)
def alerted_activity_rows(spark, sf):
    return graph.alerted_activities(activities(spark, sf), suppressed(spark, sf), ENTITY, "year_month")
