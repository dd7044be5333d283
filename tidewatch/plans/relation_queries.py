"""Explanations, profiles, joins, set comparisons and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import explain as ex, profiles, relate
from tidewatch.operators.catalogue import CATALOGUE
from tidewatch.operators.percentiles import percentiles
from tidewatch.plans.registry import mean_sql, query
from tidewatch.sources.model import ENTITY, PERIOD, table, transactions

KEYS = [ENTITY, PERIOD]

# --- explanations -------------------------------------------------------------


@query(f"""
SELECT month_offset, {mean_sql("CASE WHEN s > 0 THEN s END", 2)} AS pop_avg_sum_trx, {mean_sql("CASE WHEN n > 0 THEN n END", 2)} AS pop_avg_cnt_trx,
       count(DISTINCT CASE WHEN cash > 0 THEN customer_id END) AS pop_dstnct_cust_trx_cash
FROM (SELECT customer_id, month_offset, round(sum(amount_usd), 2) AS s, count(*) AS n, count(*) FILTER (WHERE method LIKE 'cash%') AS cash FROM trx GROUP BY 1, 2)
GROUP BY 1""", trx=True)
def population_statistics(spark, sf):
    base = transactions(spark, sf, [*KEYS, "amount_usd", "method"]).groupBy(*KEYS).agg(
        F.round(F.sum("amount_usd"), 2).alias("s"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("method").like("cash%"), 1)).alias("cash")
    )
    return ex.population_stats(base, PERIOD, {"pop_avg_sum_trx": "s", "pop_avg_cnt_trx": "n"}, {"pop_dstnct_cust_trx_cash": "cash"})


@query("""
SELECT customer_id, month_offset, cp_id,
       count(*) FILTER (WHERE direction = 'debit') AS debit_c, round(sum(amount_usd) FILTER (WHERE direction = 'debit'), 2) AS debit_s,
       count(*) FILTER (WHERE direction = 'credit') AS credit_c, round(sum(amount_usd) FILTER (WHERE direction = 'credit'), 2) AS credit_s,
       count(*) FILTER (WHERE ip_hash = counterparty_ip AND customer_id <> cp_id) AS same_ip_c,
       round(sum(amount_usd) FILTER (WHERE ip_hash = counterparty_ip AND customer_id <> cp_id), 2) AS same_ip_s
FROM trx GROUP BY 1, 2, 3""", trx=True)
def counterparty_explanations(spark, sf):
    trx = transactions(spark, sf, [*KEYS, "cp_id", "amount_usd", "direction", "ip_hash", "counterparty_ip"])
    views = {
        "debit": F.col("direction") == "debit",
        "credit": F.col("direction") == "credit",
        "same_ip": (F.col("ip_hash") == F.col("counterparty_ip")) & (F.col(ENTITY) != F.col("cp_id")),
    }
    return ex.explain_many(trx, KEYS, "cp_id", "amount_usd", views)


@query("""
SELECT customer_id, month_offset, 0::BIGINT AS part, '{"data":[' || string_agg('{"ct":"' || cp_jurisdiction || '","cr":"' || cr || '","c":' || c || '}', ',' ORDER BY cp_jurisdiction) || ']}' AS explanation
FROM (SELECT customer_id, month_offset, cp_jurisdiction, max(cp_country_risk_level) AS cr, count(*) AS c FROM trx WHERE cp_country_risk_level IN ('High', 'Medium', 'Low') GROUP BY 1, 2, 3)
GROUP BY 1, 2""", trx=True)
def country_explanation_json(spark, sf):
    trx = transactions(spark, sf, [*KEYS, "cp_jurisdiction", "cp_country_risk_level", "amount_usd"])
    rows = ex.explain_by(
        trx, KEYS, "cp_jurisdiction", "amount_usd", F.col("cp_country_risk_level").isin("High", "Medium", "Low"),
        ["cp_country_risk_level"],
    )
    return ex.packed(rows, KEYS, {"ct": "cp_jurisdiction", "cr": "cp_country_risk_level", "c": "c"}, "explanation")


@query("""
SELECT customer_id, month_offset, cp_jurisdiction, cp_country_risk_level, count(*) AS c, round(sum(amount_usd), 2) AS s
FROM trx GROUP BY 1, 2, 3, 4""", trx=True)
def country_explanation(spark, sf):
    trx = transactions(spark, sf, [*KEYS, "cp_jurisdiction", "cp_country_risk_level", "amount_usd"])
    return ex.explain_by(
        trx, KEYS, "cp_jurisdiction", "amount_usd", carry=["cp_country_risk_level"]
    )


@query("""
SELECT customer_id, month_offset, max_by(cp_id, (s, cp_id)) AS cp_concentration_cn, max_by(c, (s, cp_id)) AS cp_concentration_c,
       max(s) AS cp_concentration_s, max(s) / nullif(round(sum(s), 2), 0) AS cp_concentration
FROM (SELECT customer_id, month_offset, cp_id, count(*) AS c, round(sum(amount_usd), 2) AS s FROM trx WHERE direction = 'debit' GROUP BY 1, 2, 3)
GROUP BY 1, 2""", trx=True)
def counterparty_concentration(spark, sf):
    trx = transactions(spark, sf, [*KEYS, "cp_id", "amount_usd", "direction"])
    return ex.concentration(ex.explain_by(trx, KEYS, "cp_id", "amount_usd", F.col("direction") == "debit"), KEYS, "cp_id")


_CUSTOMER_TRX = """
SELECT o_custkey AS account_id, n_name AS receiver_country, CASE n_regionkey WHEN 0 THEN 'Very High' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS risk, l_extendedprice AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""


def _customer_payments(spark, sf):
    """Order customers paying suppliers abroad."""
    risk = F.col("n_regionkey")
    return (
        table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_custkey").alias("account_id"), F.col("n_name").alias("receiver_country"),
            F.when(risk == 0, "Very High").when(risk == 1, "High").when(risk == 2, "Medium").otherwise("Low").alias("risk"),
            F.col("l_extendedprice").alias("amount"), F.col("l_returnflag"),
        )
    )


@query(f"""
SELECT account_id, receiver_country, risk, count(*) AS c, round(sum(amount), 2) AS s,
       bool_or(risk IN ('High', 'Very High')) OVER (PARTITION BY account_id) AS high_risk_countries
FROM ({_CUSTOMER_TRX}) GROUP BY 1, 2, 3""")
def high_risk_country_flag(spark, sf):
    rows, flags = ex.explain_country(_customer_payments(spark, sf), "account_id", "receiver_country", "risk", "amount")
    return rows.join(flags, "account_id")


@query("""
SELECT c_custkey AS account_id, kw IS NOT NULL AS keyword_matches, kw, n, s FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderpriority AS kw, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 300000 GROUP BY 1, 2) ON o_custkey = c_custkey""")
def keyword_match_explanation(spark, sf):
    kw = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 300000), F.col("o_orderpriority"))
    trx = table(spark, sf, "orders").select(F.col("o_custkey").alias("account_id"), kw.alias("kw"), "o_totalprice")
    rows = ex.explain_keyword(trx, "account_id", "kw", "o_totalprice")
    accounts = table(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"))
    return ex.with_keyword_flag(accounts, rows, "account_id").join(
        rows.select("account_id", "kw", F.col("c").alias("n"), "s"), "account_id", "left"
    )


# --- profiles ---------------------------------------------------------------------

_LOOK = ", ".join(
    f"min(CASE WHEN gap < {x * 30} THEN balance END) AS min{x}, max(CASE WHEN gap < {x * 30} THEN balance END) AS max{x}, "
    f"round(avg(CASE WHEN gap < {x * 30} THEN balance END), 4) AS mean{x}"
    for x in range(1, 7)
)


@query(f"""
SELECT account_id, {_LOOK} FROM (
  SELECT DISTINCT account_id, balance, gap // 30 AS block, (gap // 30) * 30 AS gap FROM (
    SELECT o_custkey AS account_id, round(o_totalprice / 1000, 0) AS balance,
           date_diff('day', o_orderdate::DATE, DATE '1998-06-01' + (o_custkey % 300)::INT) AS gap FROM orders)
  WHERE gap > 0 AND gap < 180)
GROUP BY 1""")
def balance_look_back(spark, sf):
    anchor = F.date_add(F.lit("1998-06-01").cast("date"), (F.col("o_custkey") % 300).cast("int"))
    df = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("account_id"), F.round(F.col("o_totalprice") / 1000, 0).alias("balance"), "o_orderdate", anchor.alias("date_loan")
    )
    # a block's distinct pairs, as windows end on block borders
    return profiles.lookback_stats(df, "account_id", "o_orderdate", "date_loan", "balance")


@query("""
SELECT customer_id, month_offset, count(*) FILTER (WHERE direction = 'credit') AS tr_in_count, round(sum(amount_usd) FILTER (WHERE direction = 'credit'), 2) AS tr_in,
       count(*) FILTER (WHERE direction = 'debit') AS tr_out_count, round(sum(amount_usd) FILTER (WHERE direction = 'debit'), 2) AS tr_out,
       coalesce(string_agg(DISTINCT CASE WHEN cp_country_risk_level = 'High' THEN cp_jurisdiction END, ',' ORDER BY CASE WHEN cp_country_risk_level = 'High' THEN cp_jurisdiction END), '') AS hr_cc,
       coalesce(string_agg(DISTINCT CASE WHEN cp_country_risk_level = 'Low' THEN cp_jurisdiction END, ',' ORDER BY CASE WHEN cp_country_risk_level = 'Low' THEN cp_jurisdiction END), '') AS lr_cc,
       max(customer_name) AS customer_name, min(date_trunc('month', txn_ts))::DATE AS trx_to_date, (min(date_trunc('month', txn_ts)) - INTERVAL 1 MONTH)::DATE AS trx_from_date
FROM trx GROUP BY 1, 2""", trx=True)
def monthly_customer_insights(spark, sf):
    trx = transactions(spark, sf, [*KEYS, "direction", "amount_usd", "cp_country_risk_level", "cp_jurisdiction", "customer_name"])
    out = profiles.customer_insights(trx, ENTITY, ["customer_name"])
    return out.drop("mr_cc").withColumns({c: F.array_join(c, ",") for c in ("hr_cc", "lr_cc")})


@query("""
SELECT a.account_id, kyc_name, risk AS kyc_classification, n = 1 AS kyc_is_new, n > 1 AS kyc_recently_updated,
       coalesce(tr_in_count, 0) AS tr_in_count, coalesce(tr_in, 0) AS tr_in, coalesce(tr_out_count, 0) AS tr_out_count, coalesce(tr_out, 0) AS tr_out,
       coalesce(hr_cc, '') AS hr_cc, coalesce(tm_open, 0) AS tm_open, coalesce(tm_closed, 0) AS tm_closed, coalesce(tm_false_positives, 0) AS tm_false_positives
FROM (SELECT account_id, max_by(name, ts) AS kyc_name, max_by(country, ts) AS country, count(*) AS n FROM versions GROUP BY 1) a
LEFT JOIN risk ON country = country_code
LEFT JOIN (SELECT id AS account_id, count(*) FILTER (WHERE incoming) AS tr_in_count, round(sum(amount) FILTER (WHERE incoming), 2) AS tr_in,
             count(*) FILTER (WHERE NOT incoming) AS tr_out_count, round(sum(amount) FILTER (WHERE NOT incoming), 2) AS tr_out FROM sides GROUP BY 1) f USING (account_id)
LEFT JOIN (SELECT id AS account_id, string_agg(DISTINCT c, ',' ORDER BY c) AS hr_cc FROM (
             SELECT id, c1 AS c, r1 AS r FROM sides UNION ALL SELECT id, c2, r2 FROM sides) WHERE r = 'High' GROUP BY 1) h USING (account_id)
LEFT JOIN (SELECT o_custkey AS account_id, count(*) FILTER (WHERE o_orderstatus <> 'F') AS tm_open, count(*) FILTER (WHERE o_orderstatus = 'F') AS tm_closed,
             count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS tm_false_positives FROM orders WHERE o_totalprice > 400000 GROUP BY 1) t USING (account_id)""", ctes="""
versions AS (SELECT c_custkey AS account_id, c_name AS name, c_nationkey AS country, 1 AS ts FROM customer
  UNION ALL SELECT c_custkey, c_name || ' new', (c_nationkey + 1) % 25, 2 FROM customer WHERE c_custkey % 4 = 0),
risk AS (SELECT n_nationkey AS country_code, CASE n_regionkey WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS risk FROM nation),
home AS (SELECT account_id, max_by(country, ts) AS country FROM versions GROUP BY 1),
sides AS (SELECT unnest([o_custkey, other]) AS id, unnest([false, true]) AS incoming, o_totalprice AS amount, c1, c2, r1, r2 FROM (
  SELECT o_custkey, other, o_totalprice, h1.country AS c1, h2.country AS c2, k1.risk AS r1, k2.risk AS r2
  FROM (SELECT *, (o_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS other FROM orders) o
  LEFT JOIN home h1 ON h1.account_id = o_custkey LEFT JOIN risk k1 ON k1.country_code = h1.country
  LEFT JOIN home h2 ON h2.account_id = other LEFT JOIN risk k2 ON k2.country_code = h2.country))""")
def account_insights(spark, sf):
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    versions = customer.select(
        key.alias("account_id"), F.col("c_name").alias("name"), nation.alias("country"), F.lit(1).alias("tr_job_ts")
    ).unionByName(
        customer.filter(key % 4 == 0).select(
            key.alias("account_id"), F.concat("c_name", F.lit(" new")).alias("name"), ((nation + 1) % 25).alias("country"), F.lit(2).alias("tr_job_ts")
        )
    )
    region = F.col("n_regionkey")
    risk = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("country_code"), F.when(region == 0, "High").when(region == 1, "Medium").otherwise("Low").alias("risk")
    )
    n = customer.count()
    transfers = orders.select(
        F.col("o_custkey").alias("account_id"), ((F.col("o_custkey") * 7 + 3) % n).alias("receiver_id"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("ts"),
    )
    alerts = orders.filter("o_totalprice > 400000").select(
        F.col("o_custkey").alias("account_id"),
        F.when(F.col("o_orderstatus") == "F", "state_closed").otherwise("state_new").alias("state_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Non_Issue").alias("resolution_code"),
    )
    out = profiles.account_insights(versions, transfers, risk, alerts)
    return out.drop("mr_cc", "lr_cc", "trx_from_date", "trx_to_date").withColumn("hr_cc", F.array_join("hr_cc", ","))


_PERC = ", ".join(f"round(quantile_disc(l_extendedprice, {p / 100}), 2) AS perc_{p}" for p in profiles.PROFILE_PROBS)


@query(f"""
SELECT 'l_extendedprice' AS feature_name, l_returnflag, count(*) FILTER (WHERE l_extendedprice > 0) AS count_positive, count(*) AS count_all,
       round(count(*) FILTER (WHERE l_extendedprice > 0) / count(*), 2) AS positive_prop, min(l_extendedprice) AS min, {_PERC},
       round(max(l_extendedprice), 2) AS max, round(avg(l_extendedprice), 2) AS avg, round(stddev_samp(l_extendedprice), 2) AS stddev,
       round(round(quantile_disc(l_extendedprice, 0.75), 2) - round(quantile_disc(l_extendedprice, 0.25), 2), 2) AS iqr,
       round(max(l_extendedprice), 2) - min(l_extendedprice) AS value_range
FROM lineitem GROUP BY 2""")
def distribution_profile(spark, sf):
    return profiles.distribution(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query("""
SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90, quantile_cont(l_quantity, 0.0) AS p0, quantile_cont(l_quantity, 1.0) AS p100
FROM lineitem GROUP BY 1""")
def exact_percentiles(spark, sf):
    return percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", {"p50": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0})


@query("""
SELECT c_mktsegment, c_nationkey, count(*) AS group_size, count(c_acctbal) AS c_acctbal_count, round(avg(c_acctbal), 4) AS c_acctbal_mean,
       round(sum(c_acctbal), 2) AS c_acctbal_sum, min(c_acctbal) AS c_acctbal_min, max(c_acctbal) AS c_acctbal_max, round(stddev_samp(c_acctbal), 4) AS c_acctbal_std
FROM customer GROUP BY 1, 2""")
def grouped_aggregates(spark, sf):
    df = table(spark, sf, "customer").select("c_mktsegment", "c_nationkey", "c_acctbal")
    out = profiles.aggregate(df, ["c_mktsegment", "c_nationkey"], None, ["count", "mean", "sum", "min", "max", "std"])
    digits = {"c_acctbal_mean": 4, "c_acctbal_sum": 2, "c_acctbal_std": 4}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _baseline_sql() -> str:
    out = ["customer_id"]
    for name, w in (("cur", "month_offset = 350"), ("base", "month_offset BETWEEN 347 AND 349")):
        out += [
            f"round(coalesce(sum(abs(amount_usd)) FILTER (WHERE {w}), 0), 2) AS {name}_turnover",
            f"count(*) FILTER (WHERE {w}) AS {name}_count",
            f"round(coalesce(max(abs(amount_usd)) FILTER (WHERE {w}), 0), 2) AS {name}_max",
            f"count(DISTINCT cp_id) FILTER (WHERE {w}) AS {name}_partners",
            f"round(coalesce(sum(abs(amount_usd)) FILTER (WHERE {w} AND cp_country_risk_level = 'High'), 0), 2) AS {name}_high_risk",
        ]
    return f"SELECT {', '.join(out)} FROM trx GROUP BY 1 HAVING count(*) FILTER (WHERE month_offset = 350) > 0"


@query(_baseline_sql(), trx=True)
def baseline_against_current(spark, sf):
    trx = transactions(spark, sf, [*KEYS, "cp_id", "amount_usd", "cp_country_risk_level"])
    return profiles.baseline_profile(trx, ENTITY, 350)


@query("""
SELECT 'l_tax' AS "column", false AS constant UNION ALL SELECT 'one', true UNION ALL SELECT 'one_or_null', false UNION ALL SELECT 'nothing', true""")
def zero_variance_columns(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_tax", (F.col("l_orderkey") * 0).alias("one"), F.when(F.col("l_linenumber") > 1, 1).alias("one_or_null"),
        F.nullif(F.col("l_linestatus"), F.col("l_linestatus")).alias("nothing"),
    )
    return profiles.zero_variance(df, df.columns)


# --- joins --------------------------------------------------------------------------


@query("""
SELECT s.account_id, s.disp_id, loan_id, s.client_id, client_name, card_id, date_loan FROM (
  SELECT coalesce(a.account_id, d.account_id) AS account_id, disp_id, client_id FROM account a FULL JOIN disp d USING (account_id)) s
JOIN loan l ON l.account_id = s.account_id LEFT JOIN client USING (client_id) LEFT JOIN card ON card.disp_id = s.disp_id""", ctes="""
account AS (SELECT c_custkey AS account_id FROM customer),
disp AS (SELECT o_orderkey AS disp_id, o_custkey AS account_id, o_orderkey % 100 AS client_id FROM orders WHERE o_orderstatus = 'O'),
loan AS (SELECT o_custkey AS account_id, min(o_orderkey) AS loan_id, min(o_orderdate)::DATE AS date_loan FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
client AS (SELECT s_suppkey AS client_id, s_name AS client_name FROM supplier),
card AS (SELECT l_orderkey AS disp_id, min(l_partkey) AS card_id FROM lineitem WHERE l_quantity > 45 GROUP BY 1)""")
def entity_star_with_loan(spark, sf):
    orders = table(spark, sf, "orders")
    account = table(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"))
    disp = orders.filter("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("disp_id"), F.col("o_custkey").alias("account_id"), (F.col("o_orderkey") % 100).alias("client_id")
    )
    loan = orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("account_id")).agg(
        F.min("o_orderkey").alias("loan_id"), F.min("o_orderdate").cast("date").alias("date_loan")
    )
    client = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("client_id"), F.col("s_name").alias("client_name"))
    card = table(spark, sf, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("disp_id")).agg(F.min("l_partkey").alias("card_id"))
    return relate.entity_star(account, disp, loan, client, card).select(
        "account_id", "disp_id", "loan_id", "client_id", "client_name", "card_id", "date_loan"
    )


@query("""
SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3""")
def inner_and_left_enrichment(spark, sf):
    nation = table(spark, sf, "nation").filter("n_regionkey < 3")
    # 25 nations at every scale: left to the planner's own size check
    return (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select("o_orderkey", "c_name", "n_name")
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def anti_join_new_only(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return relate.new_only(table(spark, sf, "customer").select("c_custkey"), big, "c_custkey")


def _large_months(spark, sf):
    trx = transactions(spark, sf, [*KEYS, "amount_usd"])
    sums = trx.groupBy(*KEYS).agg(F.round(F.sum("amount_usd"), 2).alias("total")).filter("total > 600000")
    return sums.select(ENTITY, F.add_months(F.lit("1970-01-01").cast("date"), F.col(PERIOD).cast("int")).alias("year_month"), "total")


_LARGE_SQL = """
acts AS (SELECT customer_id, (DATE '1970-01-01' + to_months(month_offset::INT))::DATE AS year_month, round(sum(amount_usd), 2) AS total
  FROM trx GROUP BY customer_id, month_offset HAVING round(sum(amount_usd), 2) > 600000)"""


@query("""
SELECT a.customer_id, a.year_month, a.total, t.txn_id, t.amount_usd, t.direction = 'debit' AS is_relevant
FROM acts a JOIN trx t ON t.customer_id = a.customer_id AND t.txn_ts >= a.year_month - INTERVAL 10 DAY
  AND t.txn_ts < a.year_month + INTERVAL 1 MONTH + INTERVAL 5 DAY""", trx=True, ctes=_LARGE_SQL)
def activity_trace(spark, sf):
    trx = transactions(spark, sf, [ENTITY, "txn_id", "txn_ts", "amount_usd", "direction"])
    out = relate.trace(_large_months(spark, sf), trx, ENTITY, "year_month", 10, 5, relevant=F.col("direction") == "debit", rows_per_task=20)
    return out.select(ENTITY, "year_month", "total", "txn_id", "amount_usd", "is_relevant")


_TRACED = {"cnt_trx_cash": "method LIKE 'cash%'", "one_to_many": "direction = 'debit'", "sum_trx_fop": "ip_hash = counterparty_ip AND t.customer_id <> cp_id", "global": "true"}


@query(f"""
SELECT a.customer_id, a.year_month, f.feature, t.txn_id
FROM acts a JOIN trx t ON t.customer_id = a.customer_id AND t.txn_ts >= a.year_month AND t.txn_ts < a.year_month + INTERVAL 1 MONTH
JOIN (SELECT unnest([{", ".join(repr(f) for f in _TRACED)}]) AS feature) f
  ON CASE f.feature {" ".join(f"WHEN '{f}' THEN {p}" for f, p in _TRACED.items())} END""", trx=True, ctes=_LARGE_SQL)
def feature_traces(spark, sf):
    trx = transactions(spark, sf, [ENTITY, "txn_id", "txn_ts", "method", "direction", "ip_hash", "counterparty_ip", "cp_id", PERIOD])
    relevant = {f: CATALOGUE[f].trace({}) for f in _TRACED if f != "global"} | {"global": None}
    out = relate.trace_features(_large_months(spark, sf), trx, ENTITY, "year_month", relevant)
    return out.select(ENTITY, "year_month", "feature", "txn_id")


@query("""
SELECT a.party, a.year_month, t.customer_id, t.txn_id FROM (SELECT DISTINCT customer_id % 7 AS party, year_month FROM acts) a
JOIN (SELECT s_suppkey AS customer_id, s_suppkey % 7 AS party FROM supplier) m USING (party)
JOIN trx t ON t.customer_id = m.customer_id AND t.txn_ts >= a.year_month - INTERVAL 1 MONTH AND t.txn_ts < a.year_month + INTERVAL 3 DAY""", trx=True, ctes=_LARGE_SQL)
def group_trace(spark, sf):
    acts = _large_months(spark, sf).select((F.col(ENTITY) % 7).alias("party"), "year_month").distinct()
    members = table(spark, sf, "supplier").select(F.col("s_suppkey").alias(ENTITY), (F.col("s_suppkey") % 7).alias("party"))
    trx = transactions(spark, sf, [ENTITY, "txn_id", "txn_ts"])
    out = relate.trace_group(acts, members, trx, "party", ENTITY, "year_month", after=3, months_before=1, months_after=0, rows_per_task=10)
    return out.select("party", "year_month", ENTITY, "txn_id")


@query("""
SELECT (SELECT count(*) FROM customer) AS left_rows, (SELECT count(*) FROM o) AS right_rows,
       (SELECT count(*) FROM customer FULL JOIN o ON c_custkey = o_custkey) AS joined_rows,
       (SELECT count(DISTINCT c_custkey) FROM customer) AS left_unique_keys, (SELECT count(DISTINCT o_custkey) FROM o) AS right_unique_keys,
       (SELECT count(DISTINCT coalesce(c_custkey, o_custkey)) FROM customer FULL JOIN o ON c_custkey = o_custkey) AS joined_unique_keys,
       lu AS left_unmatched, ru AS right_unmatched,
       round((1 - lu / (SELECT count(*) FROM customer)) * 100, 2) AS match_rate_left, round((1 - ru / (SELECT count(*) FROM o)) * 100, 2) AS match_rate_right
FROM (SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM o)) AS lu,
             (SELECT count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS ru)""", ctes="""
o AS (SELECT o_custkey + 5 AS o_custkey FROM orders WHERE o_totalprice > 300000)""")
def join_statistics(spark, sf):
    right = table(spark, sf, "orders").filter("o_totalprice > 300000").select((F.col("o_custkey") + 5).alias("k"))
    return relate.join_report(table(spark, sf, "customer"), right, "c_custkey", "k", "outer")


# --- sets, sorts ----------------------------------------------------------------------


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000),
     n AS (SELECT 'all_orders' AS l, 'large_orders' AS r, (SELECT count(*) FROM orders) AS lr, (SELECT count(*) FROM a) AS lk, (SELECT count(*) FROM a JOIN b USING (k)) AS o
           UNION ALL SELECT 'large_orders', 'all_orders', (SELECT count(*) FROM orders WHERE o_totalprice > 300000), (SELECT count(*) FROM b), (SELECT count(*) FROM a JOIN b USING (k)))
SELECT l AS left_table, r AS right_table, lr AS left_rows, lk AS left_keys, o AS overlap, lk - o AS missing, round(o / lk * 100, 2) AS coverage_pct,
       CASE WHEN lk = o THEN 'PASS' ELSE 'FAIL' END AS status FROM n""")
def key_set_coverage(spark, sf):
    orders = table(spark, sf, "orders")
    return relate.key_coverage({"all_orders": orders, "large_orders": orders.filter("o_totalprice > 300000")}, "o_custkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def orphan_keys(spark, sf):
    orders = table(spark, sf, "orders")
    return relate.orphans(orders, orders.filter("o_totalprice > 300000"), "o_custkey")


@query("""
SELECT id, name, NULL AS segment, 'supplier' AS side FROM (SELECT s_suppkey AS id, s_name AS name FROM supplier)
UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'customer' FROM customer""")
def union_by_name(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("side"))
    b = table(spark, sf, "customer").select(
        F.lit("customer").alias("side"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id")
    )
    return a.unionByName(b, allowMissingColumns=True)


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def drop_duplicate_keys(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderdate")
    return relate.one_per_key(df, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
SELECT customer_id, month_offset, n FROM (SELECT customer_id, month_offset, count(*) AS n FROM trx GROUP BY 1, 2)
ORDER BY n DESC, customer_id, month_offset LIMIT 50""", trx=True)
def busiest_entity_months(spark, sf):
    df = transactions(spark, sf, KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return df.orderBy(F.desc("n"), ENTITY, PERIOD).limit(50)
