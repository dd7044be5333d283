"""The monthly feature catalogue, one query per feature and the whole table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewatch.functions.history import history, zscore
from tidewatch.functions.periods import month_start
from tidewatch.operators.catalogue import CATALOGUE, ENTITY, EXPLAINED, LOOK_BACK, MONTHLY, PERIOD, features, monthly_roll_up
from tidewatch.operators.explain import concentration, packed, with_population
from tidewatch.operators.features import (
    FeatureError, aggregate_measures, check_features, count, heavy_entities, largest, max_look_back, run_feature, run_features, select_features,
)
from tidewatch.plans.registry import mean_sql, query
from tidewatch.session import cut_lineage
from tidewatch.sources.model import transactions

PARAMS = {
    LOOK_BACK: 6,
    "min_trx_amount": 20000.0,
    "max_trx_amount": 60000.0,
    "ndays": 60,
    "similar_amounts_thr": 1.0,
}


def feature_rows(spark, sf, *ids):
    """Runs catalogue features over just the columns they need."""
    chosen = features(*ids)
    need = {ENTITY, PERIOD}.union(*[f.requires for f in chosen])
    return run_features(transactions(spark, sf, sorted(need)), chosen, PARAMS)


_FEATURE_SQL: dict[str, str] = {}


def _register(fid: str, sql: str, ctes: str = "") -> None:
    _FEATURE_SQL[fid] = sql

    def run(spark, sf):
        return feature_rows(spark, sf, fid)

    run.__name__ = f"feature_{fid}"
    query(sql, trx=True, ctes=ctes)(run)


def _grouped(*cols: str) -> str:
    return f"SELECT customer_id, month_offset, {', '.join(cols)} FROM trx GROUP BY 1, 2"


_CASH = "method IN ('cash_deposit', 'cash_withdrawal')"
_FOP = "ip_hash = counterparty_ip AND customer_id <> cp_id"
_MIS = "counterparty_name <> declared_counterparty_name"

_SIMPLE = {
    "cnt_trx": ["count(*) AS cnt_trx"],
    "max_trx": ["max(amount_usd) AS max_trx"],
    "customer_name": ["max(customer_name) AS customer_name"],
    "cnt_trx_cash": [f"sum(CASE WHEN {_CASH} THEN 1 END)::BIGINT AS cnt_trx_cash"],
    "sum_trx_cash": [f"round(sum(CASE WHEN {_CASH} THEN amount_usd END), 2) AS sum_trx_cash"],
    "sum_trx_cash_in": ["round(sum(CASE WHEN method = 'cash_deposit' THEN amount_usd END), 2) AS sum_trx_cash_in"],
    "sum_trx_cash_out": ["round(sum(CASE WHEN method = 'cash_withdrawal' THEN amount_usd END), 2) AS sum_trx_cash_out"],
    "one_to_many": ["count(DISTINCT CASE WHEN direction = 'debit' THEN cp_id END) AS one_to_many"],
    "many_to_one": ["count(DISTINCT CASE WHEN direction = 'credit' THEN cp_id END) AS many_to_one"],
    "sum_new_account": ["round(sum(CASE WHEN is_new_account THEN amount_usd ELSE 0 END), 2) AS sum_new_account"],
    "sum_trx_fop": [
        f"round(sum(CASE WHEN {_FOP} THEN amount_usd END), 2) AS sum_trx_fop",
        f"sum(CASE WHEN {_FOP} THEN 1 END)::BIGINT AS cnt_trx_fop",
        f"count(DISTINCT CASE WHEN {_FOP} THEN cp_id END) AS cnt_dstnct_fop",
    ],
    "sum_trx_name_mis": [
        f"round(sum(CASE WHEN {_MIS} THEN amount_usd END), 2) AS sum_trx_name_mis",
        f"count(DISTINCT CASE WHEN {_MIS} THEN cp_id END) AS cnt_dstnct_name_mis",
    ],
    "cnt_trx_name_mis": [f"nullif(count(*) FILTER (WHERE {_MIS}), 0) AS cnt_trx_name_mis"],
}
for _fid, _cols in _SIMPLE.items():
    _register(_fid, _grouped(*_cols))

_register(
    "sum_pipe_customer",
    """
SELECT *, CASE WHEN sum_in_out_ratio BETWEEN 0.9 AND 1.1 THEN greatest(sum_in_trx, sum_out_trx) ELSE 0.0 END AS sum_pipe_customer
FROM (SELECT *, round(sum_in_trx / nullif(sum_out_trx, 0), 2) AS sum_in_out_ratio FROM (
  SELECT customer_id, month_offset, round(sum(CASE WHEN direction = 'credit' THEN amount_usd END), 2) AS sum_in_trx,
         round(sum(CASE WHEN direction = 'debit' THEN amount_usd END), 2) AS sum_out_trx FROM trx GROUP BY 1, 2))""",
)
_register(
    "cnt_trx_n_day",
    """
SELECT customer_id, month_offset, max(n) AS cnt_trx_n_day FROM (
  SELECT customer_id, month_offset, count(*) OVER (PARTITION BY customer_id ORDER BY day_offset RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM trx)
GROUP BY 1, 2""",
)


def _through(name: str) -> str:
    return f"""
SELECT customer_id, month_offset, max(CASE WHEN r BETWEEN 0.9 AND 1.1 THEN greatest(i, o) ELSE 0.0 END) AS {name},
       max(i) AS {name}_in, max(o) AS {name}_out
FROM (SELECT *, round(i / nullif(o, 0), 2) AS r FROM (
  SELECT customer_id, month_offset,
         round(sum(CASE WHEN direction = 'credit' THEN amount_usd END) OVER w, 2) AS i,
         round(sum(CASE WHEN direction = 'debit' THEN amount_usd END) OVER w, 2) AS o
  FROM trx WINDOW w AS (PARTITION BY customer_id ORDER BY day_offset RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)))
GROUP BY 1, 2"""


for _fid in ("sum_trx_n_day", "sum_rapid_movement"):
    _register(_fid, _through(_fid))


def z_sql(source: str, column: str, carry: str = "") -> str:
    """Deviation from the six months before, over a table expression."""
    return f"""
SELECT customer_id, month_offset, {carry} CASE WHEN z < 0 THEN 0.0 WHEN z > 5 THEN 5.0 ELSE z END AS z_score_{column}
FROM (SELECT *, round(({column} - a) / nullif(s, 0), 2) AS z FROM (
  SELECT *, round(avg({column}) OVER h, 2) AS a, round(stddev_samp({column}) OVER h, 2) AS s
  FROM ({source}) WINDOW h AS (PARTITION BY customer_id ORDER BY month_offset RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING)))"""


_register("z_score_cnt_trx", z_sql(_grouped("count(*) AS cnt_trx"), "cnt_trx"))
_register("z_score_sum_trx", z_sql(_grouped("round(sum(amount_usd), 2) AS sum_trx"), "sum_trx", "sum_trx,"))
_register(
    "z_score_sum_hghrsk_cntry",
    z_sql(
        _grouped("round(sum(CASE WHEN cp_country_risk_level = 'High' THEN amount_usd ELSE 0 END), 2) AS sum_hghrsk_cntry"),
        "sum_hghrsk_cntry", "sum_hghrsk_cntry,",
    ),
)
_register(
    "cnt_ratio_prev",
    """
SELECT customer_id, month_offset, p AS cnt_trx_prev, round(c / nullif(p, 0)::DOUBLE, 2) AS cnt_ratio_prev FROM (
  SELECT customer_id, month_offset, count(*) AS c, lag(count(*)) OVER (PARTITION BY customer_id ORDER BY month_offset) AS p
  FROM trx GROUP BY 1, 2)""",
)
_register(
    "sum_ratio_prev",
    """
SELECT customer_id, month_offset, p AS month_total_prev, round(c / nullif(p, 0), 2) AS sum_ratio_prev FROM (
  SELECT *, lag(c) OVER (PARTITION BY customer_id ORDER BY month_offset) AS p FROM (
    SELECT customer_id, month_offset, round(sum(amount_usd), 2) AS c FROM trx GROUP BY 1, 2))""",
)
@query("""
SELECT customer_id, month_offset, turnover_usd, cashwd_usd, revenue_usd,
       printf('%.8e', 0.6 * CASE WHEN tm IS NULL THEN 0 ELSE (turnover_usd - tm) / (coalesce(ts, 1e-6) + 1e-6) END
           + 0.4 * CASE WHEN rm IS NULL THEN 0 ELSE (r - rm) / (coalesce(rs, 1e-6) + 1e-6) END)::DOUBLE AS abnormal_turnover_monthly
FROM (SELECT *, avg(turnover_usd) OVER h AS tm, stddev_samp(turnover_usd) OVER h AS ts, avg(r) OVER h AS rm, stddev_samp(r) OVER h AS rs
  FROM (SELECT *, cashwd_usd / (revenue_usd + 1e-6) AS r FROM (
    SELECT customer_id, month_offset, round(sum(abs(amount_usd)), 2) AS turnover_usd,
           round(sum(CASE WHEN method = 'cash_withdrawal' THEN amount_usd ELSE 0 END), 2) AS cashwd_usd,
           round(sum(CASE WHEN method = 'wire_in' THEN amount_usd ELSE 0 END), 2) AS revenue_usd
    FROM trx GROUP BY 1, 2))
  WINDOW h AS (PARTITION BY customer_id ORDER BY month_offset RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING))""", trx=True)
def feature_abnormal_turnover_monthly(spark, sf):
    # a month without revenue has a ratio near 1e11, so scores are compared to nine digits
    out = run_features(transactions(spark, sf, [ENTITY, PERIOD, "method", "amount_usd"]), features("abnormal_turnover_monthly"), PARAMS, keep_inner=True)
    score = F.format_string("%.8e", F.col("_raw_turnover_score")).cast("double")
    return out.select(ENTITY, PERIOD, "turnover_usd", "cashwd_usd", "revenue_usd", score.alias("abnormal_turnover_monthly"))


_register(
    "many_small_trx",
    """
SELECT customer_id, month_offset, CASE WHEN n = 1 THEN 0.0 ELSE n::DOUBLE END AS many_small_trx FROM (
  SELECT customer_id, month_offset, count(coalesce(small, nxt)) AS n FROM (
    SELECT *, lead(small) OVER w AS nxt FROM (
      SELECT *, CASE WHEN abs(day_offset - d0) <= 60 AND amount_usd BETWEEN 20000 AND 60000
                      AND abs(amount_usd - a0) / nullif((a0 + amount_usd) / 2, 0) * 100 <= 1.0
                     THEN abs(amount_usd - a0) / nullif((a0 + amount_usd) / 2, 0) * 100 END AS small
      FROM (SELECT *, lag(amount_usd) OVER w AS a0, lag(day_offset) OVER w AS d0 FROM trx
            WINDOW w AS (PARTITION BY customer_id ORDER BY amount_usd, day_offset, txn_id)))
    WINDOW w AS (PARTITION BY customer_id ORDER BY amount_usd, day_offset, txn_id))
  GROUP BY 1, 2)""",
)


@query(z_sql(_grouped("round(sum(amount_usd), 2) AS sum_trx"), "sum_trx", "sum_trx,") + " ORDER BY 1, 2", trx=True)
def single_feature_run(spark, sf):
    f = CATALOGUE["z_score_sum_trx"]
    return run_feature(transactions(spark, sf, [ENTITY, PERIOD, "amount_usd"]), f, PARAMS)


@query("""
SELECT customer_id, month_offset, n, round((n - m) / nullif(s, 0), 2) AS z_median FROM (
  SELECT *, round(quantile_disc(n, 0.5) OVER h, 2) AS m, round(stddev_samp(n) OVER h, 2) AS s
  FROM (SELECT customer_id, month_offset, count(*) AS n FROM trx GROUP BY 1, 2)
  WINDOW h AS (PARTITION BY customer_id ORDER BY month_offset RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING))""", trx=True)
def deviation_from_median(spark, sf):
    df = aggregate_measures(transactions(spark, sf, [ENTITY, PERIOD]), [ENTITY, PERIOD], {"n": count()})
    return df.withColumn("z_median", zscore("n", history(ENTITY, PERIOD, 12), clip=None, method="median"))


@query("""
SELECT user_id, day_no, n, sum(n) OVER (PARTITION BY user_id ORDER BY day_no RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS n_7d
FROM (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS day_no, count(*) AS n FROM events GROUP BY 1, 2)""")
def trailing_week_events(spark, sf):
    from tidewatch.functions.history import trailing
    from tidewatch.functions.periods import day_offset
    from tidewatch.sources.model import table

    days = table(spark, sf, "events").groupBy("user_id", day_offset(F.col("ts")).alias("day_no")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("n_7d", F.sum("n").over(trailing("user_id", "day_no", 7)))


# --- choosing features -----------------------------------------------------------

# One feature with its own window, one of the core layer replaced by an extension, one switched off.
_SPEC = {
    "cnt_trx_n_day": {"v1": {"active": True, "train": True, "params": {"n_days": 5}}},
    "max_trx": {"v1": {"active": True, "train": False}},
    "sum_trx_cash": {"v1": {"active": False, "train": True}},
}


@query("""
SELECT customer_id, month_offset, max(n)::BIGINT AS cnt_trx_n_day, max(m) AS max_trx FROM (
  SELECT customer_id, month_offset, sum(n) OVER (PARTITION BY customer_id ORDER BY day_offset RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS n, m
  FROM (SELECT customer_id, month_offset, day_offset, count(*) AS n, max(-amount_usd) AS m FROM trx GROUP BY 1, 2, 3)) GROUP BY 1, 2""", trx=True)
def selected_features(spark, sf):
    ext = replace(CATALOGUE["max_trx"], layer="ext", measures=lambda p: {"max_trx": largest(-F.col("amount_usd"))})
    chosen = select_features([*CATALOGUE.values(), ext], _SPEC)
    return run_features(transactions(spark, sf, [ENTITY, PERIOD, "day_offset", "amount_usd"]), chosen, {"n_days": 2})


@query(_grouped("count(*) AS cnt_trx", "max(amount_usd) AS max_trx", *(c for f in ("cnt_trx_cash", "sum_trx_cash", "sum_trx_cash_in", "sum_trx_cash_out") for c in _SIMPLE[f])), trx=True)
def runnable_features(spark, sf):
    """The plain features that a table without counterparties can run."""
    trx = transactions(spark, sf, [ENTITY, PERIOD, "amount_usd", "method"])
    chosen = []
    for fid in _SIMPLE:
        try:
            check_features(trx, features(fid), {})
        except FeatureError:
            continue
        chosen += features(fid)
    return run_features(trx, chosen)


@query("""
SELECT customer_id, count(*) AS n, min(month_offset) AS first_month FROM trx WHERE month_offset > (SELECT max(month_offset) FROM trx) - 9 GROUP BY 1""", trx=True)
def longest_look_back(spark, sf):
    """The transactions that the feature with the longest look-back needs."""
    chosen = [CATALOGUE["z_score_cnt_trx"], replace(CATALOGUE["z_score_sum_trx"], defaults={LOOK_BACK: 9})]
    months = max_look_back(chosen, PARAMS, LOOK_BACK, horizon=84)
    trx = transactions(spark, sf, [ENTITY, PERIOD])
    last = trx.agg(F.max(PERIOD).alias("m")).first()["m"]
    return trx.filter(F.col(PERIOD) > last - months).groupBy(ENTITY).agg(F.count(F.lit(1)).alias("n"), F.min(PERIOD).alias("first_month"))


# --- the whole table -------------------------------------------------------------

POP_MEANS = {
    "pop_avg_sum_trx": "sum_trx", "pop_avg_cnt_trx": "cnt_trx", "pop_avg_sum_trx_cash": "sum_trx_cash",
    "pop_avg_cnt_trx_cash": "cnt_trx_cash", "pop_avg_cnt_trx_n_day": "cnt_trx_n_day", "pop_avg_new_account": "sum_new_account",
}
POP_HOLDERS = {
    "pop_dstnct_cust_trx": "cnt_trx", "pop_dstnct_cust_trx_cash": "cnt_trx_cash", "pop_dstnct_cust_new_account": "sum_new_account",
}


def monthly_table(trx, params=PARAMS, ids=MONTHLY, heavy=None, texts_from=None):
    """One row per entity and month: features, population, concentration, and the explanations of the
    counterparty features as JSON.

    The transactions are read once for the roll-up and once for the carried texts. Of an explanation
    with several pages (see ``packed``) the first is in the table; ``<feature>_explainability_pages``
    counts them, and ``explanation_pages`` gives them all. ``heavy``: the entities whose rows are dealt over
    several tasks, see ``heavy_entities``; ``texts_from``: see ``run_features``.
    """
    roll = monthly_roll_up(trx, ids, params, heavy)
    out = cut_lineage(run_features(trx, features(*ids), params, roll=roll, texts_from=texts_from))
    out = with_population(out, PERIOD, POP_MEANS, POP_HOLDERS)
    top = concentration(roll.explain("one_to_many"), [ENTITY, PERIOD], "cp_id").select(ENTITY, PERIOD, "cp_concentration", "cp_concentration_s")
    out = out.join(top, [ENTITY, PERIOD], "left").drop("sum_in_out_ratio")
    # the keys stay as they are, and with them the partitions that the next joins find
    out = out.na.fill(0, [c for c in out.columns if c not in (ENTITY, PERIOD)])
    for view in EXPLAINED:
        name = f"{view}_explainability"
        first = explanation_pages(roll, view).groupBy(ENTITY, PERIOD).agg(F.min_by(name, "part").alias(name), F.count(F.lit(1)).alias(f"{name}_pages"))
        out = out.join(first, [ENTITY, PERIOD], "left")
    return out.withColumn("year_month", month_start(F.col(PERIOD)))


def explanation_pages(roll, view):
    """The explanation of a feature in pages: count and sum by counterparty."""
    rows = roll.explain(view).withColumn("s", F.col("s").cast("decimal(18,2)"))
    return packed(rows, [ENTITY, PERIOD], {"cn": "cp_id", "c": "c", "s": "s"}, f"{view}_explainability")


def _filled(*cols: str) -> str:
    return ", ".join(f"coalesce({c}, 0) AS {c}" for c in cols)


_TABLE_COLUMNS = (
    "one_to_many cnt_trx_cash sum_trx_cash cnt_trx_n_day z_score_cnt_trx many_to_one max_trx sum_in_trx sum_out_trx sum_pipe_customer "
    "sum_hghrsk_cntry z_score_sum_hghrsk_cntry sum_new_account sum_trx_fop cnt_trx_fop cnt_dstnct_fop sum_trx_name_mis cnt_dstnct_name_mis "
    "cnt_trx_name_mis cnt_trx sum_trx z_score_sum_trx sum_rapid_movement sum_rapid_movement_in sum_rapid_movement_out sum_trx_cash_in sum_trx_cash_out"
).split()
_POP_SQL = ", ".join(
    [f"{mean_sql(f'CASE WHEN {c} > 0 THEN {c} END', 2)} AS {out}" for out, c in POP_MEANS.items()]
    + [f"count(CASE WHEN {c} > 0 THEN 1 END) AS {out}" for out, c in POP_HOLDERS.items()]
)


def _explained_sql(view: str, where: str) -> str:
    return f"""LEFT JOIN (SELECT customer_id, month_offset, '{{"data":[' || string_agg('{{"cn":' || cp_id || ',"c":' || c || ',"s":' || s || '}}', ',' ORDER BY cp_id) || ']}}' AS {view}_explainability,
    1::BIGINT AS {view}_explainability_pages FROM (SELECT customer_id, month_offset, cp_id, count(*) AS c, round(sum(amount_usd), 2)::DECIMAL(18,2) AS s
    FROM trx WHERE {where} AND cp_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (customer_id, month_offset)"""


_EXPLAINED_SQL = {"one_to_many": "direction = 'debit'", "many_to_one": "direction = 'credit'", "sum_trx_fop": _FOP}


# every feature by its own SQL, joined, with the population, the top counterparty and the explanations
@query(f"""
SELECT customer_id, month_offset, customer_name, {_filled(*_TABLE_COLUMNS, *POP_MEANS, *POP_HOLDERS, "cp_concentration", "cp_concentration_s")},
       (DATE '1970-01-01' + to_months(month_offset::INT))::DATE AS year_month,
       {", ".join(f"{v}_explainability, {v}_explainability_pages" for v in _EXPLAINED_SQL)}
FROM wide JOIN (SELECT month_offset, {_POP_SQL} FROM wide GROUP BY 1) USING (month_offset)
LEFT JOIN (SELECT customer_id, month_offset, max(s) AS cp_concentration_s, max(s) / nullif(round(sum(s), 2), 0) AS cp_concentration FROM (
             SELECT customer_id, month_offset, cp_id, round(sum(amount_usd), 2) AS s FROM trx WHERE direction = 'debit' GROUP BY 1, 2, 3) GROUP BY 1, 2)
  USING (customer_id, month_offset)
{" ".join(_explained_sql(v, w) for v, w in _EXPLAINED_SQL.items())}""", trx=True, ctes=",\n".join([
    *(f"f_{fid} AS ({_FEATURE_SQL[fid]})" for fid in MONTHLY),
    "wide AS (SELECT * FROM f_cnt_trx " + " ".join(f"JOIN f_{fid} USING (customer_id, month_offset)" for fid in MONTHLY if fid != "cnt_trx") + ")",
]))
def monthly_feature_table(spark, sf):
    heavy = heavy_entities(transactions(spark, sf, [ENTITY]), ENTITY)
    return monthly_table(transactions(spark, sf), heavy=heavy, texts_from=transactions(spark, sf, [ENTITY, PERIOD, "customer_name"]))
