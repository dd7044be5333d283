"""The behavioural feature catalogue, keyed by entity and month."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.history import history, trailing, zscore
from tidewatch.operators.features import Feature, Measure, RollUp, carried, count, distinct, largest, roll_up, total
from tidewatch.operators.neighbours import with_neighbours

ENTITY, PERIOD = "customer_id", "month_offset"
KEYS = (ENTITY, PERIOD)

# Codes of the transaction model.
CREDIT, DEBIT = "credit", "debit"
DEPOSIT, WITHDRAWAL, WIRE_IN = "cash_deposit", "cash_withdrawal", "wire_in"
HIGH = "High"
# in/out ratio that counts as pass-through.
PIPE_LOW, PIPE_HIGH = 0.9, 1.1
# Fixed value: keeps ratios and deviations finite.
EPS = 1e-6

LOOK_BACK = "monthly_features_look_back_in_months"


def _amount() -> Column:
    return F.col("amount_usd")


def _is_credit() -> Column:
    return F.col("direction") == CREDIT


def _is_debit() -> Column:
    return F.col("direction") == DEBIT


def _is_cash() -> Column:
    return F.col("method").isin(DEPOSIT, WITHDRAWAL)


def _same_ip() -> Column:
    return (F.col("ip_hash") == F.col("counterparty_ip")) & (F.col(ENTITY) != F.col("cp_id"))


def _name_mismatch() -> Column:
    return F.col("counterparty_name") != F.col("declared_counterparty_name")


def _past(params) -> "Window":
    return history(ENTITY, PERIOD, int(params[LOOK_BACK]))


def _rounded(name: str, digits: int = 2) -> Callable:
    """Finish stage that rounds the feature's own sum in place."""
    return lambda p: {name: F.round(name, digits)}


def _f(fid: str, needs: str, outputs: str | None = None, **stages) -> Feature:
    return Feature(
        id=fid,
        outputs=tuple((outputs or fid).split()),
        requires=frozenset(needs.split()),
        keys=KEYS,
        **stages,
    )


# --- frames: features that need more than one grouping ------------------------


#: Features that are explained by their counterparties.
EXPLAINED = ("one_to_many", "many_to_one", "sum_trx_fop")


def _daily_measures() -> dict[str, Measure]:
    """What the daily frames need: transactions, money in and money out."""
    return {"n": count(), "i": total(_amount(), _is_credit()), "o": total(_amount(), _is_debit())}


def _daily(source: DataFrame | RollUp, *names: str) -> DataFrame:
    """Entity-day totals: a hot entity shrinks to one row per calendar day."""
    if isinstance(source, RollUp):
        return source.by_day().select(*KEYS, "day_offset", *names)
    measures = _daily_measures()
    return source.groupBy(ENTITY, PERIOD, "day_offset").agg(*[measures[n].whole().alias(n) for n in names])


def monthly_roll_up(trx: DataFrame, ids, params, heavy: DataFrame | None = None) -> RollUp:
    """The roll-up from which the features, their daily frames and their explanations are made."""
    views = dict(zip(EXPLAINED, (_is_debit(), _is_credit(), _same_ip())))
    return roll_up(trx, features(*ids), params, "day_offset", "cp_id", "amount_usd", _daily_measures(), views, heavy)


def busiest_days(df: DataFrame | RollUp, params) -> DataFrame:
    """Most transactions in any ``n_days`` calendar days that end in the month."""
    days = _daily(df, "n")
    frame = trailing(ENTITY, "day_offset", int(params["n_days"]))
    days = days.select(*KEYS, F.sum("n").over(frame).alias("n"))
    return days.groupBy(*KEYS).agg(F.max("n").alias("cnt_trx_n_day"))


def pass_through(df: DataFrame | RollUp, params, name: str) -> DataFrame:
    """Largest n-day turnover where money in and money out nearly balance.

    Totals run over the trailing days; a day qualifies when the in/out ratio is
    close to one, and the month takes the largest qualifying total, else 0.
    """
    days = _daily(df, "i", "o")
    frame = trailing(ENTITY, "day_offset", int(params["n_days"]))
    days = days.select(*KEYS, F.round(F.sum("i").over(frame), 2).alias("i"), F.round(F.sum("o").over(frame), 2).alias("o"))
    ratio = F.round(F.try_divide("i", "o"), 2)
    hit = F.when(ratio.between(PIPE_LOW, PIPE_HIGH), F.greatest("i", "o")).otherwise(0.0)
    return days.groupBy(*KEYS).agg(
        F.max(hit).alias(name),
        F.max("i").alias(f"{name}_in"),
        F.max("o").alias(f"{name}_out"),
    )


def structuring(df: DataFrame, params) -> DataFrame:
    """Transactions per month that form chains of similar small amounts.

    Rows are taken in amount order per entity (ties by day, then id). A row joins
    its predecessor when both are at most ``ndays`` apart and the amount differs
    by at most ``similar_amounts_thr`` percent; the first row of a chain counts
    too. A count of one becomes zero.
    """
    amount, day = F.col("amount_usd"), F.col("day_offset")
    low, high = float(params["min_trx_amount"]), float(params["max_trx_amount"])
    days, limit = int(params["ndays"]), float(params["similar_amounts_thr"])

    def small_step(a: Column, d: Column, a0: Column, d0: Column) -> Column:
        gap = F.try_divide(F.abs(a - a0), (a0 + a) / 2) * 100
        return F.when((F.abs(d - d0) <= days) & a.between(low, high) & (gap <= limit), gap)

    rows = with_neighbours(
        df.select(*KEYS, "amount_usd", "day_offset", "txn_id"),
        ENTITY, "amount_usd", ["day_offset", "txn_id"], ["amount_usd", "day_offset"],
    )
    prev, nxt = F.col("prev"), F.col("next")
    own = small_step(amount, day, prev["amount_usd"], prev["day_offset"])
    onward = small_step(nxt["amount_usd"], nxt["day_offset"], amount, day)
    hits = F.count(F.coalesce(own, onward))
    return rows.groupBy(*KEYS).agg(
        F.when(hits == 1, F.lit(0.0)).otherwise(hits.cast("double")).alias("many_small_trx")
    )


# --- stages that are longer than a line ---------------------------------------


def _pipe_finish(p) -> dict[str, Column]:
    i, o = F.round("sum_in_trx", 2), F.round("sum_out_trx", 2)
    ratio = F.round(F.try_divide(i, o), 2)
    hit = F.when(ratio.between(PIPE_LOW, PIPE_HIGH), F.greatest(i, o)).otherwise(0.0)
    return {"sum_in_trx": i, "sum_out_trx": o, "sum_in_out_ratio": ratio, "sum_pipe_customer": hit}


def _turnover_post(p) -> dict[str, Column]:
    past = history(ENTITY, PERIOD, 6)

    def deviation(c: Column) -> Column:
        mean, spread = F.avg(c).over(past), F.stddev_samp(c).over(past)
        z = (c - mean) / (F.coalesce(spread, F.lit(EPS)) + EPS)
        return F.when(mean.isNotNull(), z).otherwise(0.0)

    ratio = F.col("cashwd_usd") / (F.col("revenue_usd") + EPS)
    score = 0.6 * deviation(F.col("turnover_usd")) + 0.4 * deviation(ratio)
    return {"_raw_turnover_score": score, "abnormal_turnover_monthly": F.round(score, 4)}


def _ratio_to_previous(name: str, source: str) -> Callable:
    def post(p) -> dict[str, Column]:
        before = F.lag(source).over(Window.partitionBy(ENTITY).orderBy(PERIOD))
        return {
            f"{source}_prev": before,
            name: F.round(F.try_divide(F.col(source), before), int(p["round_digits"])),
        }

    return post


def _z_of(source: str) -> Callable:
    return lambda p: {f"z_score_{source}": zscore(source, _past(p))}


CATALOGUE: dict[str, Feature] = {
    f.id: f
    for f in [
        _f("cnt_trx", "", measures=lambda p: {"cnt_trx": count()}),
        _f("max_trx", "amount_usd", measures=lambda p: {"max_trx": largest(_amount())}),
        _f("customer_name", "customer_name", measures=lambda p: {"customer_name": carried(F.col("customer_name"))}),
        _f(
            "cnt_trx_cash", "method",
            measures=lambda p: {"cnt_trx_cash": total(F.lit(1), _is_cash())},
            trace=lambda p: _is_cash(),
        ),
        _f(
            "sum_trx_cash", "method amount_usd",
            measures=lambda p: {"sum_trx_cash": total(_amount(), _is_cash())},
            finish=_rounded("sum_trx_cash"),
            trace=lambda p: _is_cash(),
        ),
        _f(
            "sum_trx_cash_in", "method amount_usd",
            measures=lambda p: {"sum_trx_cash_in": total(_amount(), F.col("method") == DEPOSIT)},
            finish=_rounded("sum_trx_cash_in"),
            trace=lambda p: F.col("method") == DEPOSIT,
        ),
        _f(
            "sum_trx_cash_out", "method amount_usd",
            measures=lambda p: {"sum_trx_cash_out": total(_amount(), F.col("method") == WITHDRAWAL)},
            finish=_rounded("sum_trx_cash_out"),
            trace=lambda p: F.col("method") == WITHDRAWAL,
        ),
        _f(
            "one_to_many", "direction cp_id",
            measures=lambda p: {"one_to_many": distinct("cp_id", _is_debit())},
            trace=lambda p: _is_debit(),
        ),
        _f(
            "many_to_one", "direction cp_id",
            measures=lambda p: {"many_to_one": distinct("cp_id", _is_credit())},
            trace=lambda p: _is_credit(),
        ),
        _f(
            "sum_new_account", "is_new_account amount_usd",
            measures=lambda p: {"sum_new_account": total(F.when(F.col("is_new_account"), _amount()).otherwise(0.0))},
            finish=_rounded("sum_new_account"),
            trace=lambda p: F.col("is_new_account"),
        ),
        _f(
            "sum_trx_fop", "ip_hash counterparty_ip cp_id amount_usd", "sum_trx_fop cnt_trx_fop cnt_dstnct_fop",
            measures=lambda p: {
                "sum_trx_fop": total(_amount(), _same_ip()),
                "cnt_trx_fop": total(F.lit(1), _same_ip()),
                "cnt_dstnct_fop": distinct("cp_id", _same_ip()),
            },
            finish=_rounded("sum_trx_fop"),
            trace=lambda p: _same_ip(),
        ),
        _f(
            "sum_trx_name_mis", "counterparty_name declared_counterparty_name cp_id amount_usd",
            "sum_trx_name_mis cnt_dstnct_name_mis",
            measures=lambda p: {
                "sum_trx_name_mis": total(_amount(), _name_mismatch()),
                "cnt_dstnct_name_mis": distinct("cp_id", _name_mismatch()),
            },
            finish=_rounded("sum_trx_name_mis"),
            trace=lambda p: _name_mismatch(),
        ),
        _f(
            "cnt_trx_name_mis", "counterparty_name declared_counterparty_name",
            measures=lambda p: {"cnt_trx_name_mis": total(F.lit(1), _name_mismatch())},
            trace=lambda p: _name_mismatch(),
        ),
        _f(
            "sum_pipe_customer", "direction amount_usd",
            "sum_in_trx sum_out_trx sum_in_out_ratio sum_pipe_customer",
            measures=lambda p: {
                "sum_in_trx": total(_amount(), _is_credit()),
                "sum_out_trx": total(_amount(), _is_debit()),
            },
            finish=_pipe_finish,
        ),
        _f("cnt_trx_n_day", "day_offset", defaults={"n_days": 3}, frame=busiest_days, daily=True),
        _f(
            "sum_trx_n_day", "day_offset direction amount_usd", "sum_trx_n_day sum_trx_n_day_in sum_trx_n_day_out",
            defaults={"n_days": 3},
            frame=lambda df, p: pass_through(df, p, "sum_trx_n_day"), daily=True,
        ),
        _f(
            "sum_rapid_movement", "day_offset direction amount_usd",
            "sum_rapid_movement sum_rapid_movement_in sum_rapid_movement_out",
            defaults={"n_days": 3},
            frame=lambda df, p: pass_through(df, p, "sum_rapid_movement"), daily=True,
        ),
        _f(
            "z_score_cnt_trx", "", params=frozenset({LOOK_BACK}),
            measures=lambda p: {"cnt_trx": count()},
            post=_z_of("cnt_trx"),
        ),
        _f(
            "z_score_sum_trx", "amount_usd", "sum_trx z_score_sum_trx", params=frozenset({LOOK_BACK}),
            measures=lambda p: {"sum_trx": total(_amount())},
            finish=_rounded("sum_trx"),
            post=_z_of("sum_trx"),
        ),
        _f(
            "z_score_sum_hghrsk_cntry", "cp_country_risk_level amount_usd",
            "sum_hghrsk_cntry z_score_sum_hghrsk_cntry", params=frozenset({LOOK_BACK}),
            measures=lambda p: {
                "sum_hghrsk_cntry": total(F.when(F.col("cp_country_risk_level") == HIGH, _amount()).otherwise(0.0))
            },
            finish=_rounded("sum_hghrsk_cntry"),
            post=_z_of("sum_hghrsk_cntry"),
            trace=lambda p: F.col("cp_country_risk_level") == HIGH,
        ),
        _f(
            "cnt_ratio_prev", "", "cnt_trx_prev cnt_ratio_prev", defaults={"round_digits": 2},
            measures=lambda p: {"cnt_trx": count()},
            post=_ratio_to_previous("cnt_ratio_prev", "cnt_trx"),
        ),
        _f(
            "sum_ratio_prev", "amount_usd", "month_total_prev sum_ratio_prev", defaults={"round_digits": 2},
            measures=lambda p: {"month_total": total(_amount())},
            finish=_rounded("month_total"),
            post=_ratio_to_previous("sum_ratio_prev", "month_total"),
        ),
        _f(
            "abnormal_turnover_monthly", "method amount_usd",
            "turnover_usd cashwd_usd revenue_usd abnormal_turnover_monthly",
            measures=lambda p: {
                "turnover_usd": total(F.abs(_amount())),
                "cashwd_usd": total(F.when(F.col("method") == WITHDRAWAL, _amount()).otherwise(0.0)),
                "revenue_usd": total(F.when(F.col("method") == WIRE_IN, _amount()).otherwise(0.0)),
            },
            finish=lambda p: {c: F.round(c, 2) for c in ("turnover_usd", "cashwd_usd", "revenue_usd")},
            post=_turnover_post,
        ),
        _f(
            "many_small_trx", "amount_usd day_offset txn_id",
            params=frozenset({"min_trx_amount", "max_trx_amount", "ndays", "similar_amounts_thr"}),
            frame=structuring,
        ),
    ]
}

# The set that is on by default.
MONTHLY = [
    "one_to_many", "cnt_trx_cash", "sum_trx_cash", "cnt_trx_n_day", "z_score_cnt_trx",
    "many_to_one", "max_trx", "sum_pipe_customer", "z_score_sum_hghrsk_cntry", "sum_new_account",
    "sum_trx_fop", "sum_trx_name_mis", "cnt_trx_name_mis", "cnt_trx", "z_score_sum_trx",
    "sum_rapid_movement", "sum_trx_cash_in", "sum_trx_cash_out", "customer_name",
]


def features(*ids: str) -> list[Feature]:
    return [CATALOGUE[i] for i in ids]
