"""Maps the star-schema tables onto the transaction model.

Suppliers play the monitored entity, order customers the counterparty and line
items the transactions. Only the joins that the requested columns need are made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions import periods

ENTITY = "customer_id"
PERIOD = "month_offset"

_ORDERS = {"cp_id", "is_new_account", "order_priority"}
_PARTY = {"counterparty_name", "cp_jurisdiction", "cp_country_risk_level", "counterparty_ip", "declared_counterparty_name"}
_ENTITY = {"customer_name", "ip_hash"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns() -> dict[str, Column]:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    credit = status == "F"
    return {
        "txn_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "txn_ts": F.col("l_shipdate"),
        "customer_id": F.col("l_suppkey"),
        "customer_name": F.col("s_name"),
        "cp_id": F.col("o_custkey"),
        "counterparty_name": F.col("c_name"),
        "declared_counterparty_name": F.when(F.col("l_discount") < 0.08, F.col("c_name")).otherwise(
            F.concat(F.col("c_name"), F.lit("_X"))
        ),
        "amount_usd": F.col("l_extendedprice"),
        "direction": F.when(credit, "credit").otherwise("debit"),
        "method": F.when(flag == "A", F.when(credit, "cash_deposit").otherwise("cash_withdrawal"))
        .when(flag == "N", F.when(credit, "wire_in").otherwise("wire_out"))
        .otherwise(F.when(credit, "internal_transfer").otherwise("p2p")),
        "cp_jurisdiction": F.col("n_name"),
        "cp_country_risk_level": F.when(F.col("n_regionkey") == 0, "High")
        .when(F.col("n_regionkey") == 1, "Medium")
        .otherwise("Low"),
        "ip_hash": F.col("s_nationkey"),
        "counterparty_ip": F.col("c_nationkey"),
        "order_priority": F.col("o_orderpriority"),
        "is_new_account": F.col("o_orderpriority") == "1-URGENT",
        "month_offset": periods.month_offset(F.col("l_shipdate")),
        "day_offset": periods.day_offset(F.col("l_shipdate")),
    }


def transactions(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Enriched transactions with just the asked-for columns.

    A line without an order or party keeps its row, so the rows do not depend on the columns.
    """
    exprs = _columns()
    wanted = list(columns or exprs)
    df = table(spark, sf_dir, "lineitem")
    need = set(wanted)
    if need & (_ORDERS | _PARTY):
        orders = table(spark, sf_dir, "orders")
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if need & _PARTY:
        customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
        df = df.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        df = df.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if need & _ENTITY:
        df = df.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return df.select(*[exprs[c].alias(c) for c in wanted])


# The same mapping for the SQL oracle.
TRX_SQL = """
trx AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS txn_id,
         l_shipdate AS txn_ts, l_suppkey AS customer_id, s_name AS customer_name,
         o_custkey AS cp_id, c_name AS counterparty_name,
         CASE WHEN l_discount < 0.08 THEN c_name ELSE c_name || '_X' END AS declared_counterparty_name,
         l_extendedprice AS amount_usd,
         CASE WHEN l_linestatus = 'F' THEN 'credit' ELSE 'debit' END AS direction,
         CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'cash_deposit'
              WHEN l_returnflag = 'A' THEN 'cash_withdrawal'
              WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'wire_in'
              WHEN l_returnflag = 'N' THEN 'wire_out'
              WHEN l_linestatus = 'F' THEN 'internal_transfer' ELSE 'p2p' END AS method,
         n_name AS cp_jurisdiction,
         CASE n_regionkey WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS cp_country_risk_level,
         s_nationkey AS ip_hash, c_nationkey AS counterparty_ip,
         o_orderpriority AS order_priority, o_orderpriority = '1-URGENT' AS is_new_account,
         ((year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1)::BIGINT AS month_offset,
         date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT AS day_offset
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""
