"""Node and edge tables of the investigation graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators.relate import new_only


def account_nodes(trx: DataFrame) -> DataFrame:
    """One node per id seen on either side, with its earliest known attributes."""
    own = trx.select(
        F.col("customer_id").alias("id"), F.col("customer_name").alias("NM"),
        F.col("cp_jurisdiction").alias("CT"), F.col("txn_ts").alias("ts"),
    )
    other = trx.select(
        F.col("cp_id").alias("id"), F.col("counterparty_name").alias("NM"),
        F.col("cp_jurisdiction").alias("CT"), F.col("txn_ts").alias("ts"),
    )
    # one row per distinct attributes first: a hash aggregate that shrinks hot ids
    rows = (
        own.unionByName(other).filter(F.col("id").isNotNull())
        .groupBy("id", "NM", "CT").agg(F.min("ts").alias("ts"))
    )

    def earliest(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.struct("ts", name))).alias(name)

    return rows.groupBy("id").agg(
        earliest("NM"), earliest("CT"), F.min("ts").alias("effective_date")
    ).withColumn("AN", F.col("id"))


def txn_edges(trx: DataFrame, txn_id: str = "txn_id", currency: Column | None = None) -> DataFrame:
    """Money flows: debits leave the entity, credits reach it."""
    debit = F.col("direction") == "debit"
    own, other = F.col("customer_id"), F.col("cp_id")
    rows = trx.filter(F.col(txn_id).isNotNull() & own.isNotNull() & other.isNotNull())
    return rows.select(
        F.col(txn_id).cast("string").alias("id"),
        F.col("txn_ts").alias("effective_date"),
        F.when(debit, own).otherwise(other).alias("source_node"),
        F.when(debit, other).otherwise(own).alias("target_node"),
        F.col("amount_usd").alias("AM"),
        (F.lit("USD") if currency is None else currency).alias("CR"),
        F.lit(1).cast("long").alias("CT"),
    )


def alerted_activities(evaluated: DataFrame, alerted: DataFrame, entity: str, date: str) -> DataFrame:
    """Evaluated activities that raised an alert, one row per risk."""
    return evaluated.join(alerted.select("tr_id", "risk_id", "is_suppressed"), "tr_id").select(
        "tr_id", "risk_id", F.col(date), "is_suppressed", F.col(entity)
    )


def alert_graph(alerted: DataFrame, evaluated: DataFrame, entity: str, date: str) -> tuple[DataFrame, DataFrame]:
    """Alert nodes, and edges from each alert to its entity."""
    rows = alerted_activities(evaluated, alerted, entity, date).withColumn(
        "id", F.concat_ws("_", "tr_id", "risk_id")
    )
    nodes = rows.select(
        "id", F.col("tr_id").alias("AI"), F.col("risk_id").alias("RI"),
        F.col("is_suppressed").alias("SP"), F.col(date).alias("effective_date"),
    )
    edges = rows.select(
        "id", F.col("id").alias("source_node"), F.col(entity).alias("target_node"), F.col(date).alias("effective_date")
    )
    return nodes, edges
