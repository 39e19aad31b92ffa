"""Parquet tables, and the two sides of a reconciliation with known discrepancies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str) -> Column:
    """A double column as money. The cast comes before any arithmetic, which doubles would spoil."""
    return F.col(column).cast(MONEY)


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, account, kind, amount, event_ts) of every order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("account"), F.col("o_orderstatus").alias("kind"), money("o_totalprice").alias("amount"), F.col("o_orderdate").alias("event_ts")
    )


def left_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as kept: some are missing."""
    return order_records(spark, sf_dir).where("record_id % 97 <> 0")


def right_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for the same records, with entries missing, off in amount or date, and doubled."""
    orders = order_records(spark, sf_dir)
    k = F.col("record_id")
    edited = orders.where(k % 89 != 0).withColumns({
        "amount": (F.col("amount") + F.when(k % 41 == 0, F.lit("1.00")).when(k % 43 == 0, F.lit("0.01")).otherwise(F.lit("0.00")).cast(MONEY)).cast(MONEY),
        "event_ts": F.when(k % 53 == 0, F.col("event_ts") + F.expr("interval 2 days")).otherwise(F.col("event_ts")),
    })
    doubled = orders.where((k % 101 == 0) & (k % 89 != 0))
    return edited.unionByName(doubled)
