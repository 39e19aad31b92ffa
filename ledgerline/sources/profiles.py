"""Synthetic subscription and redemption profiles, generated from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.tables import MONEY

KINDS = ("subscription", "redemption")


def _draw(seed: int, what: str, below: int) -> Column:
    """A whole number from 0 to below - 1, by the row's id, the seed and what it is for."""
    text = F.concat(F.lit(f"{seed}:{what}:"), F.col("id").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % below


def synthetic_profile(spark: SparkSession, rows: int, seed: int = 7, accounts: int = 50) -> DataFrame:
    """(record_id, kind, account, asset, amount, event_ts): the same rows for the same seed on any cluster."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return spark.range(rows).select(
        F.col("id").alias("record_id"),
        F.when(_draw(seed, "kind", 10) < 6, KINDS[0]).otherwise(KINDS[1]).alias("kind"),
        F.concat(F.lit("ACC-"), F.lpad(_draw(seed, "account", accounts).cast("string"), 4, "0")).alias("account"),
        F.concat(F.lit("FUND-"), _draw(seed, "asset", 5).cast("string")).alias("asset"),
        ((_draw(seed, "amount", 1_000_000) + 100).cast("decimal(18,0)") / 100).cast(MONEY).alias("amount"),
        (start + F.make_dt_interval(_draw(seed, "day", 365).cast("int"), F.lit(0), F.lit(0), _draw(seed, "second", 86_400).cast("decimal(18,6)"))).alias("event_ts"),
    )
