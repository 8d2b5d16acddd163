"""Payments: returns and the mix of payment types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pawledger.functions import periods as P
from pawledger.operators.weekly import share_of_total
from pawledger.sources.scans import payments_scan


def returns_total(payments: DataFrame, period: P.Period | None = None) -> DataFrame:
    """Amount paid back; one row."""
    rows = payments_scan(payments, period).filter(F.col("is_return") == 1)
    return rows.agg(
        F.coalesce(F.sum("payment_amount").cast("double"), F.lit(0.0)).alias("returns_total"),
        F.count(F.lit(1)).alias("return_count"),
    )


def payment_mix(payments: DataFrame, period: P.Period | None = None) -> DataFrame:
    """Amount, count and share per payment type."""
    mix = payments_scan(payments, period).groupBy("payment_type_name").agg(
        F.sum("payment_amount").alias("amount"),
        F.count(F.lit(1)).alias("payment_count"),
    )
    share = share_of_total("amount").alias("pct_of_total")
    amount = F.col("amount").cast("double").alias("amount")
    return mix.select("payment_type_name", amount, "payment_count", share).orderBy(
        F.desc("amount"), "payment_type_name"
    )
