"""Filtered scans: what each report reads from the logical tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawledger.functions import columns as C
from pawledger.functions import periods as P
from pawledger.functions import rules

FACT_COLUMNS = (
    "invoice_id",
    "client_id",
    "patient_id",
    "patient_species",
    "plan_category_name",
)


def scan_invoices(invoices: DataFrame, start: date, end: date) -> DataFrame:
    """Active lines serviced in ``[start, end)`` with the dashboard's columns."""
    rows = P.period_rows(invoices, P.Period(start, end))
    return rows.select(
        *FACT_COLUMNS, C.to_number_or_zero("total").alias("total"), P.SERVICE_DATE
    )


def scan_stocks(
    stocks: DataFrame, phantom_patterns: Sequence[str] = rules.PHANTOM_STOCK_PATTERNS
) -> DataFrame:
    """Current stock without phantom entries; bad or negative numbers are zero."""
    name = F.lower(F.coalesce(F.col("stock_name"), F.lit("")))
    phantom = reduce(or_, [name.contains(p) for p in phantom_patterns], F.lit(False))
    quantity = C.nonneg(C.to_number_or_zero("onhand_qty", "decimal(18,3)"))
    return stocks.filter(~phantom).select(
        "stock_id",
        "stock_name",
        "plan_category_name",
        quantity.alias("onhand_qty"),
        C.to_number_or_zero("purchase_cost").alias("purchase_cost"),
    )


def scan_patients(patients: DataFrame) -> DataFrame:
    """Patients with a known birth date."""
    return patients.filter(F.col("birth_date").isNotNull()).select("patient_id", "birth_date")


def prior_clients(
    clients: DataFrame,
    invoices: DataFrame,
    before: date,
    phantom: str = rules.PHANTOM_CLIENT,
    among: DataFrame | None = None,
) -> DataFrame:
    """Ids of clients registered or served before a date.

    ``among`` holds the ids that are asked for; then the history meets them
    before it is made distinct.
    """
    registered = clients.filter(P.in_range("first_activity", end=before))
    served = P.period_rows(invoices, P.Period(None, before))
    ids = registered.select("client_id").union(served.select("client_id"))
    if among is not None:
        ids = ids.join(among.select("client_id").distinct(), "client_id", "left_semi")
    return P.exclude_phantom(ids, phantom=phantom).distinct()


def new_clients(
    clients: DataFrame, start: date, end: date, phantom: str = rules.PHANTOM_CLIENT
) -> DataFrame:
    """Ids of clients whose first activity lies in ``[start, end)``."""
    rows = clients.filter(P.in_range("first_activity", start, end))
    return P.exclude_phantom(rows, phantom=phantom).select("client_id").distinct()


def data_coverage(
    invoices: DataFrame, period: P.Period | None = None, date_col: str = P.SERVICE_DATE
) -> DataFrame:
    """First and last active date, and whether a wanted period has data."""
    first, last = F.min(date_col), F.max(date_col)
    measures = [first.alias("earliest_date"), last.alias("latest_date")]
    if period is not None:
        overlap = (last >= F.lit(period.start)) & (first < F.lit(period.end))
        measures.append(F.coalesce(overlap, F.lit(False)).alias("has_data"))
    return P.period_rows(invoices, date_col=date_col).agg(*measures)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(column).distinct()


def unavailable(spark: SparkSession, reason: str) -> DataFrame:
    """One message row in place of data that was never captured."""
    return spark.range(1).select(F.lit(f"Data not available: {reason}").alias("message"))


def payments_scan(payments: DataFrame, period: P.Period | None = None) -> DataFrame:
    return payments.filter(P.in_period("payment_date", period)) if period else payments
