"""New, returning and repeat customers.

Lines are always reduced to one row per client (and report key) before they
meet another client-keyed table, so a client with very many lines costs no
more there than any other.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pawledger.functions import columns as C
from pawledger.functions import periods as P
from pawledger.functions.rules import PHANTOM_CLIENT
from pawledger.operators import trends
from pawledger.sources.scans import new_clients

LAST_BUCKET = 5


def _registered(clients: DataFrame, phantom: str) -> DataFrame:
    rows = clients.filter(F.col("first_activity").isNotNull())
    return P.exclude_phantom(rows, phantom=phantom).select("client_id", "first_activity")


def weekly_new_customers(
    clients: DataFrame, as_of: date, n: int = 12, phantom: str = PHANTOM_CLIENT
) -> DataFrame:
    """New clients per week of first activity, with growth."""
    measures = [F.countDistinct("client_id").alias("new_customers")]
    trend = trends.weekly_trend(
        _registered(clients, phantom), {}, measures, "new_customers", as_of, n, "first_activity"
    )
    return trend.orderBy("sort_key")


def monthly_new_customers(clients: DataFrame, phantom: str = PHANTOM_CLIENT) -> DataFrame:
    """New clients per month of first activity."""
    measures = [F.countDistinct("client_id").alias("new_customers")]
    series = trends.monthly_series(_registered(clients, phantom), {}, measures, "first_activity")
    return series.orderBy("sort_key")


def new_vs_returning_count(
    invoices: DataFrame,
    clients: DataFrame,
    year: int,
    month: int,
    phantom: str = PHANTOM_CLIENT,
) -> DataFrame:
    """Clients of a month by whether they first came in it.

    Clients without a registration row are left out, as in the source report.
    """
    period = P.month(year, month)
    rows = P.exclude_phantom(P.period_rows(invoices, period), phantom=phantom)
    joined = rows.select("client_id").distinct().join(_registered(clients, phantom), "client_id")
    is_new = P.in_period("first_activity", period)
    kind = F.when(is_new, "New").otherwise("Returning").alias("customer_type")
    return joined.groupBy(kind).agg(F.countDistinct("client_id").alias("client_count"))


def new_vs_existing_revenue_month(
    invoices: DataFrame,
    clients: DataFrame,
    year: int,
    month: int,
    phantom: str = PHANTOM_CLIENT,
) -> DataFrame:
    """Revenue of a month's new clients; the rest counts as existing. One row."""
    period = P.month(year, month)
    rows = P.exclude_phantom(P.period_rows(invoices, period), phantom=phantom)
    spent = rows.groupBy("client_id").agg(F.sum("total").alias("total"))
    flag = new_clients(clients, *period, phantom).withColumn("is_new", F.lit(True))
    flagged = spent.join(flag, "client_id", "left")
    zero = F.lit(0).cast("decimal(28,2)")
    new = F.coalesce(F.sum(F.when(F.col("is_new"), F.col("total"))), zero)
    total = F.coalesce(F.sum("total"), zero)
    return flagged.agg(
        new.cast("double").alias("new_customer_revenue"),
        (total - new).cast("double").alias("existing_customer_revenue"),
        total.cast("double").alias("total_revenue"),
    )


def new_vs_existing_first_day(
    invoices: DataFrame, phantom: str = PHANTOM_CLIENT
) -> DataFrame:
    """Revenue per month split into each client's first invoice day and later.

    The first day is taken over all active lines, also those without a service
    date. Lines are added up per client, month and day first; the window then
    holds one row per client and day.
    """
    rows = P.exclude_phantom(P.active(invoices), phantom=phantom)
    daily = rows.groupBy(
        "client_id",
        C.month_start(P.SERVICE_DATE).alias("month"),
        F.to_date(P.BILLING_DATE).alias("invoice_day"),
    ).agg(F.sum("total").alias("total"))
    first_day = F.min("invoice_day").over(W.partitionBy("client_id"))
    marked = daily.withColumn("first_day", first_day).filter(F.col("month").isNotNull())
    on_first = F.col("invoice_day") == F.col("first_day")

    def part(condition):
        total = F.sum(F.when(condition, F.col("total")))
        return F.coalesce(total.cast("double"), F.lit(0.0))

    split = marked.groupBy("month").agg(
        part(on_first).alias("new_revenue"), part(~on_first).alias("existing_revenue")
    )
    return split.select(
        C.month_key("month").alias("sort_key"),
        C.month_label("month").alias("month_label"),
        "new_revenue",
        "existing_revenue",
    ).orderBy("sort_key")


def _client_species(invoices: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct species of the given clients; the lines meet the ids first."""
    lines = P.active(invoices).join(ids.select("client_id"), "client_id", "left_semi")
    return lines.select("client_id", F.col("patient_species").alias("species")).distinct()


def new_customer_species_mix(
    invoices: DataFrame, clients: DataFrame, period: P.Period, phantom: str = PHANTOM_CLIENT
) -> DataFrame:
    """New clients per species they ever came with, and the share of each.

    Shares are of the sum over species, where a client with two species counts
    twice.
    """
    pairs = _client_species(invoices, new_clients(clients, *period, phantom))
    counts = pairs.groupBy("species").agg(F.count(F.lit(1)).alias("new_customers"))
    total = F.sum("new_customers").over(W.partitionBy())
    share = F.round(100.0 * F.col("new_customers") / total, 1)
    return counts.withColumn("pct_of_new_customers", share).orderBy(
        F.desc("new_customers"), "species"
    )


def new_customer_species_trend(
    invoices: DataFrame,
    clients: DataFrame,
    as_of: date,
    n: int = 6,
    complete_start: bool = False,
    phantom: str = PHANTOM_CLIENT,
) -> DataFrame:
    """New clients per month of first activity and species."""
    period = P.recent_months(as_of, n, complete_start, complete_end=True)
    recent = _registered(clients, phantom).filter(P.in_period("first_activity", period))
    joined = _client_species(invoices, recent).join(recent, "client_id")
    measures = [F.countDistinct("client_id").alias("new_customers")]
    series = trends.monthly_series(joined, {"species": "species"}, measures, "first_activity")
    return series.orderBy("sort_key", F.desc("new_customers"), "species")


# --- visits ----------------------------------------------------------------


def visit_frequency(
    invoices: DataFrame, last: int = LAST_BUCKET, phantom: str = PHANTOM_CLIENT
) -> DataFrame:
    """Clients by their lifetime number of visits, cancelled ones included."""
    visits = P.exclude_phantom(invoices, phantom=phantom).select("client_id", "invoice_id").distinct()
    per_client = visits.groupBy("client_id").agg(F.count("invoice_id").alias("visit_count"))
    count = F.col("visit_count")
    bucket = (
        F.when(count == 1, "1 Visit")
        .when((count > 1) & (count < last), F.concat(count.cast("string"), F.lit(" Visits")))
        .otherwise(f"{last}+ Visits")
    )
    report = per_client.groupBy(bucket.alias("frequency_bucket")).agg(
        F.count(F.lit(1)).alias("customer_count"), F.min(count).alias("sort_key")
    )
    return report.orderBy("sort_key")


def _visits(invoices: DataFrame, phantom: str) -> DataFrame:
    """One row per client and invoice with its first service time."""
    rows = P.exclude_phantom(P.period_rows(invoices), phantom=phantom)
    return rows.groupBy("client_id", "invoice_id").agg(F.min(P.SERVICE_DATE).alias("visit_date"))


def visit_ranked(
    invoices: DataFrame, max_visits: int, phantom: str = PHANTOM_CLIENT
) -> DataFrame:
    """Each client's first visits, numbered in time; ties by invoice id.

    The bound on the rank lets Spark cut every client to its first rows before
    the shuffle, so a client with very many visits is no burden.
    """
    order = W.partitionBy("client_id").orderBy("visit_date", "invoice_id")
    ranked = _visits(invoices, phantom).withColumn("visit_num", F.row_number().over(order))
    return ranked.filter(F.col("visit_num") <= max_visits)


def visit_sequence(
    invoices: DataFrame, max_visits: int = 10, phantom: str = PHANTOM_CLIENT
) -> DataFrame:
    """Clients that reached each visit number.

    A client reaches visit k if it has at least k visits, so counting visits
    per client is enough and nothing has to be sorted.
    """
    rows = P.exclude_phantom(P.period_rows(invoices), phantom=phantom)
    per_client = (
        rows.select("client_id", "invoice_id")
        .distinct()
        .groupBy("client_id")
        .agg(F.count(F.lit(1)).alias("visits"))
    )
    reached = F.least(F.col("visits"), F.lit(max_visits)).alias("reached")
    histogram = per_client.groupBy(reached).agg(F.count(F.lit(1)).alias("clients"))
    steps = histogram.select(
        F.explode(F.sequence(F.lit(1), F.col("reached").cast("int"))).alias("visit_num"), "clients"
    )
    return steps.groupBy("visit_num").agg(F.sum("clients").alias("client_count")).orderBy("visit_num")


def returned_in_month(
    invoices: DataFrame, k: int, year: int, month: int, phantom: str = PHANTOM_CLIENT
) -> DataFrame:
    """Clients whose k-th visit lies in a month; one row."""
    ranked = visit_ranked(invoices, k, phantom).filter(F.col("visit_num") == k)
    hit = ranked.filter(P.in_period("visit_date", P.month(year, month)))
    return hit.agg(F.countDistinct("client_id").alias("returned_clients"))
