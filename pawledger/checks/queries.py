"""The registered queries: one per report, over whole test tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import date, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawledger.checks import adapters as A
from pawledger.functions import columns as C
from pawledger.functions import periods as P
from pawledger.functions import present
from pawledger.operators import (
    audit,
    customers,
    history,
    inventory,
    lifestage,
    payments,
    trends,
    weekly,
)
from pawledger.plans import cube, dashboard, export
from pawledger.session import CHECKPOINT_DIR, ensure_checkpoint_dir
from pawledger.sources import scans, sinks, tables, views

Query = Callable[[SparkSession, str], DataFrame]

# The dashboard's week, and one that begins before the data ends.
WEEK = (date(2024, 1, 22), date(2024, 1, 28))
LAST_WEEK = (date(2024, 1, 29), date(2024, 2, 4))
# A Wednesday in the middle of the data, a month near its end, and other periods.
AS_OF = date(2000, 5, 17)
YEAR, MONTH = 2001, 7
JULY = P.month(YEAR, MONTH)
JUNE = P.month(2001, 6)
QUARTER = P.quarter(2001, 2)
# A month whose new clients also have invoices, and one with many second visits.
NEW_MONTH = (2000, 5)
RETURN_MONTH = (1996, 3)
PHANTOM_STOCK = ("cold",)
COVERAGE_MIN_DAYS = 100

_REGISTRY: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def _own_checkpoint_dir(spark: SparkSession) -> None:
    """A scratch folder, only for sessions that were given none."""
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not named:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def _new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own beside the checkpoints, where all executors can read."""
    _own_checkpoint_dir(spark)
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    """List and date columns as text, which every engine prints alike."""

    def text(c: str):
        if df.schema[c].dataType.typeName() == "array":
            return F.array_join(c, " | ")
        if df.schema[c].dataType.typeName() == "date":
            return F.date_format(c, "yyyy-MM-dd")
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

    return df.withColumns({c: text(c) for c in columns})


def _fact(spark: SparkSession, d: str, week=WEEK) -> DataFrame:
    return dashboard.week_fact(A.visits(spark, d), *week)


def _new_ids(spark: SparkSession, d: str) -> DataFrame:
    return scans.new_clients(A.visit_clients(spark, d), *P.inclusive(*WEEK))


def _prior_ids(spark: SparkSession, d: str) -> DataFrame:
    return scans.prior_clients(A.visit_clients(spark, d), A.visits(spark, d), WEEK[0])


def _dashboard(spark: SparkSession, d: str, only: tuple[str, ...]) -> dict[str, DataFrame]:
    return dashboard.weekly_dashboard(
        A.visits(spark, d),
        A.visit_clients(spark, d),
        A.visit_patients(spark, d),
        A.stocks(spark, d),
        *WEEK,
        phantom_patterns=PHANTOM_STOCK,
        only=only,
    )


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All tables of the dashboard with totals; only the one that is used runs."""
    names = (*dashboard.TIDY_METRICS, "new_vs_existing_customers", "repeat_customers")
    return dashboard.table_totals(_dashboard(spark, d, names))


def _staged(spark: SparkSession, d: str) -> DataFrame:
    return views.invoice_life_stage(A.invoices(spark, d), A.patients(spark, d))


# --- weekly dashboard ------------------------------------------------------


@_query
def total_sales(spark, d):
    return _texts(weekly.total_sales(_fact(spark, d), *WEEK), "warnings")


@_query
def total_sales_partial_week(spark, d):
    return _texts(weekly.total_sales(_fact(spark, d, LAST_WEEK), *LAST_WEEK), "warnings")


@_query
def repeat_customers(spark, d):
    report = weekly.repeat_customers(_fact(spark, d), _prior_ids(spark, d), *WEEK)
    return _texts(report, "warnings")


@_query
def species_sales(spark, d):
    return weekly.species_sales(_fact(spark, d), *WEEK)


@_query
def category_top5(spark, d):
    return weekly.category_top_n(_fact(spark, d), *WEEK, top_n=5)


@_query
def invoice_count_by_species(spark, d):
    return weekly.invoice_count_by_species(_fact(spark, d), *WEEK)


@_query
def day_night_split(spark, d):
    return weekly.day_night_split(_fact(spark, d), *WEEK)


@_query
def prior_clients(spark, d):
    return _prior_ids(spark, d)


@_query
def new_clients(spark, d):
    return _new_ids(spark, d)


@_query
def new_vs_existing_customers(spark, d):
    return weekly.new_vs_existing_customers(_fact(spark, d), _new_ids(spark, d), *WEEK)


@_query
def new_vs_existing_revenue_week(spark, d):
    report = weekly.new_vs_existing_revenue(_fact(spark, d), _new_ids(spark, d), *WEEK)
    return _texts(report, "warnings")


@_query
def life_stage_metrics(spark, d):
    births = scans.scan_patients(A.visit_patients(spark, d))
    return weekly.life_stage_metrics(_fact(spark, d), births, *WEEK)


@_query
def tidy_dashboard(spark, d):
    return dashboard.tidy_week(
        A.visits(spark, d),
        A.visit_clients(spark, d),
        A.visit_patients(spark, d),
        A.stocks(spark, d),
        *WEEK,
        phantom_patterns=PHANTOM_STOCK,
    )


@_query
def kpi_headline(spark, d):
    return dashboard.kpi_headline(_dashboard(spark, d, dashboard.HEADLINE_METRICS))


@_query
def week_export(spark, d):
    """All ten metrics from one reading of the weeks, which is stored added up."""
    metrics = dashboard.weekly_dashboard(
        A.visits(spark, d),
        A.visit_clients(spark, d),
        A.visit_patients(spark, d),
        A.stocks(spark, d),
        *WEEK,
        phantom_patterns=PHANTOM_STOCK,
        folder=_new_folder(spark, "week"),
    )
    return export.week_export(metrics)


@_query
def week_cube(spark, d):
    """Lines, invoices, clients and sums of each part and day of the stored cube."""
    stored = cube.write_cube(_fact(spark, d), _new_folder(spark, "week"), *WEEK)
    return stored.groupBy("part", F.date_format(P.SERVICE_DATE, "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.countDistinct("invoice_id").alias("invoices"),
        F.countDistinct("client_id").alias("clients"),
        F.sum("total").cast("double").alias("total"),
    )


@_query
def species_sales_with_total(spark, d):
    report = weekly.species_sales(_fact(spark, d), *WEEK)
    table = dashboard.subtotal(
        report,
        ["species"],
        ["this_week_revenue"],
        fixed={"pct_contribution": F.lit(100.0)},
    )
    return present.non_zero_rows(table, "this_week_revenue").drop("prior_3wk_avg")


@_query
def category_top5_with_total(spark, d):
    return _tables(spark, d)["category_top"].drop("prior_3wk_avg")


@_query
def bills_with_total(spark, d):
    return _tables(spark, d)["invoice_count_by_species"].drop("prior_3wk_avg")


@_query
def day_night_with_total(spark, d):
    return _tables(spark, d)["day_night_split"].drop("prior_3wk_avg")


@_query
def life_stage_with_total(spark, d):
    return _tables(spark, d)["life_stage_metrics"]


@_query
def inventory_with_total(spark, d):
    return _tables(spark, d)["inventory_value"]


@_query
def revenue_by_segment_with_total(spark, d):
    return _tables(spark, d)["new_vs_existing_revenue"]


@_query
def customers_with_total(spark, d):
    return _tables(spark, d)["new_vs_existing_customers"]


# --- inventory -------------------------------------------------------------


@_query
def inventory_value(spark, d):
    return inventory.inventory_value(scans.scan_stocks(A.stocks(spark, d), PHANTOM_STOCK))


@_query
def closing_stock_by_group(spark, d):
    return inventory.closing_stock_by_group(A.stocks(spark, d))


@_query
def stock_by_company(spark, d):
    return inventory.stock_by_company(A.stocks(spark, d))


@_query
def stock_by_clinic(spark, d):
    return inventory.stock_by_clinic(A.stocks(spark, d))


@_query
def stock_value(spark, d):
    return inventory.stock_value(A.stocks(spark, d))


@_query
def stock_listing(spark, d):
    columns = ["plan_item_id", "plan_item_name", "plan_category_name", "clinic_id"]
    numbers = [F.col(c).cast("double").alias(c) for c in ("onhand_qty", "purchase_cost")]
    listing = A.stocks(spark, d).select(*columns, *numbers)
    return present.null_to_zero(present.business_aliases(listing))


@_query
def category_stock_coverage(spark, d):
    return inventory.category_stock_coverage(
        A.stocks(spark, d), A.invoices(spark, d), YEAR, MONTH, min_days=COVERAGE_MIN_DAYS
    )


@_query
def sku_days_cover(spark, d):
    return inventory.sku_days_cover(A.stocks(spark, d), A.invoices(spark, d), AS_OF)


@_query
def excess_stock(spark, d):
    return inventory.excess_stock(A.stocks(spark, d), A.invoices(spark, d), AS_OF)


@_query
def top_skus(spark, d):
    return inventory.top_skus(A.invoices(spark, d, item_names=True), AS_OF)


@_query
def sku_pareto(spark, d):
    _own_checkpoint_dir(spark)
    return inventory.sku_pareto(A.invoices(spark, d, item_names=True), AS_OF)


@_query
def sku_trend(spark, d):
    return inventory.sku_trend(A.invoices(spark, d, item_names=True), AS_OF)


# --- single figures --------------------------------------------------------


@_query
def data_coverage(spark, d):
    report = scans.data_coverage(A.invoices(spark, d), P.day(date(2001, 8, 1)))
    return _texts(report, "earliest_date", "latest_date")


@_query
def distinct_species(spark, d):
    return scans.distinct_values(A.invoices(spark, d), "patient_species")


@_query
def gross_revenue(spark, d):
    return trends.gross_revenue(A.invoices(spark, d))


@_query
def active_revenue(spark, d):
    return trends.active_revenue(A.invoices(spark, d))


@_query
def invoice_count(spark, d):
    return trends.invoice_count(A.invoices(spark, d), JULY)


@_query
def patient_count(spark, d):
    return trends.patient_count(A.invoices(spark, d))


@_query
def customer_count(spark, d):
    return trends.customer_count(A.invoices(spark, d))


@_query
def revenue_on_day(spark, d):
    return trends.active_revenue(A.invoices(spark, d), P.day(date(2001, 7, 16)))


@_query
def revenue_year_to_date(spark, d):
    return trends.active_revenue(A.invoices(spark, d), P.year_to_date(AS_OF))


@_query
def revenue_in_year(spark, d):
    return trends.gross_revenue(A.invoices(spark, d), P.year(2000))


@_query
def ad_hoc_sql(spark, d):
    tables = {"invoices": A.invoices(spark, d), "clients": A.clients(spark, d)}
    views.register_views(spark, tables, prefix="adhoc_")
    return views.ask(
        spark,
        """SELECT logical_category AS category, SUM(quantity) AS units_sold,
             COUNT(DISTINCT c.client_id) AS registered_clients
           FROM adhoc_category_normalized n LEFT JOIN adhoc_clients c ON c.client_id = n.client_id
           WHERE cancelled = 0 AND performed_date IS NOT NULL
           GROUP BY logical_category""",
    ).withColumn("units_sold", F.col("units_sold").cast("double"))


@_query
def ad_hoc_parameters(spark, d):
    views.register_views(spark, {"invoices": A.invoices(spark, d)}, prefix="asked_")
    return views.ask(
        spark,
        """WITH shown AS (SELECT * FROM asked_category_normalized
             WHERE cancelled = 0 AND performed_date >= :first AND performed_date < :after)
           SELECT clinic_id, COUNT(DISTINCT invoice_id) AS invoice_count,
             CAST(SUM(CASE WHEN patient_species = :species THEN total END) AS DOUBLE) AS revenue
           FROM shown GROUP BY clinic_id""",
        {"first": JULY.start, "after": JULY.end, "species": "Feline"},
    )


@_query
def ad_hoc_discount_and_tax(spark, d):
    views.register_views(spark, {"invoices": A.invoices(spark, d)}, prefix="lines_")
    return views.ask(
        spark,
        """SELECT patient_breed, COUNT(DISTINCT sales_id) AS line_count,
             CAST(SUM(discount) AS DOUBLE) AS discount, CAST(SUM(tax_amount) AS DOUBLE) AS tax_amount
           FROM lines_invoices WHERE cancelled = 0 GROUP BY patient_breed""",
    )


@_query
def ad_hoc_membership(spark, d):
    views.register_views(spark, {"payments": A.payments(spark, d)}, prefix="paid_")
    return views.ask(
        spark,
        """SELECT is_membership, is_return, COUNT(*) AS payment_count,
             CAST(SUM(payment_amount) AS DOUBLE) AS amount
           FROM paid_payments GROUP BY is_membership, is_return""",
    )


@_query
def revenue_of_named_month(spark, d):
    return trends.active_revenue(A.invoices(spark, d), P.resolve_named_month(AS_OF, 11))


@_query
def revenue_of_previous_months(spark, d):
    return trends.monthly_revenue(A.invoices(spark, d), P.previous_months(AS_OF, 4))


@_query
def customer_count_other_phantom(spark, d):
    return trends.customer_count(A.invoices(spark, d), phantom="7")


# --- months ----------------------------------------------------------------


@_query
def monthly_revenue(spark, d):
    return trends.monthly_revenue(A.invoices(spark, d))


@_query
def revenue_by_invoice_date(spark, d):
    return trends.monthly_revenue(A.invoices(spark, d), date_col=P.BILLING_DATE)


@_query
def month_vs_previous(spark, d):
    return trends.month_vs_previous(A.invoices(spark, d), YEAR, MONTH, n=6)


@_query
def month_comparison_by_species(spark, d):
    dims = {"species": "patient_species"}
    return trends.compare_periods(A.invoices(spark, d), JULY, JUNE, dims)


@_query
def species_for_month(spark, d):
    return trends.species_for_month(A.invoices(spark, d), YEAR, MONTH)


@_query
def species_for_month_stored(spark, d):
    """The same report over a fact stored by month: one month's folder is read."""
    path = _new_folder(spark, "fact")
    sinks.write_fact(A.invoices(spark, d), path)
    fact = tables.read_table(spark, "invoices", {"path": path})
    return trends.species_for_month(fact, YEAR, MONTH)


@_query
def species_monthly_trend(spark, d):
    return trends.species_monthly_trend(A.invoices(spark, d), AS_OF)


@_query
def category_revenue(spark, d):
    return trends.category_revenue(A.invoices(spark, d), JULY)


@_query
def logical_category_revenue(spark, d):
    return trends.logical_category_revenue(A.invoices(spark, d), JULY)


@_query
def category_group_snapshot(spark, d):
    return trends.category_group_snapshot(A.invoices(spark, d), JULY)


@_query
def category_monthly_trend(spark, d):
    return trends.category_monthly_trend(A.invoices(spark, d), AS_OF)


@_query
def category_group_monthly(spark, d):
    return trends.category_group_monthly(A.invoices(spark, d), AS_OF)


@_query
def category_group_whole_months(spark, d):
    return trends.category_group_monthly(
        A.invoices(spark, d), AS_OF, complete_start=True, complete_end=True
    )


@_query
def monthly_title(spark, d):
    trend = trends.category_monthly_trend(A.invoices(spark, d), AS_OF)
    return present.granularity_title(trend, "Category Sales", "Monthly")


@_query
def by_clinic(spark, d):
    return trends.by_clinic(
        A.invoices(spark, d), ["revenue", "invoice_count", "customer_count", "units_sold"]
    )


@_query
def clinic_revenue_with_zero(spark, d):
    return trends.clinic_revenue_with_zero(A.clinic(spark), A.invoices(spark, d))


@_query
def top_customers(spark, d):
    return trends.top_customers(A.invoices(spark, d), QUARTER)


# --- weeks -----------------------------------------------------------------


@_query
def weekly_species_revenue(spark, d):
    return trends.weekly_species_revenue(A.invoices(spark, d), AS_OF)


@_query
def weekly_species_trend(spark, d):
    return trends.weekly_species_trend(A.invoices(spark, d), AS_OF)


@_query
def weekly_kpi(spark, d):
    return trends.weekly_kpi(A.invoices(spark, d), "customer_count", AS_OF, n=6)


@_query
def weekly_kpi_by_clinic(spark, d):
    dims = {"clinic_id": "clinic_id"}
    return trends.weekly_kpi(A.invoices(spark, d), "units_sold", AS_OF, n=4, dims=dims)


@_query
def category_weekly_trend(spark, d):
    return trends.category_weekly_trend(A.invoices(spark, d), AS_OF)


@_query
def top_categories_weekly(spark, d):
    return trends.top_categories_weekly(A.invoices(spark, d), AS_OF)


@_query
def top_logical_categories_weekly(spark, d):
    rows = views.category_normalized(A.invoices(spark, d))
    return trends.top_categories_weekly(rows, AS_OF, category="logical_category")


@_query
def category_group_weekly(spark, d):
    return trends.category_group_weekly(A.invoices(spark, d), AS_OF)


@_query
def life_stage_weekly_trend(spark, d):
    return trends.life_stage_weekly_trend(A.invoices(spark, d), A.patients(spark, d), AS_OF)


@_query
def summary_stats(spark, d):
    trend = trends.weekly_species_trend(A.invoices(spark, d), AS_OF)
    return present.summary_stats(trend, "revenue", ["species"])


@_query
def formatted_kpis(spark, d):
    trend = trends.weekly_species_trend(A.invoices(spark, d), AS_OF)
    money = ["revenue", "prev_revenue", "avg_revenue"]
    short = trend.withColumn("revenue_short", C.fmt_short("revenue"))
    return present.drop_internal(present.format_report(short, money, ["growth_pct"]))


@_query
def report_title(spark, d):
    trend = trends.weekly_species_trend(A.invoices(spark, d), AS_OF)
    return present.granularity_title(trend, "Species Sales", "Weekly")


@_query
def display_report(spark, d):
    trend = trends.weekly_species_trend(A.invoices(spark, d), AS_OF)
    return present.display_labels(present.drop_internal(trend))


# --- customers -------------------------------------------------------------


@_query
def weekly_new_customers(spark, d):
    return customers.weekly_new_customers(A.clients(spark, d), AS_OF, n=12)


@_query
def monthly_new_customers(spark, d):
    return customers.monthly_new_customers(A.clients(spark, d))


@_query
def new_vs_returning_count(spark, d):
    return customers.new_vs_returning_count(A.invoices(spark, d), A.clients(spark, d), *NEW_MONTH)


@_query
def new_vs_existing_revenue_month(spark, d):
    return customers.new_vs_existing_revenue_month(
        A.invoices(spark, d), A.clients(spark, d), *NEW_MONTH
    )


@_query
def new_vs_existing_first_day(spark, d):
    return customers.new_vs_existing_first_day(A.invoices(spark, d))


@_query
def new_customer_species_mix(spark, d):
    period = P.last_complete_month(date(2000, 4, 10))
    return customers.new_customer_species_mix(A.invoices(spark, d), A.clients(spark, d), period)


@_query
def new_customer_species_trend(spark, d):
    return customers.new_customer_species_trend(A.invoices(spark, d), A.clients(spark, d), AS_OF)


@_query
def visit_frequency(spark, d):
    return customers.visit_frequency(A.invoices(spark, d))


@_query
def visit_sequence(spark, d):
    return customers.visit_sequence(A.invoices(spark, d))


@_query
def client_state(spark, d):
    """All clients up to the reference day: a stored state, and three days merged one by one."""
    path, lines = _new_folder(spark, "clients"), A.invoices(spark, d)
    day = AS_OF - timedelta(days=3)
    state = history.advance(lines, path, day)
    while day < AS_OF:
        state = history.advance(lines, path, day + timedelta(days=1), since=day)
        day += timedelta(days=1)
    return _texts(state, "first_day", "last_day")


@_query
def distinct_clients_by_month(spark, d):
    """Months as ORs of the days' bitmaps; no line is read a second time."""
    lines = A.invoices(spark, d)
    ids = P.exclude_phantom(lines)
    numbers = history.numbered(ids, _new_folder(spark, "numbers"))
    days = history.day_bitmaps(lines, numbers, dims={"species": "patient_species"})
    path = _new_folder(spark, "bitmaps")
    days.write.parquet(path)
    stored = spark.read.schema(days.schema).parquet(path)
    month = F.year("day") * 100 + F.month("day")
    return history.distinct_counts(stored, {"month": month, "species": "species"})


@_query
def visit_ranked(spark, d):
    return _texts(customers.visit_ranked(A.invoices(spark, d), 3), "visit_date")


@_query
def returned_in_month(spark, d):
    return customers.returned_in_month(A.invoices(spark, d), 2, *RETURN_MONTH)


# --- life stage ------------------------------------------------------------


@_query
def invoice_life_stage(spark, d):
    columns = [
        "invoice_id",
        "performed_date",
        "patient_id",
        "patient_species",
        "total",
        "birth_date",
        "age_months_at_visit",
        "life_stage",
    ]
    rows = _staged(spark, d).select(*columns).withColumn("total", F.col("total").cast("double"))
    return _texts(rows, "performed_date", "birth_date")


@_query
def life_stage_monthly_trend(spark, d):
    return lifestage.life_stage_monthly_trend(_staged(spark, d), "Canine", AS_OF)


@_query
def life_stage_snapshot(spark, d):
    return lifestage.life_stage_snapshot(A.invoices(spark, d), A.patients(spark, d), AS_OF)


@_query
def category_normalized(spark, d):
    rows = views.category_normalized(A.invoices(spark, d))
    names = rows.groupBy("plan_category_name", "logical_category")
    return names.agg(F.count(F.lit(1)).alias("line_count"))


@_query
def calendar_labels(spark, d):
    days = scans.distinct_values(
        A.visits(spark, d).withColumn("day", F.to_date("performed_date")), "day"
    )
    labelled = days.select(
        "day",
        C.iso_week_label("day").alias("iso_week"),
        C.yearweek("day").alias("week_key"),
        C.week_range("day").alias("week_range"),
        C.week_label("day").alias("week_label"),
        C.month_key("day").alias("month_key"),
        C.month_label("day").alias("month_label"),
    )
    return _texts(labelled, "day")


# --- payments --------------------------------------------------------------


@_query
def returns_total(spark, d):
    return payments.returns_total(A.payments(spark, d))


@_query
def payment_mix(spark, d):
    return payments.payment_mix(A.payments(spark, d))


# --- query log -------------------------------------------------------------


@_query
def result_step(spark, d):
    report = trends.monthly_revenue(A.invoices(spark, d))
    step = sinks.result_step(report, 1, "revenue by month", "", "monthly_revenue")
    previews = F.size("data_preview").alias("preview_rows")
    return _texts(step.select("step_id", "result_alias", "row_count", "columns", previews), "columns")


@_query
def audit_statement_type(spark, d):
    return audit.audit_statement_type(A.query_log(spark, d))


@_query
def audit_alias_refs(spark, d):
    return audit.audit_alias_refs(A.query_log(spark, d))


@_query
def audit_rules(spark, d):
    return audit.audit_rules(A.query_log(spark, d), A.BANNED)


@_query
def classify_errors(spark, d):
    return audit.classify_errors(A.query_log(spark, d))


@_query
def sanitize_errors(spark, d):
    return audit.sanitize_errors(A.query_log(spark, d))
