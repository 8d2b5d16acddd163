"""The whole dashboard as one ordered table: header figures, tables, total rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pawledger.plans import dashboard

#: The sections in their order.
SECTIONS = (
    "Header",
    "Revenue",
    "Species",
    "Category",
    "Bills",
    "Day/Night",
    "Life Stage",
    "Visits",
    "Inventory",
    "Customers",
    "Clients",
)
#: Sections with a total, and whether its rows' shares add up to a whole.
TOTALS = {
    "Species": 1.0,
    "Category": 0.0,
    "Bills": 1.0,
    "Day/Night": 1.0,
    "Life Stage": 0.0,
    "Visits": 0.0,
    "Inventory": 1.0,
}


def _row(
    section: str,
    label: Column,
    this_week: Column,
    sub_label: Column | None = None,
    prior: Column | None = None,
    growth: Column | None = None,
    share: Column | None = None,
    is_total: bool = False,
    place: int = 0,
) -> Column:
    zero = F.lit(0.0)
    return F.struct(
        F.lit(section).alias("section"),
        F.lit(place).alias("place"),
        label.alias("label"),
        (F.lit("") if sub_label is None else F.coalesce(sub_label, F.lit(""))).alias("sub_label"),
        this_week.cast("double").alias("this_week"),
        (F.lit(None) if prior is None else prior).cast("double").alias("prior_avg"),
        (zero if growth is None else F.coalesce(growth, zero) / 100).alias("growth"),
        (zero if share is None else F.coalesce(share, zero) / 100).alias("share"),
        F.lit(is_total).alias("is_total"),
    )


def _rows(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select(F.inline(F.array(*rows)))


def _header(metrics: Mapping[str, DataFrame]) -> DataFrame:
    figures = {
        "Total Sales": {
            "this_week": F.col("total_sales"),
            "prior": F.col("prior_sales"),
            "growth": F.col("sales_variance_pct"),
        },
        "Repeat Customers": {"this_week": F.col("repeat_customers"), "share": F.col("repeat_pct")},
        "All Customers": {"this_week": F.col("total_customers")},
        "New Customers": {"this_week": F.col("new_customers")},
        "Inventory Value": {"this_week": F.col("inventory_total")},
        "Pharmacy": {"this_week": F.col("inventory_pharmacy")},
        "Non-Food": {"this_week": F.col("inventory_non_food")},
    }
    rows = [
        _row("Header", F.lit(label), place=k, **cells)
        for k, (label, cells) in enumerate(figures.items())
    ]
    return _rows(dashboard.kpi_headline(metrics), *rows)


def week_export(metrics: Mapping[str, DataFrame], top_n: int = 5) -> DataFrame:
    """All ten metrics as one table in the order of ``SECTIONS``.

    ``row_no`` numbers the rows of a section: the header's figures as they are
    listed, else by value, with the total last. Growth and share are fractions,
    zero where there are none. A total adds up the shown rows; those of revenue
    and clients by customer type are the week's own, as rounded revenue and
    clients of two species would not add up to them. Sections without rows have no
    total row. All of it is work on report rows.
    """
    columns = "section", "label", "sub_label", "this_week", "prior_avg", "growth", "share"
    tidy = dashboard.tidy_dashboard(metrics).select(*columns)
    label, value = F.col("label"), F.col("this_week")
    stages = metrics["life_stage_metrics"].select(
        F.lit("Visits").alias("section"),
        F.col("species").alias("label"),
        F.coalesce("life_stage", F.lit("")).alias("sub_label"),
        F.col("invoice_count").cast("double").alias("this_week"),
        F.lit(None).cast("double").alias("prior_avg"),
        F.lit(0.0).alias("growth"),
        F.lit(0.0).alias("share"),
    )
    shown = tidy.unionByName(stages)
    # The report's rows and their totals from one grouping.
    keys = ["label", "sub_label", "prior_avg", "growth", "share"]
    is_total = F.grouping("label") == 1
    whole = F.coalesce(*[F.when(F.col("section") == s, F.lit(w)) for s, w in TOTALS.items()])
    best = F.col("section") == "Category"
    name = F.when(best, F.lit(f"Total (Top {top_n})")).otherwise("Total")
    grouped = (
        shown.groupingSets([["section", *keys], ["section"]], "section", *keys)
        .agg(F.sum("this_week").alias("this_week"), is_total.alias("is_total"))
        .filter(~F.col("is_total") | F.col("section").isin(list(TOTALS)))
        .select(
            "section",
            F.lit(0).alias("place"),
            F.when(F.col("is_total"), name).otherwise(label).alias("label"),
            F.coalesce("sub_label", F.lit("")).alias("sub_label"),
            value.alias("this_week"),
            "prior_avg",
            F.coalesce("growth", F.lit(0.0)).alias("growth"),
            F.when(F.col("is_total"), whole).otherwise(F.col("share")).alias("share"),
            "is_total",
        )
    )
    total = F.lit("Total")
    revenue = _rows(
        metrics["new_vs_existing_revenue"],
        _row("Customers", total, F.col("total_revenue"), share=F.lit(100.0), is_total=True),
    )
    clients = _rows(
        metrics["new_vs_existing_customers"],
        _row("Clients", F.col("customer_type"), F.col("client_count"), F.col("species")),
    )
    everyone = _rows(
        metrics["repeat_customers"], _row("Clients", total, F.col("total_customers"), is_total=True)
    )
    report = _header(metrics)
    for rows in (grouped, revenue, clients, everyone):
        report = report.unionByName(rows)
    order = W.partitionBy("section").orderBy(
        "is_total", "place", F.desc("this_week"), "label", "sub_label"
    )
    return report.select(
        F.array_position(F.lit(list(SECTIONS)), F.col("section")).cast("int").alias("section_no"),
        "section",
        F.row_number().over(order).alias("row_no"),
        "label",
        "sub_label",
        "this_week",
        "prior_avg",
        "growth",
        "share",
        "is_total",
    ).orderBy("section_no", "row_no")
