"""Stock value, coverage and SKU rankings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pawledger.functions import columns as C
from pawledger.functions import periods as P
from pawledger.functions import rules
from pawledger.operators.weekly import share_of_total
from pawledger.session import materialize

RATE_DAYS = 31
SALES_DAYS = 30


def _value(quantity: Column | str = "onhand_qty", cost: Column | str = "purchase_cost") -> Column:
    unit_cost = F.coalesce(C.as_column(cost), F.lit(0).cast("decimal(18,2)"))
    return C.nonneg(quantity) * unit_cost


def stock_value(stocks: DataFrame) -> DataFrame:
    """Value of all stock; one row."""
    return stocks.agg(F.sum(_value()).cast("double").alias("stock_value"))


def inventory_value(scanned_stocks: DataFrame) -> DataFrame:
    """Value and share per inventory type, over ``scan_stocks``."""
    kind = C.inventory_bucket("plan_category_name").alias("inventory_type")
    sums = scanned_stocks.groupBy(kind).agg(F.sum(_value()).alias("value"))
    return sums.select(
        "inventory_type",
        F.bround(F.col("value").cast("double"), 0).alias("stock_value"),
        share_of_total("value").alias("pct_of_total"),
    ).orderBy(F.desc("stock_value"), "inventory_type")


def closing_stock_by_group(
    stocks: DataFrame, group_rules: Sequence[rules.Rule] = rules.STOCK_GROUP_RULES
) -> DataFrame:
    """Distinct SKUs, quantity and value per stock group."""
    group = C.stock_group("plan_category_name", group_rules).alias("category_group")
    report = stocks.groupBy(group).agg(
        F.countDistinct("stock_id").alias("distinct_skus"),
        F.round(F.sum(C.nonneg("onhand_qty")), 2).cast("double").alias("onhand_qty"),
        F.round(F.sum(_value()), 2).cast("double").alias("stock_value"),
    )
    return report.orderBy(F.desc("stock_value"), "category_group")


def _quantities(stocks: DataFrame, *keys: str) -> DataFrame:
    return stocks.groupBy(*keys).agg(
        F.sum(C.nonneg("onhand_qty")).cast("double").alias("onhand_qty")
    )


def stock_by_company(stocks: DataFrame) -> DataFrame:
    """Quantity per SKU over all clinics."""
    return _quantities(stocks, "stock_id")


def stock_by_clinic(stocks: DataFrame) -> DataFrame:
    """Quantity per SKU and clinic."""
    return _quantities(stocks, "clinic_id", "stock_consumed_id")


def category_stock_coverage(
    stocks: DataFrame,
    invoices: DataFrame,
    year: int,
    month: int,
    min_days: float = 21,
    rate_days: int = RATE_DAYS,
) -> DataFrame:
    """Categories whose stock value lasts longer than ``min_days``.

    Both sides are one row per category before they are joined.
    """
    category = "plan_category_name"
    sold = P.period_rows(invoices, P.month(year, month)).groupBy(category)
    rate = sold.agg((F.sum("total").cast("double") / rate_days).alias("daily_rate"))
    value = stocks.groupBy(category).agg(F.sum(_value()).cast("double").alias("value"))
    cover = F.col("value") / F.col("daily_rate")
    report = value.join(rate.filter("daily_rate > 0"), category).filter(cover > min_days)
    return report.orderBy(cover.desc(), category).select(
        category,
        F.round("value", 2).alias("stock_value"),
        F.round("daily_rate", 2).alias("daily_revenue_rate"),
        F.round(cover, 1).alias("coverage_days"),
    )


def _sku_cover(stocks: DataFrame, invoices: DataFrame, as_of: date, days: int) -> DataFrame:
    """Every stocked SKU of a clinic with its days of cover; NULL if unsold."""
    sales = P.period_rows(invoices, P.up_to(as_of, P.days_back(as_of, days)))
    sold = (
        sales.filter(F.col("plan_item_id").isNotNull())
        .groupBy("plan_item_id")
        .agg(F.sum("quantity").cast("double").alias("units"))
    )
    quantity = C.nonneg("onhand_qty")
    daily_units = F.nullif(F.col("units") / days, F.lit(0.0))
    stocked = stocks.filter(quantity > 0).withColumn("onhand", quantity.cast("double"))
    return stocked.join(sold, "plan_item_id", "left").select(
        F.col("stock_id").alias("sku_id"),
        "clinic_id",
        F.col("plan_item_name").alias("sku_name"),
        F.col("plan_category_name").alias("category"),
        F.col("onhand").alias("onhand_qty"),
        F.round(F.col("onhand") / daily_units, 1).alias("days_cover"),
    )


def sku_days_cover(
    stocks: DataFrame, invoices: DataFrame, as_of: date, k: int = 25, days: int = SALES_DAYS
) -> DataFrame:
    """The SKUs with the longest cover at the recent rate of sale."""
    cover = _sku_cover(stocks, invoices, as_of, days)
    return cover.orderBy(F.desc_nulls_last("days_cover"), "sku_id", "clinic_id").limit(k)


def excess_stock(
    stocks: DataFrame,
    invoices: DataFrame,
    as_of: date,
    threshold: float = 21,
    days: int = SALES_DAYS,
) -> DataFrame:
    """Stock beyond the threshold, or without any recent sale."""
    cover = _sku_cover(stocks, invoices, as_of, days)
    unsold = F.col("days_cover").isNull()
    return cover.filter(unsold | (F.col("days_cover") > threshold)).withColumn(
        "reason", F.when(unsold, "no sales").otherwise("excess")
    )


def _sku_sales(invoices: DataFrame, as_of: date, months: int) -> DataFrame:
    rows = P.period_rows(invoices, P.recent_months(as_of, months))
    sold = rows.filter(F.col("plan_item_id").isNotNull())
    return sold.groupBy(
        F.col("plan_item_id").alias("sku_id"), F.col("plan_item_name").alias("sku_name")
    ).agg(F.sum("total").alias("revenue"), F.sum("quantity").alias("units_sold"))


def top_skus(invoices: DataFrame, as_of: date, months: int = 3, k: int = 25) -> DataFrame:
    """Best-selling SKUs of the last months by revenue."""
    best = _sku_sales(invoices, as_of, months)
    best = best.orderBy(F.desc("revenue"), "sku_id", "sku_name").limit(k)
    return best.select(
        "sku_id",
        "sku_name",
        F.col("revenue").cast("double").alias("revenue"),
        F.col("units_sold").cast("double").alias("units_sold"),
    )


def sku_trend(invoices: DataFrame, as_of: date, months: int = 6) -> DataFrame:
    """Monthly revenue and units per SKU."""
    rows = P.period_rows(invoices, P.recent_months(as_of, months))
    sold = rows.filter(F.col("plan_item_id").isNotNull())
    monthly = sold.groupBy(
        C.month_start(P.SERVICE_DATE).alias("month"), "plan_item_id", "plan_item_name"
    ).agg(
        F.sum("total").cast("double").alias("revenue"),
        F.sum("quantity").cast("double").alias("units_sold"),
    )
    return monthly.select(
        C.month_key("month").alias("sort_key"),
        C.month_label("month").alias("month_label"),
        F.col("plan_item_id").alias("sku_id"),
        F.col("plan_item_name").alias("sku_name"),
        "revenue",
        "units_sold",
    )


def sku_pareto(
    invoices: DataFrame, as_of: date, months: int = 3, cutoff: float | None = 0.8
) -> DataFrame:
    """SKUs by falling revenue with cumulative revenue, up to the cutoff.

    The last SKU listed is the one that reaches the cutoff; ``None`` lists
    all. The ordering is global but no task sees more than its range: SKUs are
    range-partitioned by revenue, written once, and each range is summed on
    its own; the ranges' totals, one row per partition, give its offset.
    """
    spark = invoices.sparkSession
    ranges = _range_count(spark)
    order = [F.desc("revenue"), F.asc("sku_id"), F.asc("sku_name")]
    sales = _sku_sales(invoices, as_of, months).drop("units_sold")
    ranged = materialize(
        sales.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    )
    parts = ranged.groupBy("part").agg(F.sum("revenue").alias("part_revenue"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        "part",
        F.coalesce(F.sum("part_revenue").over(before), F.lit(0)).alias("offset"),
        F.sum("part_revenue").over(W.partitionBy()).alias("grand_total"),
    )
    upto = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = ranged.join(F.broadcast(offsets), "part").select(
        "sku_id",
        "sku_name",
        F.col("revenue").cast("double").alias("revenue"),
        (F.sum("revenue").over(upto) + F.col("offset")).cast("double").alias("cum_revenue"),
        F.col("grand_total").cast("double").alias("grand_total"),
    )
    cum, total = F.col("cum_revenue"), F.col("grand_total")
    listed = running
    if cutoff is not None:
        listed = running.filter(cum - F.col("revenue") < F.lit(cutoff) * total)
    return listed.select(
        "sku_id",
        "sku_name",
        "revenue",
        "cum_revenue",
        F.round(100.0 * cum / F.nullif(total, F.lit(0.0)), 2).alias("cum_pct"),
    )


def _range_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
