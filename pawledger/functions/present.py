"""Presentation of finished reports: names, text columns, titles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pawledger.functions import columns as C
from pawledger.functions import rules

GRAIN_COLUMNS = {"Weekly": "week_range", "Monthly": "month_label"}


def business_aliases(
    df: DataFrame, aliases: Mapping[str, str] = rules.BUSINESS_ALIASES
) -> DataFrame:
    """Technical column names replaced by business names."""
    return df.withColumnsRenamed(dict(aliases))


def display_labels(df: DataFrame, grain: str = "Week") -> DataFrame:
    """Column headings for a shown table."""
    labels = {**rules.DISPLAY_LABELS, "prev_revenue": f"Previous {grain} Revenue"}
    return df.withColumnsRenamed(labels)


def drop_internal(
    df: DataFrame, internal: Sequence[str] = rules.INTERNAL_COLUMNS
) -> DataFrame:
    return df.drop(*internal)


def null_to_zero(df: DataFrame) -> DataFrame:
    """NULL numbers shown as zero; text stays NULL."""
    return df.na.fill(0)


def non_zero_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) > 0)


def add_trend(df: DataFrame, growth: str = "growth_pct") -> DataFrame:
    return df.withColumn("trend", C.trend_label(growth))


def format_report(
    df: DataFrame, money: Sequence[str] = (), percent: Sequence[str] = ()
) -> DataFrame:
    """Money and per cent columns as text, in place."""
    texts = {c: C.fmt_inr(c) for c in money} | {c: C.fmt_pct(c) for c in percent}
    return df.withColumns(texts)


def granularity_title(df: DataFrame, title: str, grain: str) -> DataFrame:
    """One row: the title with its grain, and the period read from the data."""
    label = GRAIN_COLUMNS[grain]
    key = F.col("sort_key")
    first, last = F.min_by(label, key), F.max_by(label, key)
    if grain == "Weekly":
        first, last = F.split_part(first, F.lit(" - "), F.lit(1)), F.split_part(
            last, F.lit(" - "), F.lit(2)
        )
    return df.agg(
        F.lit(f"{title} ({grain})").alias("output_title"),
        first.alias("period_start"),
        last.alias("period_end"),
    )


def summary_stats(
    df: DataFrame, measure: str, by: Sequence[str] = (), exact_type: str = "decimal(28,2)"
) -> DataFrame:
    """Minimum, maximum, mean and total over the displayed rows.

    The rows are added up as decimals, so that their order does not matter.
    """
    m, exact = F.col(measure), F.col(measure).cast(exact_type)
    return df.groupBy(*by).agg(
        F.min(m).alias("min_value"),
        F.max(m).alias("max_value"),
        F.round(F.avg(exact), 2).cast("double").alias("avg_value"),
        F.sum(exact).cast("double").alias("total_value"),
    )
