"""Life-stage reports over the life-stage view."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawledger.functions import periods as P
from pawledger.functions import rules
from pawledger.operators import trends
from pawledger.sources.views import staged_lines


def life_stage_groups(
    spark: SparkSession, by_species: Mapping[str, rules.LifeStages] = rules.LIFE_STAGES
) -> DataFrame:
    """Every species and stage in report order."""
    rows = [
        F.struct(
            F.lit(species).alias("species"),
            F.lit(stage).alias("life_stage"),
            F.lit(sort_species).alias("sort_sp"),
            F.lit(sort_stage).alias("sort_ls"),
        )
        for sort_species, (species, stages) in enumerate(by_species.items(), 1)
        for sort_stage, stage in enumerate((stages.young, "Adult", "Senior"), 1)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def life_stage_monthly_trend(
    staged: DataFrame,
    species: str,
    as_of: date,
    n: int = 6,
    complete_start: bool = False,
    complete_end: bool = False,
) -> DataFrame:
    """Monthly revenue and clients per life stage of one species."""
    recent = P.period_rows(staged, P.recent_months(as_of, n, complete_start, complete_end))
    rows = recent.filter(
        (F.col("patient_species") == species) & F.col("life_stage").isNotNull()
    )
    measures = [
        F.sum("total").cast("double").alias("revenue"),
        F.countDistinct("client_id").alias("client_count"),
    ]
    trend = trends.monthly_series(rows, {"life_stage": "life_stage"}, measures)
    return trend.orderBy("sort_key", "life_stage")


def life_stage_snapshot(
    invoices: DataFrame,
    patients: DataFrame,
    as_of: date,
    weeks: int = 4,
    stages: Mapping[str, rules.LifeStages] = rules.LIFE_STAGES,
) -> DataFrame:
    """All species and stages over the last weeks, also those without a line.

    Lines are added up per invoice and client first, so that the two distinct
    counts do not multiply the lines.
    """
    recent = P.period_rows(invoices, P.up_to(as_of, P.weeks_back(as_of, weeks)))
    lines = staged_lines(recent, patients, stages=stages)
    keys = [F.col("patient_species").alias("species"), "life_stage", "invoice_id", "client_id"]
    rows = lines.groupBy(*keys).agg(F.sum("total").alias("total"))
    actuals = rows.groupBy("species", "life_stage").agg(
        F.sum("total").cast("double").alias("revenue"),
        F.countDistinct("invoice_id").alias("invoice_count"),
        F.countDistinct("client_id").alias("client_count"),
    )
    groups = life_stage_groups(invoices.sparkSession, stages)
    report = groups.join(actuals, ["species", "life_stage"], "left").orderBy("sort_sp", "sort_ls")
    return report.select(
        F.concat_ws(" ", "species", "life_stage").alias("life_stage_group"),
        "species",
        "life_stage",
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.coalesce("invoice_count", F.lit(0)).alias("invoice_count"),
        F.coalesce("client_count", F.lit(0)).alias("client_count"),
    )
