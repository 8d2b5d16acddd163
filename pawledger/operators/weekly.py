"""Dashboard metrics of one week against the mean of the weeks before it.

Every metric reads the fact once. Lines are first added up per dimension and
week, which combines on the map side whatever the size of a dimension; the
report itself is computed from those few rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pawledger.functions import columns as C
from pawledger.functions import periods as P
from pawledger.functions import rules

PRIOR_WEEKS = 3


def _week_bucket(ws: date) -> Column:
    """The reported week's start for its own lines, else their ISO Monday."""
    ts = F.col(P.SERVICE_DATE)
    return F.when(ts >= F.lit(ws), F.lit(ws)).otherwise(C.week_start(ts))


def window_rows(fact: DataFrame, ws: date, we: date, prior_weeks: int) -> DataFrame:
    start = P.weeks_back(ws, prior_weeks)
    rows = fact.filter(P.in_period(P.SERVICE_DATE, P.inclusive(start, we)))
    return rows.withColumn("week_bucket", _week_bucket(ws))


def week_rows(fact: DataFrame, ws: date, we: date) -> DataFrame:
    return fact.filter(P.in_period(P.SERVICE_DATE, P.inclusive(ws, we)))


def _is_current(ws: date) -> Column:
    return F.col("week_bucket") == F.lit(ws)


def prior_weekly_avg(weekly: DataFrame, dims: Sequence[str], ws: date) -> DataFrame:
    """This week's value next to the mean over the prior weeks that have rows.

    ``weekly`` has one ``value`` per dimension and week. Dimensions seen only
    before the week get zero now, and those seen only now get a zero mean.
    """
    current = _is_current(ws)
    return weekly.groupBy(*dims).agg(
        F.coalesce(F.sum(F.when(current, F.col("value"))), F.lit(0)).alias("this_week"),
        mean_of(F.when(~current, F.col("value"))).alias("prior_avg"),
        F.max(current).alias("has_current"),
    )


def mean_of(value: Column) -> Column:
    """Mean of an exact type, zero without rows; independent of row order."""
    return F.coalesce(F.sum(value).cast("double") / F.count(value), F.lit(0.0))


def share_of_total(column: str, *within: str) -> Column:
    """Per cent of the column's total, over a report that is already aggregated."""
    total = F.sum(column).over(W.partitionBy(*within)).cast("double")
    share = F.bround(F.col(column).cast("double") / total * 100, 1)
    return F.when(total != 0, share).otherwise(F.lit(0.0))


def _compare(
    fact: DataFrame,
    dim: Column,
    measure: Column,
    ws: date,
    we: date,
    prior_weeks: int,
    top_n: int | None = None,
) -> DataFrame:
    rows = window_rows(fact, ws, we, prior_weeks).withColumn("dim", dim)
    weekly = (
        rows.filter(F.col("dim").isNotNull())
        .groupBy("dim", "week_bucket")
        .agg(measure.alias("value"))
    )
    compared = prior_weekly_avg(weekly, ["dim"], ws)
    if top_n is not None:
        compared = (
            compared.filter("has_current").orderBy(F.desc("this_week"), F.asc("dim")).limit(top_n)
        )
    return compared.select(
        "dim",
        "this_week",
        "prior_avg",
        share_of_total("this_week").alias("pct_contribution"),
        C.growth_pct("this_week", "prior_avg", half_even=True).alias("growth_pct"),
    )


def _report(compared: DataFrame, dim: str, value: str, digits: int = 0) -> DataFrame:
    return compared.select(
        F.col("dim").alias(dim),
        F.bround(F.col("this_week").cast("double"), 0).alias(value),
        F.bround("prior_avg", digits).alias("prior_3wk_avg"),
        "pct_contribution",
        "growth_pct",
    ).orderBy(F.desc(value), F.asc(dim))


def coverage_pct(days: Column) -> Column:
    """Share of a seven-day week for a count of days with an invoice."""
    return F.bround(100.0 * days / 7, 1)


def total_sales(
    fact: DataFrame, ws: date, we: date, prior_weeks: int = PRIOR_WEEKS
) -> DataFrame:
    """Sales of the week, prior mean, variance and day coverage; one row."""
    rows = window_rows(fact, ws, we, prior_weeks)
    daily = rows.groupBy("week_bucket", F.to_date(P.SERVICE_DATE).alias("day")).agg(
        F.sum("total").alias("total")
    )
    weekly = daily.groupBy("week_bucket").agg(
        F.sum("total").alias("value"), F.count("day").alias("days")
    )
    current = _is_current(ws)
    this_week = F.sum(F.when(current, F.col("value"))).cast("double")
    figures = weekly.agg(
        F.coalesce(this_week, F.lit(0.0)).alias("this_week"),
        mean_of(F.when(~current, F.col("value"))).alias("prior_avg"),
        coverage_pct(F.coalesce(F.sum(F.when(current, F.col("days"))), F.lit(0))).alias("cov"),
    )
    warning = F.replace(F.lit(rules.PARTIAL_WEEK), F.lit("{}"), F.col("cov").cast("string"))
    return figures.select(
        F.bround("this_week", 0).alias("value"),
        F.bround("prior_avg", 0).alias("prior_value"),
        F.bround(F.col("this_week") - F.col("prior_avg"), 0).alias("variance"),
        C.growth_pct("this_week", "prior_avg", half_even=True).alias("variance_pct"),
        F.col("cov").alias("coverage_pct"),
        F.array_compact(F.array(F.when(F.col("cov") < 100, warning))).alias("warnings"),
    )


def species_sales(
    fact: DataFrame, ws: date, we: date, prior_weeks: int = PRIOR_WEEKS
) -> DataFrame:
    """Revenue per species."""
    compared = _compare(fact, F.col("patient_species"), F.sum("total"), ws, we, prior_weeks)
    return _report(compared, "species", "this_week_revenue")


def category_top_n(
    fact: DataFrame, ws: date, we: date, top_n: int = 5, prior_weeks: int = PRIOR_WEEKS
) -> DataFrame:
    """The week's best categories; shares are of the listed categories' total."""
    dim = F.col("plan_category_name")
    compared = _compare(fact, dim, F.sum("total"), ws, we, prior_weeks, top_n)
    return _report(compared, "category", "this_week_revenue")


def invoice_count_by_species(
    fact: DataFrame, ws: date, we: date, prior_weeks: int = PRIOR_WEEKS
) -> DataFrame:
    """Distinct invoices per species."""
    bills = F.countDistinct("invoice_id")
    compared = _compare(fact, F.col("patient_species"), bills, ws, we, prior_weeks)
    report = _report(compared, "species", "bill_count", digits=1)
    return report.withColumn("bill_count", F.col("bill_count").cast("bigint"))


def day_night_split(
    fact: DataFrame,
    ws: date,
    we: date,
    prior_weeks: int = PRIOR_WEEKS,
    hours: tuple[int, int] = rules.DAY_HOURS,
) -> DataFrame:
    """Revenue of day and night hours."""
    band = C.time_band(P.SERVICE_DATE, hours)
    compared = _compare(fact, band, F.sum("total"), ws, we, prior_weeks)
    return _report(compared, "time_band", "revenue")


def repeat_customers(
    fact: DataFrame,
    prior_clients: DataFrame,
    ws: date,
    we: date,
    phantom: str = rules.PHANTOM_CLIENT,
) -> DataFrame:
    """Clients of the week and how many of them were known before; one row.

    Lines without a client count as one client. Both sides are distinct ids
    before they meet, so no client is hot in the join.
    """
    rows = P.exclude_phantom(week_rows(fact, ws, we), null_safe=True, phantom=phantom)
    known = prior_clients.select("client_id", F.lit(True).alias("known"))
    ids = rows.select("client_id").distinct().join(known, "client_id", "left")
    counts = ids.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count("known").alias("repeat_customers"),
    )
    total, repeat = F.col("total_customers"), F.col("repeat_customers")
    share = F.bround(100.0 * repeat / total, 1)
    warning = F.when(total == 0, F.lit(rules.NO_CUSTOMERS))
    return counts.select(
        total,
        repeat,
        (total - repeat).alias("new_customers"),
        F.when(total > 0, share).otherwise(F.lit(0.0)).alias("repeat_pct"),
        F.array_compact(F.array(warning)).alias("warnings"),
    )


def _client_revenue(
    fact: DataFrame, new_ids: DataFrame, ws: date, we: date, phantom: str, *dims: Column
) -> DataFrame:
    """The week's revenue per client, flagged new or not.

    Lines are added up per client before the join, so a client with very many
    lines is one row there.
    """
    rows = P.exclude_phantom(week_rows(fact, ws, we), null_safe=True, phantom=phantom)
    per_client = rows.groupBy("client_id", *dims).agg(F.sum("total").alias("total"))
    flag = new_ids.select("client_id", F.lit(True).alias("is_new"))
    return per_client.join(flag, "client_id", "left")


def new_vs_existing_customers(
    fact: DataFrame,
    new_ids: DataFrame,
    ws: date,
    we: date,
    phantom: str = rules.PHANTOM_CLIENT,
) -> DataFrame:
    """Distinct clients and revenue by customer type and species bucket."""
    bucket = C.species_bucket("patient_species").alias("species")
    per_client = _client_revenue(fact, new_ids, ws, we, phantom, bucket)
    kind = F.when(F.col("is_new"), "New").otherwise("Existing")
    order = F.array_position(F.lit(list((*rules.MAIN_SPECIES, rules.OTHER_SPECIES))), F.col("species"))
    report = per_client.groupBy(kind.alias("customer_type"), "species").agg(
        F.count("client_id").alias("client_count"),
        F.bround(F.sum("total").cast("double"), 0).alias("revenue"),
    )
    return report.orderBy(F.desc("customer_type"), order)


def new_vs_existing_revenue(
    fact: DataFrame,
    new_ids: DataFrame,
    ws: date,
    we: date,
    phantom: str = rules.PHANTOM_CLIENT,
) -> DataFrame:
    """Revenue of new clients; everything else counts as existing. One row."""
    per_client = _client_revenue(fact, new_ids, ws, we, phantom)
    zero = F.lit(0).cast("decimal(28,2)")
    sums = per_client.agg(
        F.coalesce(F.sum(F.when(F.col("is_new"), F.col("total"))), zero).alias("n"),
        F.coalesce(F.sum("total"), zero).alias("t"),
    ).select(F.col("n").cast("double").alias("n"), F.col("t").cast("double").alias("t"))
    # The warning is about the set of new ids, not about the week's revenue.
    any_new = new_ids.agg((F.count(F.lit(1)) == 0).alias("no_new"))
    merged = sums.unionByName(any_new, allowMissingColumns=True).agg(
        F.max("n").alias("n"), F.max("t").alias("t"), F.max("no_new").alias("no_new")
    )
    n, t = F.col("n"), F.col("t")

    def share(part: Column) -> Column:
        return F.when(t != 0, F.bround(100.0 * part / t, 1)).otherwise(F.lit(0.0))

    warning = F.when(F.col("no_new"), F.lit(rules.NO_NEW_CLIENTS))
    return merged.select(
        F.bround(n, 0).alias("new_revenue"),
        F.bround(t - n, 0).alias("existing_revenue"),
        F.bround(t, 0).alias("total_revenue"),
        share(n).alias("new_pct"),
        share(t - n).alias("existing_pct"),
        F.array_compact(F.array(warning)).alias("warnings"),
    )


def life_stage_metrics(
    fact: DataFrame,
    patients: DataFrame,
    ws: date,
    we: date,
    stages: Mapping[str, rules.LifeStages] = rules.LIFE_STAGES,
) -> DataFrame:
    """Revenue and distinct invoices by species and life stage."""
    species = F.col("patient_species")
    rows = week_rows(fact, ws, we).filter(species.isin(list(stages)))
    age = C.age_months_approx("birth_date", P.SERVICE_DATE)
    stage = C.life_stage(species, age, stages)
    staged = rows.join(patients, "patient_id").withColumn("life_stage", stage)
    report = staged.groupBy(species.alias("species"), "life_stage").agg(
        F.bround(F.sum("total").cast("double"), 0).alias("revenue"),
        F.countDistinct("invoice_id").alias("invoice_count"),
    )
    return report.orderBy("species", F.desc("revenue"), "life_stage")
