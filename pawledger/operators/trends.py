"""Weekly and monthly series of any measure, with growth on the period before.

A weekly report of n weeks is built from n + 1 weeks: the newest n + 1 weeks
up to the reference day that have rows form the spine, the oldest of them is
only the baseline. The spine is searched backward from the reference day in the
date column alone; its dates become plain ranges in the filter of the lines, so
that nothing older is read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pawledger.functions import columns as C
from pawledger.functions import periods as P
from pawledger.functions import rules
from pawledger.sources.views import staged_lines

# Each measure by the id of the walk-in client, who is no customer.
MEASURES: dict[str, Callable[[str], Column]] = {
    "revenue": lambda phantom: F.sum("total").cast("double"),
    "invoice_count": lambda phantom: F.countDistinct("invoice_id"),
    "customer_count": lambda phantom: F.countDistinct(
        F.when(F.col("client_id") != phantom, F.col("client_id"))
    ),
    "patient_count": lambda phantom: F.countDistinct("patient_id"),
    "units_sold": lambda phantom: F.sum("quantity").cast("double"),
}

Dims = Sequence[Column | str]
WEEK = timedelta(weeks=1)


def measure_columns(names: Sequence[str], phantom: str = rules.PHANTOM_CLIENT) -> list[Column]:
    return [MEASURES[name](phantom).alias(name) for name in names]


def with_dims(rows: DataFrame, dims: dict[str, Column | str]) -> tuple[DataFrame, list[str]]:
    """Named report dimensions added to the lines they are computed from."""
    return rows.withColumns({k: C.as_column(v) for k, v in dims.items()}), list(dims)


# --- growth ----------------------------------------------------------------


def with_growth(
    series: DataFrame, dims: Sequence[str], value: str, expected_prev: Column, key: str
) -> DataFrame:
    """Previous value, change and growth per series.

    The previous row counts only if it is the period just before; a series
    that skips a period has no growth there.
    """
    over = W.partitionBy(*dims).orderBy(key)
    adjacent = F.lag(key).over(over) == expected_prev
    previous = F.when(adjacent, F.lag(value).over(over))
    prev_name = "prev_revenue" if value == "revenue" else f"prev_{value}"
    grown = series.withColumn(prev_name, previous)
    return grown.withColumns(
        {
            "change_amount": F.round(F.col(value) - F.col(prev_name), 2),
            "growth_pct": C.growth_pct(value, prev_name),
        }
    )


def drop_baseline(series: DataFrame, prev: str = "prev_revenue") -> DataFrame:
    """Only rows with a real, non-zero value to compare with."""
    return series.filter(F.col(prev).isNotNull() & (F.col(prev) != 0))


# --- weeks -----------------------------------------------------------------


def week_period(as_of: date, lookback_weeks: int | None = None) -> P.Period:
    """All days up to the reference day, or whole weeks of a given lookback."""
    if lookback_weeks is None:
        return P.up_to(as_of)
    return P.up_to(as_of, P.week_of(P.weeks_back(as_of, lookback_weeks)).start)


def recent_weeks(
    rows: DataFrame, as_of: date, n: int, date_col: str, lookback_weeks: int | None = None
) -> list[date]:
    """The Mondays of the newest n + 1 weeks with rows, newest first.

    The search reads the date column of 2 (n + 1) weeks. Only while fewer weeks are found and older
    rows exist does it go on, in ranges that grow fourfold; each day is read once. It runs when it
    is called, and its n + 1 dates come to the driver. ``lookback_weeks`` ends it there.
    """
    period = week_period(as_of, lookback_weeks)
    earliest, end, span = period.start, period.end, 2 * (n + 1)
    oldest_known = False
    found: list[date] = []
    while True:
        weeks_before = min(span, (as_of - date.min).days // 7 - 1)
        start = P.week_of(P.weeks_back(as_of, weeks_before)).start
        if earliest is not None:
            start = max(start, earliest)
        dates = P.dated(rows, date_col, P.Period(start, end))
        weeks = dates.select(C.week_start(date_col).alias("week")).distinct()
        found += [r["week"] for r in weeks.orderBy(F.desc("week")).limit(n + 1 - len(found)).collect()]
        if len(found) > n or start == earliest:
            return found
        if not oldest_known:
            first = P.dated(rows, date_col, P.Period(None, start)).agg(F.min(C.week_start(date_col))).first()[0]
            if first is None:
                return found
            earliest, oldest_known = max(first, earliest or first), True
        end, span = start, 4 * span


def in_weeks(date_col: str, weeks: Sequence[date], period: P.Period) -> Column:
    """Days of the weeks, newest first, inside a period: one plain range, and where weeks are missing
    one more for each stretch of weeks."""
    if not weeks:
        return F.lit(False)
    start = weeks[-1] if period.start is None else max(weeks[-1], period.start)
    stretches: list[P.Period] = []
    for week in weeks:
        if stretches and stretches[-1].start == week + WEEK:
            stretches[-1] = P.Period(week, stretches[-1].end)
        else:
            stretches.append(P.Period(week, week + WEEK))
    inside = P.in_range(date_col, start, period.end)
    if len(stretches) > 1 or stretches[0].end < period.end:
        inside = inside & reduce(or_, [P.in_range(date_col, *s) for s in stretches])
    return inside


def spine_rows(
    rows: DataFrame, as_of: date, n: int, date_col: str, lookback_weeks: int | None = None
) -> DataFrame:
    """The lines of the newest n + 1 weeks with rows, with ``week`` and ``prev_week``, the one of
    these weeks before it."""
    weeks = recent_weeks(rows, as_of, n, date_col, lookback_weeks)
    period = week_period(as_of, lookback_weeks)
    lines = rows.filter(in_weeks(date_col, weeks, period))
    if weeks:
        lines = P.dated(lines, date_col, P.Period(weeks[-1], period.end))
    before = F.lit(None).cast("date")
    if len(weeks) > 1:
        pairs = [F.lit(day) for pair in zip(weeks[:-1], weeks[1:]) for day in pair]
        before = F.element_at(F.create_map(*pairs), F.col("week"))
    return lines.withColumn("week", C.week_start(date_col)).withColumn("prev_week", before)


def week_columns() -> list[Column]:
    return [C.yearweek("week").alias("sort_key"), C.week_range("week").alias("week_range")]


def weekly_series(
    rows: DataFrame,
    dims: dict[str, Column | str],
    measures: Sequence[Column],
    as_of: date,
    weeks: int,
    date_col: str = P.SERVICE_DATE,
) -> DataFrame:
    """Plain weekly sums of whole weeks since the one ``weeks`` weeks ago."""
    since = rows.filter(P.in_period(date_col, week_period(as_of, weeks)))
    keyed, names = with_dims(since.withColumn("week", C.week_start(date_col)), dims)
    sums = keyed.groupBy("week", *names).agg(*measures)
    kept = [c for c in sums.columns if c != "week"]
    return sums.select(*week_columns(), *kept).orderBy("sort_key", *names)


def weekly_trend(
    rows: DataFrame,
    dims: dict[str, Column | str],
    measures: Sequence[Column],
    value: str,
    as_of: date,
    n: int,
    date_col: str = P.SERVICE_DATE,
    lookback_weeks: int | None = None,
) -> DataFrame:
    """The last n weeks per series with growth on the week before.

    ``value`` is the measure that growth is computed for. The output keeps
    only rows with a comparable week before, so the baseline week is gone.
    """
    recent = spine_rows(rows, as_of, n, date_col, lookback_weeks)
    return week_growth(recent, dims, measures, value)


def week_growth(
    recent: DataFrame, dims: dict[str, Column | str], measures: Sequence[Column], value: str
) -> DataFrame:
    """The report of ``weekly_trend`` from the lines of the spine's weeks."""
    keyed, names = with_dims(recent, dims)
    series = keyed.groupBy("week", "prev_week", *names).agg(*measures)
    grown = with_growth(series, names, value, F.col("prev_week"), "week")
    prev = "prev_revenue" if value == "revenue" else f"prev_{value}"
    shown = drop_baseline(grown, prev)
    kept = [c for c in shown.columns if c not in ("week", "prev_week")]
    return shown.select(*week_columns(), *kept)


def weekly_kpi(
    invoices: DataFrame,
    measure: str,
    as_of: date,
    n: int,
    dims: dict[str, Column | str] | None = None,
    date_col: str = P.SERVICE_DATE,
    active_only: bool = True,
    phantom: str = rules.PHANTOM_CLIENT,
    lookback_weeks: int | None = None,
) -> DataFrame:
    """The last n weeks of any measure, by any dimensions."""
    rows = P.period_rows(invoices, date_col=date_col, active_only=active_only)
    measures = measure_columns([measure], phantom)
    trend = weekly_trend(rows, dims or {}, measures, measure, as_of, n, date_col, lookback_weeks)
    return trend.orderBy("sort_key", *(dims or {}))


def weekly_species_revenue(invoices: DataFrame, as_of: date, weeks: int = 8) -> DataFrame:
    """Revenue per week and species."""
    rows = P.period_rows(invoices)
    dims = {"species": "patient_species"}
    return weekly_series(rows, dims, measure_columns(["revenue"]), as_of, weeks)


def _weekly_revenue_trend(
    rows: DataFrame, name: str, dim: Column | str, as_of: date, n: int
) -> DataFrame:
    measures = measure_columns(["revenue", "invoice_count"])
    trend = weekly_trend(rows, {name: dim}, measures, "revenue", as_of, n)
    exact = F.col("revenue").cast("decimal(28,2)")
    mean = F.round(F.avg(exact).over(W.partitionBy(name)), 2).cast("double")
    report = trend.withColumns({"avg_revenue": mean, "trend": C.trend_label("growth_pct")})
    return report.orderBy("sort_key", name)


def weekly_species_trend(invoices: DataFrame, as_of: date, n: int = 4) -> DataFrame:
    """Weekly revenue and invoices per species with growth and n-week mean."""
    return _weekly_revenue_trend(
        P.period_rows(invoices), "species", "patient_species", as_of, n
    )


def category_weekly_trend(invoices: DataFrame, as_of: date, n: int = 6) -> DataFrame:
    """Weekly revenue and invoices per category name."""
    return _weekly_revenue_trend(
        P.period_rows(invoices), "category", "plan_category_name", as_of, n
    )


def category_group_weekly(
    invoices: DataFrame,
    as_of: date,
    n: int = 6,
    group_rules: Sequence[rules.Rule] = rules.CATEGORY_GROUP_TREND_RULES,
) -> DataFrame:
    """Weekly revenue and invoices per category group."""
    group = C.category_group("plan_category_name", group_rules)
    return _weekly_revenue_trend(P.period_rows(invoices), "category_group", group, as_of, n)


def life_stage_weekly_trend(
    invoices: DataFrame,
    patients: DataFrame,
    as_of: date,
    n: int = 4,
    stages: Mapping[str, rules.LifeStages] = rules.LIFE_STAGES,
) -> DataFrame:
    """Weekly revenue and clients per species and life stage.

    The weeks are those of all invoices, so the patients are joined once, and
    only to the lines of these weeks.
    """
    dated = P.period_rows(invoices)
    recent = spine_rows(dated, as_of, n, P.SERVICE_DATE)
    rows = staged_lines(recent, patients, stages=stages)
    measures = [*measure_columns(["revenue"]), F.countDistinct("client_id").alias("client_count")]
    dims: dict[str, Column | str] = {"species": "patient_species", "life_stage": "life_stage"}
    trend = week_growth(rows, dims, measures, "revenue")
    return trend.orderBy("sort_key", "species", "life_stage")


def top_categories_weekly(
    invoices: DataFrame,
    as_of: date,
    k: int = 5,
    n: int = 6,
    category: Column | str = "plan_category_name",
) -> DataFrame:
    """The k best categories over the n + 1 weeks, week by week with growth.

    The weekly sums are folded into one row per category, at most n + 1
    entries each; so ranking and output share one pass over the lines. Lines
    without a category are a category of their own, which may take one of the k
    places and is then shown. Only lines up to the reference day count.
    """
    recent = spine_rows(P.period_rows(invoices), as_of, n, P.SERVICE_DATE)
    keyed, _ = with_dims(recent, {"category": category})
    in_spine = keyed.groupBy("week", "prev_week", "category").agg(
        F.sum("total").alias("amount"), F.countDistinct("invoice_id").alias("invoice_count")
    )
    entry = F.struct("week", "prev_week", F.col("amount").cast("double").alias("revenue"), "invoice_count")
    best = (
        in_spine.groupBy("category")
        .agg(F.sum("amount").alias("all_weeks"), F.collect_list(entry).alias("entries"))
        .orderBy(F.desc("all_weeks"), F.asc("category"))
        .limit(k)
    )
    series = best.select("category", F.inline("entries"))
    grown = with_growth(series, ["category"], "revenue", F.col("prev_week"), "week")
    shown = drop_baseline(grown)
    kept = ["category", "revenue", "invoice_count", "prev_revenue", "change_amount", "growth_pct"]
    return shown.select(*week_columns(), *kept).orderBy("sort_key", F.desc("revenue"), "category")


# --- months ----------------------------------------------------------------


def monthly_series(
    rows: DataFrame,
    dims: dict[str, Column | str],
    measures: Sequence[Column],
    date_col: str = P.SERVICE_DATE,
) -> DataFrame:
    """Measures per calendar month and dimensions."""
    keyed, names = with_dims(rows.withColumn("month", C.month_start(date_col)), dims)
    sums = keyed.groupBy("month", *names).agg(*measures)
    kept = [c for c in sums.columns if c != "month"]
    return sums.select(
        C.month_key("month").alias("sort_key"), C.month_label("month").alias("month_label"), *kept
    )


def monthly_revenue(
    invoices: DataFrame,
    period: P.Period | None = None,
    date_col: str = P.SERVICE_DATE,
    active_only: bool = True,
) -> DataFrame:
    """Revenue per calendar month."""
    rows = P.period_rows(invoices, period, date_col, active_only)
    series = monthly_series(rows, {}, measure_columns(["revenue"]), date_col)
    key = F.col("sort_key")
    return series.select(
        F.floor(key / 100).cast("int").alias("year_num"),
        (key % 100).alias("month_num"),
        "sort_key",
        "month_label",
        "revenue",
    ).orderBy("sort_key")


def month_vs_previous(
    invoices: DataFrame, year: int, month: int, n: int = 3, date_col: str = P.SERVICE_DATE
) -> DataFrame:
    """A month and the n before it, each with growth on its month before.

    One more month is read as the baseline; the report has n + 1 months.
    """
    current = P.month(year, month)
    period = P.Period(P.add_months(current.start, -(n + 1)), current.end)
    rows = P.period_rows(invoices, period, date_col).withColumn("month", C.month_start(date_col))
    sums = rows.groupBy("month").agg(*measure_columns(["revenue"]))
    grown = with_growth(sums, [], "revenue", F.add_months("month", -1), "month")
    shown = drop_baseline(grown).select(
        C.month_key("month").alias("sort_key"),
        C.month_label("month").alias("month_label"),
        "revenue",
        "prev_revenue",
        "change_amount",
        "growth_pct",
        C.trend_label("growth_pct").alias("trend"),
    )
    return shown.orderBy("sort_key")


def compare_periods(
    invoices: DataFrame,
    current: P.Period,
    prior: P.Period,
    dims: dict[str, Column | str],
    date_col: str = P.SERVICE_DATE,
) -> DataFrame:
    """Revenue of two periods side by side per dimension, in one scan."""
    span = P.Period(min(current.start, prior.start), max(current.end, prior.end))
    rows, names = with_dims(P.period_rows(invoices, span, date_col), dims)
    total = F.col("total")

    def part(period: P.Period) -> Column:
        hit = F.sum(F.when(P.in_period(date_col, period), total))
        return F.coalesce(hit.cast("double"), F.lit(0.0))

    in_either = P.in_period(date_col, current) | P.in_period(date_col, prior)
    report = rows.filter(in_either).groupBy(*names).agg(
        part(current).alias("revenue"), part(prior).alias("prev_revenue")
    )
    change = F.round(F.col("revenue") - F.col("prev_revenue"), 2)
    return report.withColumns(
        {"change_amount": change, "growth_pct": C.growth_pct("revenue", "prev_revenue")}
    ).orderBy(F.desc("revenue"), *names)


def _ranked(rows: DataFrame, name: str, dim: Column | str) -> DataFrame:
    keyed, _ = with_dims(rows, {name: dim})
    report = keyed.groupBy(name).agg(*measure_columns(["revenue", "invoice_count"]))
    return report.orderBy(F.desc("revenue"), name)


def species_for_month(invoices: DataFrame, year: int, month: int) -> DataFrame:
    """Revenue and invoices per species in a month."""
    rows = P.period_rows(invoices, P.month(year, month))
    return _ranked(rows, "species", "patient_species")


def species_monthly_trend(invoices: DataFrame, as_of: date, n: int = 6) -> DataFrame:
    """Revenue and invoices per species over complete months."""
    rows = P.period_rows(invoices, P.complete_months(as_of, n))
    measures = measure_columns(["revenue", "invoice_count"])
    trend = monthly_series(rows, {"species": "patient_species"}, measures)
    return trend.orderBy("sort_key", "species")


def category_revenue(invoices: DataFrame, period: P.Period | None) -> DataFrame:
    """Revenue and invoices per category name."""
    return _ranked(P.period_rows(invoices, period), "category", "plan_category_name")


def logical_category_revenue(invoices: DataFrame, period: P.Period | None) -> DataFrame:
    """Revenue and invoices per consolidated category."""
    category = C.logical_category("plan_category_name")
    return _ranked(P.period_rows(invoices, period), "category", category)


def category_group_snapshot(
    invoices: DataFrame,
    period: P.Period | None,
    group_rules: Sequence[rules.Rule] = rules.CATEGORY_GROUP_RULES,
) -> DataFrame:
    """Revenue and invoices per category group."""
    group = C.category_group("plan_category_name", group_rules)
    return _ranked(P.period_rows(invoices, period), "category_group", group)


def category_monthly_trend(
    invoices: DataFrame,
    as_of: date,
    n: int = 6,
    complete_start: bool = False,
    complete_end: bool = False,
) -> DataFrame:
    """Monthly revenue and invoices per category name; see ``recent_months``."""
    measures = measure_columns(["revenue", "invoice_count"])
    rows = P.period_rows(invoices, P.recent_months(as_of, n, complete_start, complete_end))
    trend = monthly_series(rows, {"category": "plan_category_name"}, measures)
    return trend.orderBy("sort_key", "category")


def category_group_monthly(
    invoices: DataFrame,
    as_of: date,
    n: int = 6,
    group_rules: Sequence[rules.Rule] = rules.CATEGORY_GROUP_TREND_RULES,
    complete_start: bool = False,
    complete_end: bool = False,
) -> DataFrame:
    """Monthly revenue per category group; see ``recent_months``."""
    group = C.category_group("plan_category_name", group_rules)
    rows = P.period_rows(invoices, P.recent_months(as_of, n, complete_start, complete_end))
    trend = monthly_series(rows, {"category_group": group}, measure_columns(["revenue"]))
    return trend.orderBy("sort_key", F.desc("revenue"), "category_group")


# --- single figures and dimensions -----------------------------------------


def gross_revenue(invoices: DataFrame, period: P.Period | None = None) -> DataFrame:
    """Revenue with cancelled lines; one row."""
    rows = P.period_rows(invoices, period, active_only=False) if period else invoices
    return rows.agg(F.sum("total").cast("double").alias("gross_revenue"))


def active_revenue(invoices: DataFrame, period: P.Period | None = None) -> DataFrame:
    """Revenue without cancelled lines; one row."""
    rows = P.period_rows(invoices, period) if period else P.active(invoices)
    return rows.agg(F.sum("total").cast("double").alias("active_revenue"))


def invoice_count(invoices: DataFrame, period: P.Period | None = None) -> DataFrame:
    """Distinct invoices without cancelled ones; one row."""
    rows = P.period_rows(invoices, period) if period else P.active(invoices)
    return rows.agg(*measure_columns(["invoice_count"]))


def patient_count(invoices: DataFrame, period: P.Period | None = None) -> DataFrame:
    """Distinct patients; one row."""
    rows = P.period_rows(invoices, period, active_only=False) if period else invoices
    return rows.agg(*measure_columns(["patient_count"]))


def customer_count(
    invoices: DataFrame, period: P.Period | None = None, phantom: str = rules.PHANTOM_CLIENT
) -> DataFrame:
    """Distinct real clients; one row."""
    rows = P.period_rows(invoices, period, active_only=False) if period else invoices
    return rows.agg(*measure_columns(["customer_count"], phantom))


def by_clinic(
    invoices: DataFrame,
    measures: Sequence[str],
    period: P.Period | None = None,
    phantom: str = rules.PHANTOM_CLIENT,
) -> DataFrame:
    """Any measures per clinic.

    Lines are added up per clinic, invoice, client and patient first, so that
    distinct counts do not multiply the lines.
    """
    keys = ["clinic_id", "invoice_id", "client_id", "patient_id"]
    lines = P.period_rows(invoices, period).groupBy(*keys)
    rows = lines.agg(F.sum("total").alias("total"), F.sum("quantity").alias("quantity"))
    report = rows.groupBy("clinic_id").agg(*measure_columns(measures, phantom))
    return report.orderBy("clinic_id")


def clinic_revenue_with_zero(
    clinics: DataFrame, invoices: DataFrame, period: P.Period | None = None
) -> DataFrame:
    """Every clinic, also those without an invoice."""
    sums = by_clinic(invoices, ["revenue", "invoice_count"], period)
    report = clinics.join(sums, "clinic_id", "left").select(
        "clinic_id",
        "clinic_name",
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.coalesce("invoice_count", F.lit(0)).alias("invoice_count"),
    )
    return report.orderBy("clinic_id")


def top_customers(
    invoices: DataFrame, period: P.Period, k: int = 10, phantom: str = rules.PHANTOM_CLIENT
) -> DataFrame:
    """The k real clients with the highest revenue."""
    rows = P.exclude_phantom(P.period_rows(invoices, period), phantom=phantom)
    spent = rows.groupBy(F.col("client_id").alias("customer_id")).agg(F.sum("total").alias("revenue"))
    best = spent.orderBy(F.desc("revenue"), "customer_id").limit(k)
    return best.select("customer_id", F.col("revenue").cast("double").alias("revenue"))
