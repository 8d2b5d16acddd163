"""The weekly dashboard: all metrics, their tidy form and the headline."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from pawledger.functions import columns as C
from pawledger.functions import periods as P
from pawledger.functions import rules
from pawledger.operators import inventory, weekly
from pawledger.plans import cube
from pawledger.sources import scans


# The metrics that the long form and the headline are made of.
TIDY_METRICS = (
    "total_sales",
    "species_sales",
    "category_top",
    "invoice_count_by_species",
    "day_night_split",
    "life_stage_metrics",
    "inventory_value",
    "new_vs_existing_revenue",
)
HEADLINE_METRICS = ("total_sales", "repeat_customers", "inventory_value")


def week_fact(
    invoices: DataFrame, ws: date, we: date, prior_weeks: int = weekly.PRIOR_WEEKS
) -> DataFrame:
    """The lines every metric of a week reads: the week and the weeks before."""
    period = P.inclusive(P.weeks_back(ws, prior_weeks), we)
    return scans.scan_invoices(invoices, *period)


def weekly_dashboard(
    invoices: DataFrame,
    clients: DataFrame,
    patients: DataFrame,
    stocks: DataFrame,
    ws: date,
    we: date,
    prior_weeks: int = weekly.PRIOR_WEEKS,
    top_n: int = 5,
    phantom_patterns: Sequence[str] = rules.PHANTOM_STOCK_PATTERNS,
    only: Collection[str] | None = None,
    persist: bool = False,
    phantom: str = rules.PHANTOM_CLIENT,
    hours: tuple[int, int] = rules.DAY_HOURS,
    stages: Mapping[str, rules.LifeStages] = rules.LIFE_STAGES,
    folder: str | None = None,
    known: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The metrics of a week as lazy DataFrames over one filtered fact.

    ``only`` names the metrics to build, by default all of them. With
    ``persist`` the fact, a few weeks of seven columns, is kept between the
    metrics' actions; it is returned as ``_fact`` for ``unpersist``.

    With ``folder`` the weeks are read once, now, and their added-up lines are
    stored there (``cube.write_cube``); all metrics read those. The repeat
    customers still ask the history before the week, but for ``known``, the ids
    of clients known before it (``history.known_clients``).
    """
    fact = week_fact(invoices, ws, we, prior_weeks)
    if persist:
        fact = fact.persist(StorageLevel.MEMORY_AND_DISK)
    end = P.inclusive(ws, we).end
    new_ids = scans.new_clients(clients, ws, end, phantom)
    asked = scans.scan_invoices(invoices, ws, end).select("client_id")
    lines = {name: fact for name in cube.PART_OF}
    if folder is not None:
        parts = {cube.PART_OF[m] for m in cube.PART_OF if only is None or m in only}
        stored = cube.write_cube(fact, folder, ws, we, prior_weeks, parts) if parts else None
        lines = {m: cube.part(stored, p) for m, p in cube.PART_OF.items() if p in parts}
        asked = lines.get("repeat_customers", asked).select("client_id")
    if known is None:
        known = scans.prior_clients(clients, invoices, ws, phantom, among=asked)
    births = scans.scan_patients(patients)
    stock = scans.scan_stocks(stocks, phantom_patterns)
    week = (ws, we)
    builders = {
        "total_sales": lambda: weekly.total_sales(lines["total_sales"], *week, prior_weeks),
        "repeat_customers": lambda: weekly.repeat_customers(lines["repeat_customers"], known, *week, phantom),
        "species_sales": lambda: weekly.species_sales(lines["species_sales"], *week, prior_weeks),
        "category_top": lambda: weekly.category_top_n(lines["category_top"], *week, top_n, prior_weeks),
        "invoice_count_by_species": lambda: weekly.invoice_count_by_species(
            lines["invoice_count_by_species"], *week, prior_weeks
        ),
        "day_night_split": lambda: weekly.day_night_split(lines["day_night_split"], *week, prior_weeks, hours),
        "new_vs_existing_customers": lambda: weekly.new_vs_existing_customers(
            lines["new_vs_existing_customers"], new_ids, *week, phantom
        ),
        "new_vs_existing_revenue": lambda: weekly.new_vs_existing_revenue(
            lines["new_vs_existing_revenue"], new_ids, *week, phantom
        ),
        "inventory_value": lambda: inventory.inventory_value(stock),
        "life_stage_metrics": lambda: weekly.life_stage_metrics(lines["life_stage_metrics"], births, *week, stages),
    }
    metrics = {name: builders[name]() for name in builders if only is None or name in only}
    if persist:
        metrics["_fact"] = fact
    return metrics


def _section(
    df: DataFrame,
    section: Column | str,
    label: Column,
    this_week: str,
    sub_label: Column | None = None,
    prior: str | None = None,
    growth: str | None = None,
    share: Column | str | None = None,
) -> DataFrame:
    """One metric as long rows; growth and share as fractions."""

    def fraction(column: Column | str | None) -> Column:
        if column is None:
            return F.lit(0.0)
        c = F.col(column) if isinstance(column, str) else column
        return F.coalesce(c, F.lit(0.0)) / 100

    return df.select(
        (F.lit(section) if isinstance(section, str) else section).alias("section"),
        label.alias("label"),
        (F.lit("") if sub_label is None else sub_label).alias("sub_label"),
        F.col(this_week).cast("double").alias("this_week"),
        (F.lit(None) if prior is None else F.col(prior)).cast("double").alias("prior_avg"),
        fraction(growth).alias("growth"),
        fraction(share).alias("share"),
    )


def tidy_dashboard(metrics: Mapping[str, DataFrame]) -> DataFrame:
    """Every figure of the dashboard as one long table, for export.

    Customer counts are not part of it.
    """
    compared = {"prior": "prior_3wk_avg", "growth": "growth_pct", "share": "pct_contribution"}
    revenue = metrics["new_vs_existing_revenue"]
    split = revenue.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(kind).alias("label"),
                        F.col(f"{kind.lower()}_revenue").alias("value"),
                        F.col(f"{kind.lower()}_pct").alias("pct"),
                    )
                    for kind in ("New", "Existing")
                ]
            )
        )
    )
    sections = [
        _section(
            metrics["total_sales"],
            "Revenue",
            F.lit("Total Sales"),
            "value",
            prior="prior_value",
            growth="variance_pct",
            share=F.lit(100.0),
        ),
        _section(
            metrics["species_sales"], "Species", F.col("species"), "this_week_revenue", **compared
        ),
        _section(
            metrics["category_top"], "Category", F.col("category"), "this_week_revenue", **compared
        ),
        _section(
            metrics["invoice_count_by_species"], "Bills", F.col("species"), "bill_count", **compared
        ),
        _section(
            metrics["day_night_split"], "Day/Night", F.col("time_band"), "revenue", **compared
        ),
        _section(
            metrics["life_stage_metrics"],
            "Life Stage",
            F.col("species"),
            "revenue",
            sub_label=F.col("life_stage"),
        ),
        _section(
            metrics["inventory_value"],
            "Inventory",
            F.col("inventory_type"),
            "stock_value",
            share="pct_of_total",
        ),
        _section(split, "Customers", F.col("label"), "value", share="pct"),
    ]
    tidy = sections[0]
    for section in sections[1:]:
        tidy = tidy.unionByName(section)
    return tidy


def tidy_week(
    invoices: DataFrame,
    clients: DataFrame,
    patients: DataFrame,
    stocks: DataFrame,
    ws: date,
    we: date,
    prior_weeks: int = weekly.PRIOR_WEEKS,
    top_n: int = 5,
    phantom_patterns: Sequence[str] = rules.PHANTOM_STOCK_PATTERNS,
    phantom: str = rules.PHANTOM_CLIENT,
    hours: tuple[int, int] = rules.DAY_HOURS,
    stages: Mapping[str, rules.LifeStages] = rules.LIFE_STAGES,
) -> DataFrame:
    """The rows of ``tidy_dashboard`` with two scans of the fact.

    One scan adds up the compared weeks by grouping sets, the other the week
    itself by client and life stage; all else works on report rows.
    """
    fact = week_fact(invoices, ws, we, prior_weeks)
    end = P.inclusive(ws, we).end
    stock = _section(
        inventory.inventory_value(scans.scan_stocks(stocks, phantom_patterns)),
        "Inventory",
        F.col("inventory_type"),
        "stock_value",
        share="pct_of_total",
    )
    new_ids = scans.new_clients(clients, ws, end, phantom)
    births = scans.scan_patients(patients)
    sections = [
        _compared_sections(fact, ws, we, prior_weeks, top_n, hours),
        _client_sections(fact, new_ids, births, ws, we, phantom, stages),
    ]
    tidy = stock
    for section in sections:
        tidy = tidy.unionByName(section)
    return tidy


def _entries(rows: DataFrame, *entries: Column) -> DataFrame:
    """One row per non-NULL struct."""
    return rows.select(F.inline(F.array_compact(F.array(*entries))))


def _seed(df: DataFrame, **values: Column) -> DataFrame:
    """One constant row with the columns of a table, so that a section is never missing."""
    cells = [values[f.name].cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.sparkSession.range(1).select(*cells)


def _compared_sections(
    fact: DataFrame, ws: date, we: date, prior_weeks: int, top_n: int, hours: tuple[int, int]
) -> DataFrame:
    rows = weekly.window_rows(fact, ws, we, prior_weeks).select(
        "week_bucket",
        F.col("patient_species").alias("species"),
        "invoice_id",
        F.col("plan_category_name").alias("category"),
        C.time_band(P.SERVICE_DATE, hours).alias("band"),
        F.to_date(P.SERVICE_DATE).alias("day"),
        "total",
    )
    sets = [["species", "invoice_id"], ["category"], ["band"], ["day"]]
    keys = ["week_bucket", *(c for s in sets for c in s)]
    sums = rows.groupingSets([["week_bucket", *s] for s in sets], *keys).agg(
        F.sum("total").alias("total"),
        *[F.grouping(c).alias(f"no_{c}") for c in ("species", "category", "band", "day")],
    )

    def entry(column: str, section: str, label: Column, value: Column) -> Column:
        fields = F.struct(
            "week_bucket",
            F.lit(section).alias("section"),
            label.alias("label"),
            value.cast("decimal(28,2)").alias("value"),
        )
        return F.when((F.col(f"no_{column}") == 0) & label.isNotNull(), fields)

    one, total = F.lit(1), F.col("total")
    entries = _entries(
        sums,
        entry("species", "Species", F.col("species"), total),
        F.when(F.col("invoice_id").isNotNull(), entry("species", "Bills", F.col("species"), one)),
        entry("category", "Category", F.col("category"), total),
        entry("band", "Day/Night", F.col("band"), total),
        entry("day", "Revenue", F.lit("Total Sales"), total),
    )
    zero = _seed(
        entries,
        week_bucket=F.lit(ws),
        section=F.lit("Revenue"),
        label=F.lit("Total Sales"),
        value=F.lit(0),
    )
    weekly_sums = entries.unionByName(zero).groupBy("section", "label", "week_bucket").agg(
        F.sum("value").alias("value")
    )
    compared = weekly.prior_weekly_avg(weekly_sums, ["section", "label"], ws)
    best = W.partitionBy("section").orderBy(F.desc("has_current"), F.desc("this_week"), "label")
    ranked = compared.withColumn("rank", F.row_number().over(best))
    shown = ranked.filter(
        (F.col("section") != "Category") | (F.col("has_current") & (F.col("rank") <= top_n))
    )
    section = F.col("section")
    share = weekly.share_of_total("this_week", "section")
    prior = F.when(section == "Bills", F.bround("prior_avg", 1)).otherwise(F.bround("prior_avg", 0))
    report = shown.select(
        "section",
        "label",
        F.bround(F.col("this_week").cast("double"), 0).alias("this_week"),
        prior.alias("prior"),
        C.growth_pct("this_week", "prior_avg", half_even=True).alias("growth"),
        F.when(section == "Revenue", F.lit(100.0)).otherwise(share).alias("share"),
    )
    return _section(
        report, section, F.col("label"), "this_week", prior="prior", growth="growth", share="share"
    )


def _client_sections(
    fact: DataFrame,
    new_ids: DataFrame,
    births: DataFrame,
    ws: date,
    we: date,
    phantom: str,
    stages: Mapping[str, rules.LifeStages],
) -> DataFrame:
    """The week by life stage and by customer type, over one scan."""
    species = F.col("patient_species")
    aged = weekly.week_rows(fact, ws, we).join(births, "patient_id", "left")
    age = C.age_months_approx("birth_date", P.SERVICE_DATE)
    stage = F.when(F.col("birth_date").isNotNull(), C.life_stage(species, age, stages))
    sums = aged.groupBy("client_id", species.alias("species"), stage.alias("stage")).agg(
        F.sum("total").alias("total")
    )
    flag = new_ids.select("client_id", F.lit(True).alias("is_new"))
    flagged = sums.join(flag, "client_id", "left")
    kind = F.when(F.col("is_new"), "New").otherwise("Existing")

    def entry(section: str, label: Column, sub_label: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            label.alias("label"),
            sub_label.alias("sub_label"),
            F.col("total").alias("value"),
        )

    staged = F.col("species").isin(list(stages)) & F.col("stage").isNotNull()
    client = ~F.col("client_id").eqNullSafe(phantom)
    entries = _entries(
        flagged,
        F.when(staged, entry("Life Stage", F.col("species"), F.col("stage"))),
        F.when(client, entry("Customers", kind, F.lit(""))),
    )
    for label in ("New", "Existing"):
        zero = _seed(
            entries,
            section=F.lit("Customers"),
            label=F.lit(label),
            sub_label=F.lit(""),
            value=F.lit(0),
        )
        entries = entries.unionByName(zero)
    report = entries.groupBy("section", "label", "sub_label").agg(F.sum("value").alias("value"))
    customers = F.col("section") == "Customers"
    total = F.sum("value").over(W.partitionBy("section")).cast("double")
    part = F.bround(100.0 * F.col("value").cast("double") / total, 1)
    report = report.withColumns(
        {
            "this_week": F.bround(F.col("value").cast("double"), 0),
            "pct": F.when(customers, F.when(total != 0, part).otherwise(0.0)).otherwise(0.0),
        }
    )
    return _section(
        report,
        F.col("section"),
        F.col("label"),
        "this_week",
        sub_label=F.col("sub_label"),
        share="pct",
    )


def kpi_headline(metrics: Mapping[str, DataFrame]) -> DataFrame:
    """The header figures; one row.

    The one-row parts are stacked and folded, so nothing is joined.
    """
    sales = metrics["total_sales"].select(
        F.col("value").alias("total_sales"),
        F.col("prior_value").alias("prior_sales"),
        F.col("variance_pct").alias("sales_variance_pct"),
    )
    customers = metrics["repeat_customers"].select(
        "repeat_pct", "repeat_customers", "total_customers", "new_customers"
    )
    kind, value = F.col("inventory_type"), F.col("stock_value")

    def part(name: str) -> Column:
        return F.coalesce(F.sum(F.when(kind == name, value)), F.lit(0.0))

    stock = metrics["inventory_value"].agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("inventory_total"),
        part("Pharmacy").alias("inventory_pharmacy"),
        part("Non-Food").alias("inventory_non_food"),
    )
    stacked = sales.unionByName(customers, allowMissingColumns=True).unionByName(
        stock, allowMissingColumns=True
    )
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def subtotal(
    report: DataFrame,
    dims: Sequence[str],
    sums: Sequence[str],
    fixed: Mapping[str, Column] | None = None,
    label: str = "Total",
) -> DataFrame:
    """A report with a total row under it.

    ``sums`` are added up; ``fixed`` gives the total row's value for columns
    that do not add up (a distinct count, a share); other columns are blank.
    """
    fixed = dict(fixed or {})
    is_total = F.grouping_id() != 0
    others = [c for c in report.columns if c not in (*dims, *sums)]
    cells = [F.sum(c).alias(c) for c in sums] + [
        F.when(is_total, fixed.get(c, F.lit(None))).otherwise(F.max(c)).alias(c) for c in others
    ]
    grouped = report.groupingSets([list(dims), []], *dims).agg(
        *cells, is_total.alias("is_total")
    )
    named = grouped.withColumn(
        dims[0], F.when(F.col("is_total"), label).otherwise(F.col(dims[0]))
    )
    return named.select(*report.columns, "is_total").orderBy("is_total", F.desc(sums[0])).drop("is_total")


def table_totals(metrics: Mapping[str, DataFrame], top_n: int = 5) -> dict[str, DataFrame]:
    """The dashboard's tables with their total rows.

    Shares of a whole table add up to 100; those of the best categories have
    no total. The customers' total counts the week's clients once, so it comes
    from ``repeat_customers`` and not from the rows.
    """
    whole = F.lit(100.0)
    revenue = metrics["new_vs_existing_revenue"]
    segments = revenue.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{kind} Customers").alias("segment"),
                        F.col(f"{kind.lower()}_revenue").alias("revenue"),
                        F.col(f"{kind.lower()}_pct").alias("share"),
                    )
                    for kind in ("New", "Existing")
                ],
                F.struct(
                    F.lit("Total").alias("segment"),
                    F.col("total_revenue").alias("revenue"),
                    whole.alias("share"),
                ),
            )
        )
    )
    customers = metrics["new_vs_existing_customers"]
    everyone = metrics["repeat_customers"].select(
        F.lit("Total").alias("customer_type"), F.col("total_customers").alias("client_count")
    )
    return {
        "species_sales": subtotal(
            metrics["species_sales"], ["species"], ["this_week_revenue"], {"pct_contribution": whole}
        ),
        "category_top": subtotal(
            metrics["category_top"],
            ["category"],
            ["this_week_revenue"],
            label=f"Total (Top {top_n})",
        ),
        "invoice_count_by_species": subtotal(
            metrics["invoice_count_by_species"],
            ["species"],
            ["bill_count"],
            {"pct_contribution": whole},
        ),
        "day_night_split": subtotal(
            metrics["day_night_split"], ["time_band"], ["revenue"], {"pct_contribution": whole}
        ),
        "life_stage_metrics": subtotal(
            metrics["life_stage_metrics"],
            ["species", "life_stage"],
            ["revenue", "invoice_count"],
        ),
        "inventory_value": subtotal(
            metrics["inventory_value"],
            ["inventory_type"],
            ["stock_value"],
            {"pct_of_total": whole},
        ),
        "new_vs_existing_revenue": segments,
        "new_vs_existing_customers": customers.unionByName(everyone, allowMissingColumns=True),
    }
