"""Reusable ``Column`` builders: buckets, ages, calendar keys, growth.

All of them are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pawledger.functions import rules

MICROS_PER_DAY = 86_400_000_000
WHITESPACE = " \t\r\n"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers ---------------------------------------------------------------


def nonneg(quantity: Column | str) -> Column:
    """NULL and negative quantities count as zero."""
    q = as_column(quantity)
    return F.greatest(F.coalesce(q, F.lit(0).cast("decimal(18,3)")), F.lit(0).cast("decimal(18,3)"))


def to_number_or_zero(c: Column | str, decimal_type: str = "decimal(18,2)") -> Column:
    """Unreadable or missing numbers count as zero."""
    return F.coalesce(as_column(c).try_cast(decimal_type), F.lit(0).cast(decimal_type))


def growth_pct(current: Column | str, prior: Column | str, half_even: bool = False) -> Column:
    """Change against ``prior`` in per cent, one decimal; NULL without a prior.

    ``half_even`` selects the dashboard's rounding, otherwise SQL's half-up.
    """
    c, p = as_column(current).cast("double"), as_column(prior).cast("double")
    value = 100.0 * (c - p) / F.nullif(p, F.lit(0.0))
    return F.bround(value, 1) if half_even else F.round(value, 1)


def trend_label(growth: Column | str, threshold: float = rules.TREND_THRESHOLD) -> Column:
    """Direction wording; NULL growth has no direction."""
    g = as_column(growth)
    up, down, flat = rules.TREND_LABELS
    return F.when(g > threshold, up).when(g < -threshold, down).when(g.isNotNull(), flat)


# --- calendar --------------------------------------------------------------


def week_start(ts: Column | str) -> Column:
    """Monday of the ISO week, as a date."""
    return F.trunc(F.to_date(as_column(ts)), "week")


def month_start(ts: Column | str) -> Column:
    return F.trunc(F.to_date(as_column(ts)), "month")


def yearweek(ts: Column | str) -> Column:
    """ISO year * 100 + ISO week."""
    d = F.to_date(as_column(ts))
    return F.extract(F.lit("YEAROFWEEK"), d) * 100 + F.weekofyear(d)


def iso_week_label(ts: Column | str) -> Column:
    """``YYYY-WW``, sortable as text."""
    d = F.to_date(as_column(ts))
    year = F.lpad(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), 4, "0")
    return F.concat(year, F.lit("-"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def week_range(ts: Column | str) -> Column:
    """``dd Mon yyyy - dd Mon yyyy`` of the ISO week."""
    monday = week_start(ts)
    return F.concat(
        F.date_format(monday, "dd MMM yyyy"),
        F.lit(" - "),
        F.date_format(F.date_add(monday, 6), "dd MMM yyyy"),
    )


def week_label(ts: Column | str) -> Column:
    """``Mon dd – Mon dd, yyyy`` of the ISO week."""
    monday = week_start(ts)
    return F.concat(
        F.date_format(monday, "MMM dd"),
        F.lit(" – "),
        F.date_format(F.date_add(monday, 6), "MMM dd, yyyy"),
    )


def month_key(ts: Column | str) -> Column:
    c = as_column(ts)
    return F.year(c) * 100 + F.month(c)


def month_label(ts: Column | str) -> Column:
    return F.date_format(F.to_date(as_column(ts)), "yyyy-MM")


def time_band(ts: Column | str, hours: tuple[int, int] = rules.DAY_HOURS) -> Column:
    first, last = hours
    hour = F.hour(as_column(ts))
    return F.when((hour >= first) & (hour < last), rules.DAY_LABEL).otherwise(rules.NIGHT_LABEL)


# --- ages ------------------------------------------------------------------


def age_months(birth: Column | str, ts: Column | str) -> Column:
    """Whole calendar months between a birth date and a visit."""
    return F.timestamp_diff("MONTH", as_column(birth), F.to_date(as_column(ts))).cast("int")


def age_months_approx(birth: Column | str, ts: Column | str) -> Column:
    """Elapsed time in mean months of 30.44 days, truncated towards zero.

    Day and time of day are counted separately, so that the session's time
    zone never enters the difference.
    """
    t = as_column(ts)
    seconds = F.hour(t) * 3600 + F.minute(t) * 60
    micros = (
        F.date_diff(F.to_date(t), as_column(birth)).cast("bigint") * MICROS_PER_DAY
        + seconds.cast("bigint") * 1_000_000
        + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    )
    return (micros / F.lit(rules.MEAN_MONTH_DAYS * MICROS_PER_DAY)).cast("int")


def life_stage(
    species: Column | str,
    age: Column | str,
    by_species: Mapping[str, rules.LifeStages] = rules.LIFE_STAGES,
) -> Column:
    """Stage by species and age in months; NULL for other species or no age."""
    s, a = as_column(species), as_column(age)
    result = F.lit(None).cast("string")
    for name, stages in by_species.items():
        stage = (
            F.when(a < stages.adult_from, stages.young)
            .when(a < stages.senior_from, "Adult")
            .when(a.isNotNull(), "Senior")
        )
        result = F.when(s == name, stage).otherwise(result)
    return result


# --- names and buckets -----------------------------------------------------


def clean_name(c: Column | str) -> Column:
    """Lower-case name without surrounding blanks, for matching dirty names."""
    return F.lower(F.btrim(as_column(c), F.lit(WHITESPACE)))


def like_any(c: Column | str, patterns: Iterable[str]) -> Column:
    """True if the cleaned name matches one of the LIKE patterns."""
    name = clean_name(c)
    matched = F.lit(False)
    for pattern in patterns:
        matched = matched | name.like(pattern.lower())
    return matched


def bucket_by_rules(
    c: Column | str, bucket_rules: Sequence[rules.Rule], otherwise: Column | str | None
) -> Column:
    """First matching rule's label; names and patterns match case-insensitively."""
    name = clean_name(c)
    result = None
    for rule in bucket_rules:
        hit = F.lit(False)
        if rule.names:
            hit = hit | name.isin([n.lower() for n in rule.names])
        if rule.patterns:
            hit = hit | like_any(c, rule.patterns)
        result = F.when(hit, rule.label) if result is None else result.when(hit, rule.label)
    rest = F.lit(otherwise) if otherwise is None or isinstance(otherwise, str) else otherwise
    return rest if result is None else result.otherwise(rest)


def category_group(
    c: Column | str, bucket_rules: Sequence[rules.Rule] = rules.CATEGORY_GROUP_RULES
) -> Column:
    """Five revenue groups of invoice categories."""
    return bucket_by_rules(c, bucket_rules, "Other")


def stock_group(
    c: Column | str, bucket_rules: Sequence[rules.Rule] = rules.STOCK_GROUP_RULES
) -> Column:
    """Pharmacy, Food, Pet Shop or Other."""
    return bucket_by_rules(c, bucket_rules, "Other")


def logical_category(
    c: Column | str, bucket_rules: Sequence[rules.Rule] = rules.LOGICAL_CATEGORY_RULES
) -> Column:
    """Name variants collapsed into one label; other names only trimmed."""
    return bucket_by_rules(c, bucket_rules, F.btrim(as_column(c), F.lit(WHITESPACE)))


def inventory_bucket(c: Column | str) -> Column:
    """Food, Pharmacy or Non-Food; exact, case-sensitive names."""
    name = F.btrim(F.coalesce(as_column(c), F.lit("")), F.lit(WHITESPACE))
    pharmacy = name.isin(list(rules.INVENTORY_PHARMACY_NAMES))
    for prefix in rules.INVENTORY_PHARMACY_PREFIXES:
        pharmacy = pharmacy | name.startswith(prefix)
    return (
        F.when(name.isin(list(rules.INVENTORY_FOOD_NAMES)), "Food")
        .when(pharmacy, "Pharmacy")
        .otherwise("Non-Food")
    )


def species_bucket(c: Column | str) -> Column:
    """Main species by name; everything else, NULL included, as exotics."""
    s = as_column(c)
    return F.when(s.isin(list(rules.MAIN_SPECIES)), s).otherwise(rules.OTHER_SPECIES)


# --- text ------------------------------------------------------------------


def fmt_inr(v: Column | str) -> Column:
    """Rupees with Indian digit grouping; the sign is dropped."""
    digits = F.bround(F.abs(as_column(v)), 0).cast("decimal(38,0)").cast("string")
    head = F.regexp_replace(digits, r"\d{3}$", "")
    tail = F.right(digits, F.lit(3))
    grouped = F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ",")
    return F.when(F.length(digits) <= 3, F.concat(F.lit("₹"), digits)).otherwise(
        F.concat(F.lit("₹"), grouped, F.lit(","), tail)
    )


def fmt_short(v: Column | str) -> Column:
    """Rupees in crore or lakh."""
    x = as_column(v).cast("double")
    return (
        F.when(F.abs(x) >= 10_000_000, F.format_string("₹%.2fCr", x / 10_000_000))
        .when(F.abs(x) >= 100_000, F.format_string("₹%.1fL", x / 100_000))
        .when(x.isNotNull(), F.concat(F.lit("₹"), F.format_number(x, 0)))
    )


def fmt_pct(v: Column | str) -> Column:
    """Signed per cent text; a dash where the value is undefined."""
    x = as_column(v).cast("double")
    return F.when(x.isNotNull(), F.format_string("%+.1f%%", x)).otherwise(F.lit("—"))
