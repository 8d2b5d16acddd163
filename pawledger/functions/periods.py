"""Reporting periods and the predicates built from them.

Bounds are computed on the driver from an explicit reference date and applied
as half-open ranges on the bare column, so that they reach the scan as pushed
filters. Nothing here reads the clock.
"""

from __future__ import annotations

import calendar
from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawledger.functions.rules import PHANTOM_CLIENT

SERVICE_DATE = "performed_date"
BILLING_DATE = "invoice_date"
#: Partition column of a stored fact: year * 100 + month of the service date.
SERVICE_MONTH = "performed_month"


class Period(NamedTuple):
    """Half-open date range; an open side is None."""

    start: date | None
    end: date | None


# --- bounds ----------------------------------------------------------------


def parse_date(value: date | str) -> date:
    return date.fromisoformat(value) if isinstance(value, str) else value


def add_months(d: date, months: int) -> date:
    """Same day of another month, clipped to that month's length."""
    index = d.year * 12 + d.month - 1 + months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(d.day, calendar.monthrange(year, month + 1)[1]))


def first_of_month(d: date) -> date:
    return d.replace(day=1)


def day(d: date) -> Period:
    return Period(d, d + timedelta(days=1))


def month(year: int, month_num: int) -> Period:
    start = date(year, month_num, 1)
    return Period(start, add_months(start, 1))


def year(year_num: int) -> Period:
    return Period(date(year_num, 1, 1), date(year_num + 1, 1, 1))


def year_to_date(as_of: date) -> Period:
    return Period(date(as_of.year, 1, 1), as_of + timedelta(days=1))


def quarter(year_num: int, quarter_num: int) -> Period:
    start = date(year_num, 3 * quarter_num - 2, 1)
    return Period(start, add_months(start, 3))


def inclusive(start: date | str, end: date | str) -> Period:
    """Range given by its first and last day."""
    return Period(parse_date(start), parse_date(end) + timedelta(days=1))


def week_of(d: date) -> Period:
    """ISO week that holds the day."""
    monday = d - timedelta(days=d.weekday())
    return Period(monday, monday + timedelta(weeks=1))


def week_label(d: date) -> str:
    """``Mon dd – Mon dd, yyyy`` of the ISO week that holds the day."""
    week = week_of(d)
    sunday = week.end - timedelta(days=1)
    return f"{week.start:%b %d} – {sunday:%b %d, %Y}"


def weeks_back(as_of: date, n: int) -> date:
    return as_of - timedelta(weeks=n)


def days_back(as_of: date, n: int) -> date:
    return as_of - timedelta(days=n)


def months_back(as_of: date, n: int) -> date:
    return add_months(as_of, -n)


def up_to(as_of: date, start: date | None = None) -> Period:
    """From a start, or from the first row on, to the end of the reference day."""
    return Period(start, as_of + timedelta(days=1))


def recent_months(
    as_of: date, n: int, complete_start: bool = False, complete_end: bool = False
) -> Period:
    """From the same day n months ago to the reference day.

    ``complete_start`` begins with the first of that month, ``complete_end``
    leaves the current month out.
    """
    start = months_back(as_of, n)
    first = first_of_month(start) if complete_start else start
    return Period(first, first_of_month(as_of) if complete_end else up_to(as_of).end)


def complete_months(as_of: date, n: int) -> Period:
    """The last n calendar months, without the current one."""
    end = first_of_month(as_of)
    return Period(add_months(end, -n), end)


def last_complete_month(as_of: date) -> Period:
    return complete_months(as_of, 1)


def resolve_named_month(as_of: date, month_num: int) -> Period:
    """A named month of this year, or of last year if it still lies ahead."""
    this_year = month_num <= as_of.month
    return month(as_of.year if this_year else as_of.year - 1, month_num)


def previous_months(anchor: date, n: int) -> Period:
    """The n calendar months just before the anchor's month."""
    return complete_months(anchor, n)


# --- predicates ------------------------------------------------------------


def in_range(column: str, start: date | None = None, end: date | None = None) -> Column:
    """``start <= column < end``; an open side is left out."""
    c = F.col(column)
    result = c.isNotNull()
    if start is not None:
        result = result & (c >= F.lit(start))
    if end is not None:
        result = result & (c < F.lit(end))
    return result


def in_period(column: str, period: Period | None) -> Column:
    return in_range(column, *(period or (None, None)))


def in_months(period: Period) -> Column:
    """The months that a period touches, on the partition column of a stored fact."""
    result = F.lit(True)
    if period.start is not None:
        result = result & (F.col(SERVICE_MONTH) >= _month_number(period.start))
    if period.end is not None:
        last = period.end - timedelta(days=1)
        result = result & (F.col(SERVICE_MONTH) <= _month_number(last))
    return result


def _month_number(d: date) -> int:
    return 100 * d.year + d.month


def dated(rows: DataFrame, date_col: str, period: Period | None) -> DataFrame:
    """Rows of a period. Of a fact stored by month of service only its months are read."""
    found = rows.filter(in_period(date_col, period))
    by_month = date_col == SERVICE_DATE and SERVICE_MONTH in rows.columns
    return found.filter(in_months(period)) if period and by_month else found


def active(df: DataFrame) -> DataFrame:
    """Rows that were not cancelled."""
    return df.filter(F.col("cancelled") == 0)


def exclude_phantom(
    df: DataFrame, null_safe: bool = False, phantom: str = PHANTOM_CLIENT
) -> DataFrame:
    """Rows of real clients; ``null_safe`` keeps rows without a client."""
    client = F.col("client_id")
    return df.filter(~client.eqNullSafe(phantom) if null_safe else client != phantom)


def period_rows(
    invoices: DataFrame,
    period: Period | None = None,
    date_col: str = SERVICE_DATE,
    active_only: bool = True,
) -> DataFrame:
    """Invoice lines of a period: the common base of the ad-hoc reports."""
    rows = active(invoices) if active_only else invoices
    return dated(rows, date_col, period)
