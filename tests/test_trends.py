from datetime import date, timedelta

from pawledger.functions import periods as P
from pawledger.operators import trends

from conftest import rows

AS_OF = date(2024, 3, 20)
MONDAYS = [date(2024, 3, 18) - timedelta(weeks=i) for i in range(12)]


def line(day, total, **kw):
    base = {"invoice_id": str(day), "client_id": "1", "patient_species": "Canine"}
    return {**base, "performed_date": str(day), "total": total, **kw}


def test_exactly_n_weeks_are_shown(make):
    inv = make("invoices", [line(d, 100 + i) for i, d in enumerate(MONDAYS)])
    for n in (1, 4, 6):
        assert trends.weekly_kpi(inv, "revenue", AS_OF, n).count() == n


def test_spine_uses_weeks_with_rows_only(make):
    # Weeks 0, 2, 3 and 4 back have lines; the newest has no direct predecessor
    # in the calendar, but the spine's previous week is what counts.
    inv = make("invoices", [line(MONDAYS[i], 10 * (i + 1)) for i in (0, 2, 3, 4)])
    report = trends.weekly_kpi(inv, "revenue", AS_OF, 3)
    assert rows(report.select("sort_key", "revenue", "prev_revenue")) == [
        (202409, 40.0, 50.0),
        (202410, 30.0, 40.0),
        (202412, 10.0, 30.0),
    ]


def test_growth_never_jumps_over_a_gap(make):
    lines = [line(d, 100) for d in MONDAYS[:5]]
    lines += [line(MONDAYS[i], 50, patient_species="Feline") for i in (0, 2, 3)]
    report = trends.weekly_species_trend(make("invoices", lines), AS_OF, n=4)
    feline = [(r["sort_key"], r["prev_revenue"]) for r in report.collect() if r["species"] == "Feline"]
    # Only the week whose previous week also has Feline lines is comparable.
    assert len(feline) == 1
    assert feline[0][1] == 50.0


def test_a_null_dimension_is_a_series_of_its_own(make):
    lines = [line(d, 10, patient_species=None) for d in MONDAYS[:3]]
    report = trends.weekly_species_trend(make("invoices", lines), AS_OF, n=2)
    assert [(r["species"], r["growth_pct"]) for r in report.collect()] == [(None, 0.0)] * 2


def test_top_categories_by_all_fetched_weeks(make):
    lines = []
    for i, d in enumerate(MONDAYS[:7]):
        lines += [line(d, 10 + i, plan_category_name=c) for c in "abc"]
        lines += [line(d, 100, plan_category_name="big")]
    lines.append(line(MONDAYS[0], 60, plan_category_name="late"))  # one week only
    report = trends.top_categories_weekly(make("invoices", lines), AS_OF, k=3, n=6)
    got = report.collect()
    assert {r["category"] for r in got} == {"big", "a", "b"}  # ties by name
    assert len(got) == 3 * 6


def test_a_null_category_may_be_among_the_best(make):
    lines = []
    for d in MONDAYS[:3]:
        lines += [line(d, 50, plan_category_name=None), line(d, 20, plan_category_name="a"), line(d, 10, plan_category_name="b")]
    # Lines after the reference day don't count, though their week is a spine week.
    lines.append(line(AS_OF + timedelta(days=1), 900, plan_category_name="b"))
    report = trends.top_categories_weekly(make("invoices", lines), AS_OF, k=2, n=2)
    assert [(r["category"], r["revenue"]) for r in report.collect()] == [(None, 50.0), ("a", 20.0)] * 2


def test_weeks_are_found_behind_gaps_of_any_length(make):
    far = [MONDAYS[0], MONDAYS[1], date(2019, 7, 1), date(1902, 1, 6), date(1901, 12, 30), date(1002, 1, 4)]
    inv = make("invoices", [line(d, 10 * (i + 1)) for i, d in enumerate(far)])
    monday = [d - timedelta(days=d.weekday()) for d in far]
    for n in range(8):
        assert trends.recent_weeks(inv, AS_OF, n, P.SERVICE_DATE) == monday[: n + 1]
    assert trends.recent_weeks(inv, AS_OF, 4, P.SERVICE_DATE, lookback_weeks=6) == monday[:2]
    assert trends.recent_weeks(inv, date(1901, 12, 31), 1, P.SERVICE_DATE) == monday[4:]
    report = trends.weekly_kpi(inv, "revenue", AS_OF, 4)
    assert [(r["revenue"], r["prev_revenue"]) for r in report.collect()] == [(40.0, 50.0), (30.0, 40.0), (20.0, 30.0), (10.0, 20.0)]


def test_days_of_the_missing_weeks_are_left_out(make):
    weeks = [MONDAYS[0], MONDAYS[1], MONDAYS[4], MONDAYS[6]]
    inv = make("invoices", [line(d, 1) for d in MONDAYS] + [line(AS_OF + timedelta(days=1), 1)])
    kept = inv.filter(trends.in_weeks(P.SERVICE_DATE, weeks, P.up_to(AS_OF)))
    assert sorted(r[0].date() for r in kept.select(P.SERVICE_DATE).collect()) == sorted(weeks)
    assert inv.filter(trends.in_weeks(P.SERVICE_DATE, [], P.up_to(AS_OF))).count() == 0


def test_months_skip_missing_service_dates(make):
    lines = [line("2024-01-31 23:59:59", 5), line("2024-02-01", 7)]
    lines.append({"invoice_date": "2024-01-10", "total": 1, "performed_date": None})
    inv = make("invoices", lines)
    assert [r["month_label"] for r in trends.monthly_revenue(inv).collect()] == ["2024-01", "2024-02"]
    billed = trends.monthly_revenue(inv, date_col=P.BILLING_DATE)
    assert [(r["month_label"], r["revenue"]) for r in billed.collect()] == [("2024-01", 1.0)]


def test_month_against_previous_months(make):
    lines = [line(f"2024-0{m}-15", 100 * m) for m in (1, 2, 3)]
    report = trends.month_vs_previous(make("invoices", lines), 2024, 3, n=1)
    assert [(r["month_label"], r["growth_pct"], r["trend"]) for r in report.collect()] == [
        ("2024-02", 100.0, "Growing ↑"),
        ("2024-03", 50.0, "Growing ↑"),
    ]
    gap = make("invoices", [line("2024-01-15", 1), line("2024-03-15", 1)])
    assert trends.month_vs_previous(gap, 2024, 3, n=2).count() == 0


def test_gross_and_active(make):
    lines = [line("2024-01-01", 5), line("2024-01-02", 7, cancelled=1), {"total": 11}]
    inv = make("invoices", lines)
    assert trends.gross_revenue(inv).first()[0] == 23.0
    assert trends.active_revenue(inv).first()[0] == 16.0
    assert trends.gross_revenue(inv, P.month(2024, 1)).first()[0] == 12.0


def test_counts_leave_the_phantom_out(make):
    lines = [line("2024-01-01", 1, client_id=c, patient_id=c) for c in ("13", "2", "2", None)]
    inv = make("invoices", lines)
    assert trends.customer_count(inv).first()[0] == 1
    assert trends.patient_count(inv).first()[0] == 2
    assert rows(trends.top_customers(inv, P.month(2024, 1))) == [("2", 2.0)]


def test_clinics_without_lines_show_zero(make):
    clinics = make("clinic", [{"clinic_id": "1", "clinic_name": "A"}, {"clinic_id": "2", "clinic_name": "B"}])
    inv = make("invoices", [line("2024-01-01", 5, clinic_id="1")])
    report = trends.clinic_revenue_with_zero(clinics, inv)
    assert rows(report) == [("1", "A", 5.0, 1), ("2", "B", 0.0, 0)]


def test_compare_periods(make):
    lines = [line("2024-02-10", 10), line("2024-01-10", 8), line("2024-02-10", 5, patient_species="Avian")]
    dims = {"species": "patient_species"}
    inv = make("invoices", lines)
    report = trends.compare_periods(inv, P.month(2024, 2), P.month(2024, 1), dims)
    assert rows(report) == [("Canine", 10.0, 8.0, 2.0, 25.0), ("Avian", 5.0, 0.0, 5.0, None)]
