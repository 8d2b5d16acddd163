"""The reference day is the last one a report sees, and no week is cut off."""

from datetime import date, timedelta

import pytest

from pawledger.functions import periods as P
from pawledger.functions import rules
from pawledger.operators import customers, inventory, lifestage, trends

from conftest import rows

AS_OF = date(2024, 3, 6)  # a Wednesday
MONDAY = date(2024, 3, 4)


def line(day, total=100, **more):
    base = {
        "invoice_id": f"{day}-{total}",
        "client_id": "1",
        "patient_id": "p",
        "patient_species": "Canine",
        "plan_category_name": "Surgery",
        "plan_item_id": "sku",
        "plan_item_name": "item",
        "performed_date": str(day),
        "total": total,
        "quantity": 1,
    }
    return base | more


@pytest.fixture
def invoices(make):
    """Five weeks of lines, of which the last ends at the reference day, and far later ones."""
    weeks = [line(MONDAY - timedelta(weeks=k), 100 + k) for k in range(5)]
    later = [line(AS_OF + timedelta(days=1), 5000), *[line(date(2024, 6, k + 1), 9000 + k) for k in range(20)]]
    return make("invoices", [*weeks, line(AS_OF, 7), *later])


@pytest.fixture
def patients(make):
    return make("patients", [{"patient_id": "p", "birth_date": "2020-01-01"}])


def totals(df):
    return [r.revenue for r in df.collect()]


def test_weekly_reports_end_at_the_reference_day(invoices, patients):
    assert totals(trends.weekly_species_trend(invoices, AS_OF, 4)) == [103.0, 102.0, 101.0, 107.0]
    assert totals(trends.category_weekly_trend(invoices, AS_OF, 2)) == [101.0, 107.0]
    assert totals(trends.category_group_weekly(invoices, AS_OF, 1)) == [107.0]
    assert totals(trends.top_categories_weekly(invoices, AS_OF, n=2)) == [101.0, 107.0]
    assert totals(trends.weekly_kpi(invoices, "revenue", AS_OF, 1)) == [107.0]
    assert totals(trends.life_stage_weekly_trend(invoices, patients, AS_OF, 2)) == [101.0, 107.0]
    assert totals(trends.weekly_species_revenue(invoices, AS_OF, 2)) == [102.0, 101.0, 107.0]


def test_monthly_reports_end_at_the_reference_day(invoices):
    assert totals(trends.category_monthly_trend(invoices, AS_OF, 1)) == [104.0 + 103 + 102 + 101 - 104, 107.0]
    whole = trends.category_monthly_trend(invoices, AS_OF, 1, complete_start=True, complete_end=True)
    assert totals(whole) == [410.0]
    assert totals(trends.category_group_monthly(invoices, AS_OF, 1, complete_end=True)) == [306.0]


def test_stock_and_sku_reports_end_at_the_reference_day(invoices, make):
    stocks = make("stocks", [{"stock_id": "s", "plan_item_id": "sku", "onhand_qty": 60, "clinic_id": "1"}])
    cover = rows(inventory.sku_days_cover(stocks, invoices, AS_OF, days=30))
    # The lines of the last 30 days: one a week since 5 February, and the last one.
    assert cover[0][-1] == round(60 / (6 / 30), 1)
    assert rows(inventory.excess_stock(stocks, invoices, AS_OF, days=30))[0][-2] == 300.0
    assert totals(inventory.top_skus(invoices, AS_OF)) == [517.0]
    assert sum(totals(inventory.sku_trend(invoices, AS_OF))) == 517.0
    assert totals(inventory.sku_pareto(invoices, AS_OF, cutoff=None)) == [517.0]


def test_life_stages_end_at_the_reference_day(invoices, patients):
    snapshot = lifestage.life_stage_snapshot(invoices, patients, AS_OF, weeks=4)
    assert sum(r.revenue for r in snapshot.collect()) == 100 + 101 + 102 + 103 + 7
    from pawledger.sources.views import invoice_life_stage

    staged = invoice_life_stage(invoices, patients)
    assert totals(lifestage.life_stage_monthly_trend(staged, "Canine", AS_OF, 1))[-1] == 107.0


def test_a_gap_longer_than_five_weeks(make):
    days = [date(2023, 11, 6), date(2023, 11, 13), date(2023, 11, 20), AS_OF]
    gap = make("invoices", [line(d, 100) for d in days])
    found = trends.weekly_kpi(gap, "revenue", AS_OF, 2).collect()
    # The spine's weeks need not adjoin: growth is on the spine week before.
    assert [(r.revenue, r.growth_pct) for r in found] == [(100.0, 0.0), (100.0, 0.0)]
    known = trends.weekly_kpi(gap, "revenue", AS_OF, 2, lookback_weeks=3).collect()
    assert known == []


def test_the_baseline_week_is_whole(make):
    days = [(date(2024, 1, 15), 500), (date(2024, 1, 18), 100), (date(2024, 1, 22), 600)]
    found = trends.weekly_kpi(make("invoices", [line(*d) for d in days]), "revenue", date(2024, 3, 7), 1).collect()
    assert [(r.revenue, r.growth_pct) for r in found] == [(600.0, 0.0)]


def test_new_customers_end_at_the_reference_day(make):
    days = [AS_OF - timedelta(weeks=1), AS_OF, AS_OF + timedelta(days=1), AS_OF + timedelta(days=90)]
    clients = make("clients", [{"client_id": f"c{k}", "first_activity": str(d)} for k, d in enumerate(days)])
    found = customers.weekly_new_customers(clients, AS_OF, 1).collect()
    assert [r.new_customers for r in found] == [1]


def test_parameters_reach_the_reports(invoices, make):
    assert rows(trends.customer_count(invoices, phantom="1")) == [(0,)]
    assert rows(trends.by_clinic(invoices, ["customer_count"], phantom="1"))[0][1] == 0
    assert customers.visit_frequency(invoices, phantom="1").count() == 0
    stages = {"Canine": rules.LifeStages("Pup", 60, 61)}
    births = make("patients", [{"patient_id": "p", "birth_date": "2020-01-01"}])
    snapshot = lifestage.life_stage_snapshot(invoices, births, AS_OF, stages=stages).collect()
    assert {r.life_stage: r.revenue for r in snapshot}["Pup"] > 0


def test_periods():
    assert P.up_to(AS_OF) == (None, date(2024, 3, 7))
    assert P.recent_months(AS_OF, 6) == (date(2023, 9, 6), date(2024, 3, 7))
    assert P.recent_months(AS_OF, 6, True, True) == (date(2023, 9, 1), date(2024, 3, 1))
