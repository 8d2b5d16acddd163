"""The plans are what they should be at scale."""

import io
import re
from contextlib import redirect_stdout
from datetime import date

import pytest

from conftest import SMALL
from pawledger.checks import queries as registry
from pawledger.functions import periods as P
from pawledger.operators import customers, lifestage, trends, weekly
from pawledger.plans import dashboard
from pawledger.sources import tables


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def stored(spark, make, tmp_path):
    make("invoices", [{"invoice_id": "1", "performed_date": "2024-01-01"}]).write.parquet(str(tmp_path / "i"))
    return tables.read_table(spark, "invoices", {"path": str(tmp_path / "i")})


def test_week_scan_is_pushed_down_and_pruned(stored):
    ws, we = date(2024, 1, 22), date(2024, 1, 28)
    text = plan(weekly.species_sales(dashboard.week_fact(stored, ws, we), ws, we))
    assert text.count("Scan parquet") == 2  # the tree's node and its details: one scan
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    assert "EqualTo(cancelled,0)" in pushed
    assert "GreaterThanOrEqual(performed_date,2024-01-01T00:00)" in pushed
    assert "LessThan(performed_date,2024-01-29T00:00)" in pushed
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert {c.split(":")[0] for c in re.split(r",(?!\d)", schema)} == {
        "cancelled",
        "performed_date",
        "patient_species",
        "total",
    }


def test_month_and_trend_filters_are_pushed_down(stored):
    as_of = date(2024, 3, 1)
    for df, bound in (
        (trends.species_for_month(stored, 2024, 1), "GreaterThanOrEqual(performed_date"),
        (trends.weekly_species_trend(stored, as_of), "LessThan(performed_date,2024-03-02T00:00)"),
        (trends.top_categories_weekly(stored, as_of), "LessThan(performed_date,2024-03-02T00:00)"),
        (trends.weekly_species_revenue(stored, as_of), "GreaterThanOrEqual(performed_date"),
    ):
        for pushed in re.findall(r"PushedFilters: (.*)", plan(df)):
            assert bound in pushed


def test_the_spine_reads_only_dates(stored, monkeypatch):
    plans = []
    collect = type(stored).collect
    monkeypatch.setattr(type(stored), "collect", lambda df: (plans.append(plan(df)), collect(df))[1])
    assert trends.recent_weeks(P.active(stored), date(2024, 3, 1), 4, P.SERVICE_DATE) == [date(2024, 1, 1)]
    assert len(plans) == 2  # the weeks, and whether there are older days
    for text in plans:
        schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
        assert {c.split(":")[0] for c in schema.split(",")} == {"cancelled", "performed_date"}
    assert "GreaterThanOrEqual(performed_date,2023-12-18T00:00)" in plans[0]


@pytest.fixture
def patients(make, spark, tmp_path):
    make("patients", [{"patient_id": "p", "birth_date": "2020-01-01"}]).write.parquet(str(tmp_path / "p"))
    return tables.read_table(spark, "patients", {"path": str(tmp_path / "p")})


def test_weekly_trends_read_their_weeks_only(spark, make, patients, tmp_path):
    days = ["2001-05-07", "2023-12-18", "2023-12-25", "2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]
    make("invoices", [{"invoice_id": d, "performed_date": d} for d in days]).write.parquet(str(tmp_path / "weeks"))
    lines = tables.read_table(spark, "invoices", {"path": str(tmp_path / "weeks")})
    as_of = date(2024, 2, 1)
    for df, bound in (
        (trends.weekly_species_trend(lines, as_of), "2024-01-01"),
        (trends.category_weekly_trend(lines, as_of), "2023-12-18"),
        (trends.category_group_weekly(lines, as_of), "2023-12-18"),
        (trends.top_categories_weekly(lines, as_of), "2023-12-18"),
        (trends.weekly_kpi(lines, "revenue", as_of, 7), "2001-05-07"),
        (trends.life_stage_weekly_trend(lines, patients, as_of), "2024-01-01"),
    ):
        text = plan(df)
        pushed = [x for x in re.findall(r"PushedFilters: (.*)", text) if "performed_date" in x]
        assert len(pushed) == 1 and f"GreaterThanOrEqual(performed_date,{bound}T00:00)" in pushed[0]
        assert "LessThan(performed_date,2024-02-02T00:00)" in pushed[0]
        assert ("Or(" in pushed[0]) == (bound == "2001-05-07")


def test_long_form_reads_the_fact_twice(spark, make, stored, patients):
    tidy = dashboard.tidy_week(
        stored, make("clients", []), patients, make("stocks", []), date(2024, 1, 22), date(2024, 1, 28)
    )
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan(tidy))
    assert len([s for s in schemas if "performed_date" in s]) == 2


def test_patients_are_joined_once(spark, make, tmp_path, patients):
    # Two weeks: with one there is nothing to compare, and the plan is empty.
    days = [{"invoice_id": d, "performed_date": d} for d in ("2024-01-01", "2024-01-09")]
    make("invoices", days).write.parquet(str(tmp_path / "weeks"))
    stored = tables.read_table(spark, "invoices", {"path": str(tmp_path / "weeks")})
    text = plan(trends.life_stage_weekly_trend(stored, patients, date(2024, 3, 1)))
    assert len([s for s in re.findall(r"ReadSchema: struct<(.*)>", text) if "birth_date" in s]) == 1


def test_distinct_counts_do_not_multiply_lines(stored, patients):
    for df in (
        trends.by_clinic(stored, ["revenue", "invoice_count", "customer_count"]),
        lifestage.life_stage_snapshot(stored, patients, date(2024, 3, 1)),
    ):
        text = plan(df)
        above, _, below = text[: text.index("\n\n")].partition("Expand")
        assert "HashAggregate" in below and "Exchange" in below


def test_history_meets_the_new_clients_first(stored, make):
    clients = make("clients", [])
    text = plan(customers.new_customer_species_trend(stored, clients, date(2024, 3, 1)))
    tree = text[: text.index("\n\n")]
    assert "LeftSemi" in text and tree.rindex("HashAggregate") < tree.rindex("Scan parquet")


def test_visits_are_cut_before_the_shuffle(stored):
    text = plan(customers.visit_ranked(stored, 2))
    assert len(re.findall(r"^\(\d+\) WindowGroupLimit", text, re.M)) == 2


@pytest.mark.parametrize("name", sorted(registry.registered()))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(registry.registered()[name](spark, SMALL))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "Scan ExistingRDD"):
        if name == "sku_pareto" and word == "Scan ExistingRDD":
            continue  # reads its checkpoint
        assert word not in text, word
