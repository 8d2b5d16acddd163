"""Metrics from the stored cube equal those from the lines; the export's order and totals."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pawledger.functions import periods as P
from pawledger.operators import history
from pawledger.plans import cube, dashboard, export
from pawledger.sources import tables
from test_plans import plan
from test_weekly import line

MONDAY = (date(2024, 1, 22), date(2024, 1, 28))
# Begins inside a calendar week, so do the weeks before it.
WEDNESDAY = (date(2024, 1, 24), date(2024, 1, 30))
EMPTY = (date(2024, 6, 3), date(2024, 6, 9))


def given(make, n=500, seed=4):
    rng = random.Random(seed)
    lines = []
    for k in range(n):
        when = datetime(2023, 12, 20) + timedelta(seconds=rng.randrange(86400 * 45))
        lines.append(
            line(
                str(when) if rng.random() < 0.95 else None,
                rng.choice([10, 10, 20, 35, -5, None]),
                cancelled=int(rng.random() < 0.1),
                invoice_id=rng.choice([f"i{k % 90}", None]),
                client_id=rng.choice(["1", "2", "13", None, str(k % 30)]),
                patient_id=rng.choice([f"p{k % 20}", None]),
                patient_species=rng.choice(["Canine", "Feline", "Rabbit", None]),
                plan_category_name=rng.choice([*"abcdefg", None]),
            )
        )
    patients = [{"patient_id": f"p{k}", "birth_date": "2020-01-01" if k % 5 else None} for k in range(15)]
    patients.append({"patient_id": "p1", "birth_date": "2023-12-01"})
    first = [{"client_id": str(k), "first_activity": str(MONDAY[0] + timedelta(days=k - 8))} for k in range(16)]
    stocks = [{"stock_name": "x", "plan_category_name": "Diets/Food", "onhand_qty": 3, "purchase_cost": 2}]
    return [make("invoices", lines), make("clients", first), make("patients", patients), make("stocks", stocks)]


def same(found, expected):
    assert set(found) == set(expected)
    for name in expected:
        assert found[name].columns == expected[name].columns, name
        assert sorted(map(str, rows(found[name]))) == sorted(map(str, rows(expected[name]))), name


@pytest.mark.parametrize("week", [MONDAY, WEDNESDAY, EMPTY])
def test_metrics_of_the_cube_equal_those_of_the_lines(make, tmp_path, week):
    data = given(make)
    expected = dashboard.weekly_dashboard(*data, *week)
    same(dashboard.weekly_dashboard(*data, *week, folder=str(tmp_path / "cube")), expected)


def test_no_lines_no_earlier_weeks_and_written_again(make, tmp_path):
    folder, data = str(tmp_path / "cube"), given(make)
    for weeks in (0, 5):
        expected = dashboard.weekly_dashboard(*data, *MONDAY, prior_weeks=weeks)
        same(dashboard.weekly_dashboard(*data, *MONDAY, prior_weeks=weeks, folder=folder), expected)
    data[0] = make("invoices", [])
    same(dashboard.weekly_dashboard(*data, *MONDAY, folder=folder), dashboard.weekly_dashboard(*data, *MONDAY))


def test_zone_of_the_session_is_no_part_of_an_hour(spark, make, tmp_path):
    # 02:30 of that day does not exist in New York.
    week = (date(2024, 3, 4), date(2024, 3, 10))
    data = [make("invoices", [line("2024-03-10 02:30:15.25", 7), line("2024-03-10 01:59:59", 5)])]
    data += [make(name, []) for name in ("clients", "patients", "stocks")]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        metrics = dashboard.weekly_dashboard(*data, *week, folder=str(tmp_path / "cube"))
        stored = spark.read.parquet(str(tmp_path / "cube"))
        hours = {str(r[0]) for r in stored.filter("part = 'hour'").select(P.SERVICE_DATE).collect()}
        assert hours == {"2024-03-10 02:00:00", "2024-03-10 01:00:00"}
        assert metrics["total_sales"].first().value == 12.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_one_scan_and_few_lines(spark, make, tmp_path):
    data = given(make, n=4000)
    data[0].write.parquet(str(tmp_path / "lines"))
    fact = tables.read_table(spark, "invoices", {"path": str(tmp_path / "lines")})
    week = dashboard.week_fact(fact, *MONDAY)
    text = plan(cube.added_up(week, *MONDAY, 3))
    assert text.count("Scan parquet") == 2  # the tree's node and its details
    assert "GreaterThanOrEqual(performed_date,2024-01-01T00:00)" in text
    known = data[1].select("client_id")
    metrics = dashboard.weekly_dashboard(fact, *data[1:], *MONDAY, folder=str(tmp_path / "cube"), known=known)
    for name, part in cube.PART_OF.items():
        text = plan(metrics[name])
        assert str(tmp_path / "lines") not in text, name
        assert "(part#" in text and f"= {part})" in text, name
    stored = spark.read.parquet(str(tmp_path / "cube"))
    sizes = {r["part"]: r["count"] for r in stored.groupBy("part").count().collect()}
    assert set(sizes) == set(cube.PARTS) and sizes["hour"] <= 28 * 24 and sizes["category"] <= 4 * 8
    # Only what is asked for is stored.
    dashboard.weekly_dashboard(fact, *data[1:], *MONDAY, only=("total_sales", "inventory_value"), folder=str(tmp_path / "one"))
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "one")).select("part").distinct().collect()} == {"hour"}
    assert set(dashboard.weekly_dashboard(fact, *data[1:], *MONDAY, only=("inventory_value",), folder=str(tmp_path / "none"))) == {"inventory_value"}


def test_known_clients_from_the_state(make, tmp_path):
    data = given(make)
    through = MONDAY[0] - timedelta(days=1)
    state = history.advance(data[0], str(tmp_path / "state"), through)
    known = history.known_clients(state, data[1], MONDAY[0])
    found = dashboard.weekly_dashboard(*data, *MONDAY, folder=str(tmp_path / "cube"), known=known)
    expected = dashboard.weekly_dashboard(*data, *MONDAY, only=("repeat_customers",))
    assert rows(found["repeat_customers"]) == rows(expected["repeat_customers"])
    # The lines before the week are in the state, and not read for this.
    assert plan(found["repeat_customers"]).count("through=") > 0


def test_export_has_every_figure_once_and_in_order(make, tmp_path):
    data = given(make)
    metrics = dashboard.weekly_dashboard(*data, *MONDAY, folder=str(tmp_path / "cube"))
    found = [r.asDict() for r in export.week_export(metrics).collect()]
    places = [(r["section_no"], r["row_no"]) for r in found]
    assert places == sorted(places) and len(set(places)) == len(places)
    assert [s for s in export.SECTIONS if s in {r["section"] for r in found}] == list(dict.fromkeys(r["section"] for r in found))
    plain = sorted((r["section"], r["label"], r["sub_label"], r["this_week"]) for r in found
                   if r["section"] not in ("Header", "Visits", "Clients") and not r["is_total"])
    tidy = dashboard.tidy_dashboard(metrics).select("section", "label", F.coalesce("sub_label", F.lit("")), "this_week")
    assert plain == sorted(rows(tidy))
    for section in export.TOTALS:
        of = [r for r in found if r["section"] == section]
        assert [r["is_total"] for r in of] == [False] * (len(of) - 1) + [True], section
        assert of[-1]["this_week"] == sum(r["this_week"] for r in of[:-1])
    everyone = metrics["repeat_customers"].first().total_customers
    assert [r["this_week"] for r in found if r["section"] == "Clients" and r["is_total"]] == [everyone]
    header = {r["label"]: r["this_week"] for r in found if r["section"] == "Header"}
    assert header["All Customers"] == everyone and header["Inventory Value"] == 6.0


def test_export_of_empty_tables(make):
    data = [make(name, []) for name in ("invoices", "clients", "patients", "stocks")]
    found = export.week_export(dashboard.weekly_dashboard(*data, *MONDAY)).collect()
    assert {r.section for r in found} == {"Header", "Revenue", "Customers", "Clients"}
    assert all(r.this_week in (0.0, None) for r in found)
