"""Dashboard metrics on hand-made lines and against a plain-Python count."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from pawledger.functions import rules
from pawledger.operators import inventory, weekly
from pawledger.plans import dashboard
from pawledger.sources import scans

from conftest import rows

WS, WE = date(2024, 1, 22), date(2024, 1, 28)


def line(when, total, **kw):
    base = {"invoice_id": "i", "client_id": "1", "patient_species": "Canine"}
    return {**base, "performed_date": when, "total": total, **kw}


def fact(make, lines, ws=WS, we=WE):
    return dashboard.week_fact(make("invoices", lines), ws, we)


def test_last_second_counts_and_next_midnight_does_not(make):
    lines = [line("2024-01-28 23:59:59", 10), line("2024-01-29 00:00:00", 99)]
    value = weekly.total_sales(fact(make, lines), WS, WE).first()
    assert value["value"] == 10.0
    assert value["coverage_pct"] == 14.3
    assert value["warnings"] == ["Only 14.3% of week days have data — partial week."]
    assert value["variance_pct"] is None


def test_empty_fact(make):
    value = weekly.total_sales(fact(make, []), WS, WE).first()
    assert (value["value"], value["prior_value"], value["coverage_pct"]) == (0.0, 0.0, 0.0)
    customers = weekly.repeat_customers(fact(make, []), make("clients", []).select("client_id"), WS, WE)
    assert tuple(customers.first()) == (0, 0, 0, 0.0, ["No customer data for this week."])
    assert weekly.species_sales(fact(make, []), WS, WE).count() == 0


def test_alignment_and_prior_mean(make):
    lines = [
        line("2024-01-22", 50, patient_species="Canine"),
        line("2024-01-03", 100, patient_species="Canine"),  # one of three prior weeks
        line("2024-01-10", 30, patient_species="Feline"),  # only before
        line("2024-01-17", 10, patient_species="Feline"),
        line("2024-01-23", 5, patient_species="Avian"),  # only now
        line("2024-01-24", 7, patient_species=None),  # dropped dimension
        line("2024-01-24", 1000, cancelled=1),
        line(None, 1000),
    ]
    report = weekly.species_sales(fact(make, lines), WS, WE)
    assert rows(report) == [
        ("Canine", 50.0, 100.0, 90.9, -50.0),
        ("Avian", 5.0, 0.0, 9.1, None),
        ("Feline", 0.0, 20.0, 0.0, -100.0),
    ]


def test_week_that_does_not_start_on_monday(make):
    ws, we = date(2024, 1, 24), date(2024, 1, 30)  # Wednesday to Tuesday
    lines = [
        line("2024-01-24", 1),
        line("2024-01-30", 2),  # another ISO week, same reported week
        line("2024-01-22", 4),  # same ISO week as the start, but before it
        line("2024-01-16", 8),
    ]
    value = weekly.total_sales(fact(make, lines, ws, we), ws, we).first()
    assert (value["value"], value["prior_value"]) == (3.0, 6.0)
    bills = weekly.invoice_count_by_species(fact(make, lines, ws, we), ws, we).first()
    assert bills["bill_count"] == 1


def test_top_categories(make):
    lines = [
        line("2024-01-22", 5, plan_category_name=c) for c in ("d", "b", "a", "c")
    ] + [
        line("2024-01-22", 10, plan_category_name="z"),
        line("2024-01-10", 500, plan_category_name="prior only"),
        line("2024-01-10", 5, plan_category_name="a"),
    ]
    report = weekly.category_top_n(fact(make, lines), WS, WE, top_n=3)
    assert rows(report) == [
        ("z", 10.0, 0.0, 50.0, None),
        ("a", 5.0, 5.0, 25.0, 0.0),
        ("b", 5.0, 0.0, 25.0, None),
    ]


def test_rounding_is_half_even(make):
    lines = [line("2024-01-22", 2.5), line("2024-01-22", 3.5, patient_species="Feline")]
    report = dict((r[0], r[1]) for r in rows(weekly.species_sales(fact(make, lines), WS, WE)))
    assert report == {"Canine": 2.0, "Feline": 4.0}


def test_missing_client_is_one_customer_and_phantom_is_none(make):
    lines = [
        line("2024-01-22", 1, client_id=None),
        line("2024-01-23", 1, client_id=None),
        line("2024-01-22", 1, client_id="13"),
        line("2024-01-22", 1, client_id="2"),
        line("2024-01-22", 1, client_id="3"),
    ]
    known = scans.prior_clients(
        make("clients", [{"client_id": "2", "first_activity": "2023-01-01"}, {"client_id": "13"}]),
        make("invoices", [line("2024-01-21", 1, client_id="13"), line("2024-01-22", 1, client_id="3")]),
        WS,
    )
    assert rows(known) == [("2",)]
    report = weekly.repeat_customers(fact(make, lines), known, WS, WE).first()
    assert tuple(report)[:4] == (3, 1, 2, 33.3)


def test_new_and_existing(make):
    lines = [
        line("2024-01-22", 10, client_id="1"),
        line("2024-01-22", 20, client_id="2", patient_species="Rabbit"),
        line("2024-01-22", 30, client_id="2", patient_species="Canine"),
        line("2024-01-22", 40, client_id=None, patient_species=None),
        line("2024-01-22", 99, client_id="13"),
    ]
    clients = make(
        "clients",
        [
            {"client_id": "2", "first_activity": "2024-01-28 23:00:00"},
            {"client_id": "1", "first_activity": "2024-01-29"},
            {"client_id": "13", "first_activity": "2024-01-22"},
        ],
    )
    ids = scans.new_clients(clients, WS, WE + timedelta(days=1))
    by_type = weekly.new_vs_existing_customers(fact(make, lines), ids, WS, WE)
    assert rows(by_type) == [
        ("New", "Canine", 1, 30.0),
        ("New", rules.OTHER_SPECIES, 1, 20.0),
        ("Existing", "Canine", 1, 10.0),
        ("Existing", rules.OTHER_SPECIES, 0, 40.0),
    ]
    revenue = weekly.new_vs_existing_revenue(fact(make, lines), ids, WS, WE)
    assert tuple(revenue.first()) == (50.0, 50.0, 100.0, 50.0, 50.0, [])
    nobody = ids.filter("false")
    empty = weekly.new_vs_existing_revenue(fact(make, lines), nobody, WS, WE).first()
    assert (empty["new_revenue"], empty["existing_revenue"]) == (0.0, 100.0)
    assert empty["warnings"]


def test_life_stage_drops_unknown_births(make):
    lines = [
        line("2024-01-22", 10, patient_id="a"),
        line("2024-01-22", 20, patient_id="b"),
        line("2024-01-22", 30, patient_id="unknown"),
        line("2024-01-22", 40, patient_id="c", patient_species="Rabbit"),
    ]
    patients = make(
        "patients",
        [
            {"patient_id": "a", "birth_date": "2023-12-01"},
            {"patient_id": "b", "birth_date": None},
            {"patient_id": "c", "birth_date": "2020-01-01"},
        ],
    )
    births = scans.scan_patients(patients)
    report = weekly.life_stage_metrics(fact(make, lines), births, WS, WE)
    assert rows(report) == [("Canine", "Puppy", 10.0, 1)]


def test_inventory_value(make):
    stocks = make(
        "stocks",
        [
            {"stock_name": "Bag", "plan_category_name": "Diets/Food", "onhand_qty": 2, "purchase_cost": 10},
            {"stock_name": "Bag", "plan_category_name": "Diets/Food", "onhand_qty": -5, "purchase_cost": 10},
            {"stock_name": None, "plan_category_name": None, "onhand_qty": 3, "purchase_cost": 20},
            {"stock_name": "LASIX 10mg tab", "onhand_qty": 9, "purchase_cost": 9},
            {"stock_name": "Pill", "plan_category_name": "Medvet", "onhand_qty": 4, "purchase_cost": None},
        ],
    )
    report = inventory.inventory_value(scans.scan_stocks(stocks))
    assert rows(report) == [("Non-Food", 60.0, 75.0), ("Food", 20.0, 25.0), ("Pharmacy", 0.0, 0.0)]


def test_random_lines_with_one_hot_client_and_species(make):
    """A third of all lines on one client and species, checked by brute force."""
    rng = random.Random(7)
    lines = []
    for i in range(900):
        hot = i % 3 == 0
        when = datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(28 * 24 * 60))
        lines.append(
            line(
                str(when),
                round(rng.uniform(1, 500), 2),
                client_id="7" if hot else str(rng.randrange(100, 160)),
                patient_species="Canine" if hot else rng.choice(["Feline", "Avian", "Rabbit"]),
                invoice_id=f"v{rng.randrange(200)}",
                plan_category_name=rng.choice("abcdefgh"),
            )
        )
    data = fact(make, lines)
    for metric, dim, amount in (
        (weekly.species_sales, "patient_species", lambda ls: sum(ls_["total"] for ls_ in ls)),
        (
            weekly.invoice_count_by_species,
            "patient_species",
            lambda ls: len({ls_["invoice_id"] for ls_ in ls}),
        ),
    ):
        now, before = defaultdict(list), defaultdict(lambda: defaultdict(list))
        for item in lines:
            day = datetime.fromisoformat(item["performed_date"]).date()
            if day >= WS:
                now[item[dim]].append(item)
            else:
                before[item[dim]][day.isocalendar()[:2]].append(item)
        for name, value, prior, _, _ in rows(metric(data, WS, WE)):
            weeks = [amount(w) for w in before[name].values()]
            digits = 0 if metric is weekly.species_sales else 1
            assert value == round(amount(now[name]), 0)
            assert prior == round(sum(weeks) / len(weeks), digits)


def test_whole_dashboard(make):
    lines = [line("2024-01-22 10:00:00", 10, plan_category_name="Surgery", patient_id="a")]
    metrics = dashboard.weekly_dashboard(
        make("invoices", lines),
        make("clients", []),
        make("patients", [{"patient_id": "a", "birth_date": "2020-01-01"}]),
        make("stocks", [{"stock_name": "x", "onhand_qty": 1, "purchase_cost": 5}]),
        WS,
        WE,
        persist=True,
    )
    tidy = dashboard.tidy_dashboard(metrics)
    assert {r["section"] for r in tidy.collect()} == {
        "Revenue",
        "Species",
        "Category",
        "Bills",
        "Day/Night",
        "Life Stage",
        "Inventory",
        "Customers",
    }
    head = dashboard.kpi_headline(metrics).first()
    assert (head["total_sales"], head["total_customers"], head["inventory_total"]) == (10.0, 1, 5.0)
    table = dashboard.subtotal(
        metrics["new_vs_existing_customers"],
        ["customer_type", "species"],
        ["revenue"],
        fixed={"client_count": F.lit(1)},
    )
    assert rows(table) == [("Existing", "Canine", 1, 10.0), ("Total", None, 1, 10.0)]
    metrics["_fact"].unpersist()


def test_one_pass_long_form_equals_the_metrics(make):
    """Also on an empty week, on ties, and on lines without a dimension."""
    rng = random.Random(4)
    species = ["Canine", "Feline", "Rabbit", None]
    lines = []
    for k in range(400):
        when = datetime(2023, 12, 25) + timedelta(minutes=rng.randrange(60 * 24 * 40))
        lines.append(
            line(
                str(when),
                rng.choice([10, 10, 20, 35, None]),
                invoice_id=rng.choice([f"i{k % 90}", None]),
                client_id=rng.choice(["1", "2", "13", None, str(k % 30)]),
                patient_id=rng.choice([f"p{k % 20}", None]),
                patient_species=rng.choice(species),
                plan_category_name=rng.choice(["a", "b", "c", "d", "e", "f", "g", None]),
            )
        )
    patients = make("patients", [{"patient_id": f"p{k}", "birth_date": "2020-01-01" if k % 5 else None} for k in range(15)])
    clients = make("clients", [{"client_id": str(k), "first_activity": str(WS + timedelta(days=k - 8))} for k in range(16)])
    stocks = make("stocks", [{"stock_name": "x", "plan_category_name": "Diets/Food", "onhand_qty": 3, "purchase_cost": 2}])
    for rows_of, week in ((lines, (WS, WE)), ([], (WS, WE)), (lines, (date(2024, 6, 3), date(2024, 6, 9)))):
        given = (make("invoices", rows_of), clients, patients, stocks, *week)
        metrics = dashboard.weekly_dashboard(*given, only=dashboard.TIDY_METRICS)
        expected = dashboard.tidy_dashboard(metrics)
        got = dashboard.tidy_week(*given)
        assert got.columns == expected.columns
        assert sorted(rows(got), key=str) == sorted(rows(expected), key=str)


def test_totals(make):
    lines = [
        line("2024-01-22", 10, client_id="1", plan_category_name="a"),
        line("2024-01-23", 20, client_id="1", patient_species="Avian", invoice_id="j"),
        line("2024-01-24", 30, client_id="2", patient_species="Rabbit", invoice_id="k"),
    ]
    clients = make("clients", [{"client_id": "2", "first_activity": "2024-01-22"}])
    metrics = dashboard.weekly_dashboard(
        make("invoices", lines), clients, make("patients", []), make("stocks", []), WS, WE
    )
    tables = dashboard.table_totals(metrics)
    customers = {(r.customer_type, r.species): r.client_count for r in tables["new_vs_existing_customers"].collect()}
    # Client 1 is in two rows but counts once.
    assert customers[("Total", None)] == 2 and sum(v for k, v in customers.items() if k[0] != "Total") == 3
    assert rows(tables["new_vs_existing_revenue"])[-1] == ("Total", 60.0, 100.0)
    total = [r for r in tables["category_top"].collect() if r.category == "Total (Top 5)"]
    assert len(total) == 1 and total[0].pct_contribution is None
