import random
from collections import defaultdict
from datetime import date, datetime, timedelta

from pawledger.functions import periods as P
from pawledger.operators import customers, lifestage, trends
from pawledger.sources import views

from conftest import rows


def line(client, invoice, when, total=1, **kw):
    return {
        "client_id": client,
        "invoice_id": invoice,
        "invoice_date": when,
        "performed_date": when,
        "total": total,
        "patient_species": "Canine",
        **kw,
    }


def random_lines(n=1200, seed=3):
    """A third of all lines belong to one client."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        client = "hot" if i % 3 == 0 else str(rng.randrange(20, 90))
        when = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 120))
        invoice = f"{client}-{rng.randrange(400 if client == 'hot' else 6)}"
        out.append(
            line(
                client,
                invoice,
                str(when),
                rng.randrange(1, 100),
                cancelled=int(rng.random() < 0.1),
                performed_date=None if rng.random() < 0.05 else str(when),
            )
        )
    return out


def visits_by_client(lines):
    first = defaultdict(dict)
    for x in lines:
        if x["cancelled"] or x["performed_date"] is None or x["client_id"] == "13":
            continue
        when = datetime.fromisoformat(x["performed_date"])
        seen = first[x["client_id"]].get(x["invoice_id"], when)
        first[x["client_id"]][x["invoice_id"]] = min(seen, when)
    return first


def test_visit_sequence_with_a_hot_client(make):
    lines = random_lines()
    counts = [len(v) for v in visits_by_client(lines).values()]
    expected = [(k, sum(c >= k for c in counts)) for k in range(1, 11)]
    inv = make("invoices", lines)
    assert rows(customers.visit_sequence(inv)) == [e for e in expected if e[1]]
    ranked = customers.visit_ranked(inv, 10).groupBy("visit_num").count().orderBy("visit_num")
    assert rows(ranked) == [e for e in expected if e[1]]


def test_visit_numbers_follow_time_then_invoice(make):
    lines = random_lines(seed=5)
    expected = set()
    for client, visits in visits_by_client(lines).items():
        for k, (invoice, when) in enumerate(sorted(visits.items(), key=lambda v: (v[1], v[0]))[:2], 1):
            expected.add((client, invoice, when, k))
    assert set(rows(customers.visit_ranked(make("invoices", lines), 2))) == expected
    month = sum(1 for e in expected if e[3] == 2 and (e[2].year, e[2].month) == (2024, 1))
    assert customers.returned_in_month(make("invoices", lines), 2, 2024, 1).first()[0] == month


def test_visit_frequency_counts_cancelled_visits(make):
    lines = [line("1", "a", "2024-01-01"), line("1", "a", "2024-01-01")]
    lines += [line("2", f"v{i}", None, cancelled=1) for i in range(7)]
    lines += [line("13", "x", "2024-01-01"), line(None, "y", "2024-01-01")]
    assert rows(customers.visit_frequency(make("invoices", lines))) == [
        ("1 Visit", 1, 1),
        ("5+ Visits", 1, 7),
    ]


def test_first_day_split_adds_up_to_monthly_revenue(make):
    lines = random_lines(seed=9)
    inv = make("invoices", lines)
    first = {}
    for x in lines:
        if not x["cancelled"]:
            day = datetime.fromisoformat(x["invoice_date"]).date()
            first[x["client_id"]] = min(first.get(x["client_id"], day), day)
    expected = defaultdict(lambda: [0.0, 0.0])
    for x in lines:
        if x["cancelled"] or x["performed_date"] is None:
            continue
        later = datetime.fromisoformat(x["invoice_date"]).date() > first[x["client_id"]]
        expected[x["performed_date"][:7]][later] += x["total"]
    report = customers.new_vs_existing_first_day(inv).collect()
    assert {r["month_label"]: [r["new_revenue"], r["existing_revenue"]] for r in report} == dict(expected)
    totals = {r["month_label"]: r["revenue"] for r in trends.monthly_revenue(inv).collect()}
    assert {r["month_label"]: r["new_revenue"] + r["existing_revenue"] for r in report} == totals


def test_month_split_counts_unregistered_clients_as_existing(make):
    lines = [
        line("1", "a", "2024-05-02", 10),
        line("2", "b", "2024-05-03", 20),
        line("old", "c", "2024-05-04", 40),
        line("13", "d", "2024-05-04", 80),
    ]
    clients = make(
        "clients",
        [
            {"client_id": "1", "first_activity": "2024-05-31 23:00:00"},
            {"client_id": "2", "first_activity": "2023-05-31"},
            {"client_id": "3", "first_activity": None},
        ],
    )
    inv = make("invoices", lines)
    split = customers.new_vs_existing_revenue_month(inv, clients, 2024, 5)
    assert rows(split) == [(10.0, 60.0, 70.0)]
    counts = customers.new_vs_returning_count(inv, clients, 2024, 5)
    assert sorted(rows(counts)) == [("New", 1), ("Returning", 1)]
    assert rows(customers.new_vs_existing_revenue_month(inv, clients, 2020, 5)) == [(0.0, 0.0, 0.0)]


def test_species_mix_counts_clients(make):
    lines = [
        line("1", "a", "2024-05-02"),
        line("1", "b", "2020-01-01", patient_species="Feline"),
        line("2", "c", "2024-05-02"),
        line("2", "d", "2024-05-03"),
        line("3", "e", "2024-05-03", patient_species="Avian"),
        line("4", "f", "2024-05-03", patient_species="Avian", cancelled=1),
    ]
    clients = make("clients", [{"client_id": c, "first_activity": "2024-05-10"} for c in ("1", "2", "4", "13")])
    mix = customers.new_customer_species_mix(make("invoices", lines), clients, P.month(2024, 5))
    assert rows(mix) == [("Canine", 2, 66.7), ("Feline", 1, 33.3)]
    trend = customers.new_customer_species_trend(make("invoices", lines), clients, date(2024, 6, 15))
    assert rows(trend) == [(202405, "2024-05", "Canine", 2), (202405, "2024-05", "Feline", 1)]


def test_all_six_life_stages_are_listed(make):
    lines = [line("1", "a", "2024-05-02", 10, patient_id="p"), line("1", "b", "2024-05-02", 5, patient_id="x")]
    patients = make("patients", [{"patient_id": "p", "birth_date": "2023-06-01"}])
    lines.append(line("1", "c", "2024-05-02", 3, patient_id=None))
    staged = views.invoice_life_stage(make("invoices", lines), patients)
    assert sorted(r["total"] for r in staged.collect()) == [3, 5, 10]  # unknown patients stay
    report = lifestage.life_stage_snapshot(make("invoices", lines), patients, date(2024, 5, 10))
    got = rows(report)
    assert [r[0] for r in got] == [
        "Canine Puppy",
        "Canine Adult",
        "Canine Senior",
        "Feline Kitten",
        "Feline Adult",
        "Feline Senior",
    ]
    assert got[0][3:] == (10.0, 1, 1) and got[1][3:] == (0.0, 0, 0)
