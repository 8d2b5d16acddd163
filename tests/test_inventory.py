import random
from datetime import date

from pawledger.operators import inventory

from conftest import rows

AS_OF = date(2024, 6, 30)


def sale(sku, total, when="2024-06-10", quantity=1, **kw):
    return {
        "plan_item_id": sku,
        "plan_item_name": f"item {sku}",
        "total": total,
        "quantity": quantity,
        "performed_date": when,
        **kw,
    }


def test_pareto_over_many_ranges(make):
    """Ties, and one SKU with a third of all revenue lines."""
    rng = random.Random(11)
    lines = [sale("hot" if i % 3 == 0 else f"s{rng.randrange(150):03}", rng.choice([5, 10, 10])) for i in range(900)]
    sums = {}
    for x in lines:
        sums[x["plan_item_id"]] = sums.get(x["plan_item_id"], 0) + x["total"]
    ordered = sorted(sums.items(), key=lambda s: (-s[1], s[0]))
    total, cum, expected = sum(sums.values()), 0, []
    for sku, revenue in ordered:
        if cum < 0.8 * total:
            expected.append((sku, float(revenue), float(cum + revenue)))
        cum += revenue
    inv = make("invoices", lines)
    got = inventory.sku_pareto(inv, AS_OF).collect()
    assert sorted((r[0], r["revenue"], r["cum_revenue"]) for r in got) == sorted(expected)
    everything = inventory.sku_pareto(inv, AS_OF, cutoff=None)
    assert everything.count() == len(sums)
    assert max(r["cum_pct"] for r in everything.collect()) == 100.0


def test_pareto_without_sales(make):
    assert inventory.sku_pareto(make("invoices", []), AS_OF).count() == 0


def test_days_cover(make):
    stocks = make(
        "stocks",
        [
            {"stock_id": "a", "plan_item_id": "a", "clinic_id": "1", "onhand_qty": 20},
            {"stock_id": "b", "plan_item_id": "b", "clinic_id": "1", "onhand_qty": 5},
            {"stock_id": "c", "plan_item_id": "c", "clinic_id": "1", "onhand_qty": 7},
            {"stock_id": "d", "plan_item_id": "d", "clinic_id": "1", "onhand_qty": -7},
        ],
    )
    inv = make("invoices", [sale("a", 1, quantity=15), sale("b", 1, quantity=30), sale("c", 1, "2024-05-01")])
    cover = inventory.sku_days_cover(stocks, inv, AS_OF)
    assert [(r["sku_id"], r["days_cover"]) for r in cover.collect()] == [("a", 40.0), ("b", 5.0), ("c", None)]
    excess = inventory.excess_stock(stocks, inv, AS_OF)
    assert {(r["sku_id"], r["reason"]) for r in excess.collect()} == {("a", "excess"), ("c", "no sales")}


def test_coverage_by_category(make):
    stocks = make(
        "stocks",
        [
            {"plan_category_name": c, "onhand_qty": q, "purchase_cost": 31}
            for c, q in (("slow", 50), ("fast", 20), ("unsold", 90))
        ],
    )
    lines = [sale("x", 31, plan_category_name=c) for c in ("slow", "fast")]
    report = inventory.category_stock_coverage(stocks, make("invoices", lines), 2024, 6)
    assert rows(report) == [("slow", 1550.0, 1.0, 1550.0), ("fast", 620.0, 1.0, 620.0)]
    strict = inventory.category_stock_coverage(stocks, make("invoices", lines), 2024, 6, min_days=620)
    assert [r[0] for r in rows(strict)] == ["slow"]


def test_stock_repeats_per_clinic(make):
    stocks = make(
        "stocks",
        [
            {"stock_id": "a", "stock_consumed_id": f"a{c}", "clinic_id": c, "onhand_qty": q, "purchase_cost": 2}
            for c, q in (("1", 3), ("2", 4), ("3", -1))
        ],
    )
    assert rows(inventory.stock_by_company(stocks)) == [("a", 7.0)]
    assert sorted(rows(inventory.stock_by_clinic(stocks))) == [
        ("1", "a1", 3.0),
        ("2", "a2", 4.0),
        ("3", "a3", 0.0),
    ]
    assert rows(inventory.stock_value(stocks)) == [(14.0,)]


def test_top_skus_by_name_on_ties(make):
    inv = make("invoices", [sale(s, 5) for s in "cab"] + [sale("old", 99, "2024-01-01"), sale(None, 99)])
    assert [r[0] for r in rows(inventory.top_skus(inv, AS_OF, k=2))] == ["a", "b"]
