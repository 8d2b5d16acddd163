from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pawledger.functions import columns as C
from pawledger.functions import periods as P
from pawledger.functions import present, rules


def values(spark, schema, data, column):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(
    "day, key, label",
    [
        (date(2024, 12, 30), 202501, "2025-01"),
        (date(2027, 1, 1), 202653, "2026-53"),
        (date(2024, 1, 1), 202401, "2024-01"),
    ],
)
def test_iso_week_at_year_boundary(spark, day, key, label):
    assert values(spark, "d date", [(day,)], C.yearweek("d")) == [key]
    assert values(spark, "d date", [(day,)], C.iso_week_label("d")) == [label]


def test_week_labels(spark):
    at = [(datetime(2024, 12, 31, 23, 59, 59),)]
    assert values(spark, "t timestamp_ntz", at, C.week_range("t")) == ["30 Dec 2024 - 05 Jan 2025"]
    assert values(spark, "t timestamp_ntz", at, C.week_label("t")) == ["Dec 30 – Jan 05, 2025"]
    assert P.week_label(date(2024, 12, 31)) == "Dec 30 – Jan 05, 2025"


def test_calendar_months_of_age(spark):
    cases = [
        (date(2024, 1, 31), datetime(2024, 2, 29, 12), 0),
        (date(2024, 2, 29), datetime(2025, 2, 28, 12), 11),
        (date(2024, 2, 29), datetime(2025, 3, 1, 0), 12),
        (date(2024, 5, 10), datetime(2024, 3, 15, 0), -1),
        (None, datetime(2024, 3, 15, 0), None),
    ]
    got = values(spark, "b date, t timestamp_ntz", [c[:2] for c in cases], C.age_months("b", "t"))
    assert got == [c[2] for c in cases]


def test_approximate_age_truncates_towards_zero(spark):
    cases = [
        (date(2024, 1, 1), datetime(2024, 1, 31, 10, 33, 35), 0),
        (date(2024, 1, 1), datetime(2024, 1, 31, 10, 33, 36), 1),
        (date(2024, 2, 1), datetime(2024, 1, 15, 0), 0),
        (date(2024, 5, 1), datetime(2024, 1, 15, 0), -3),
    ]
    got = values(
        spark, "b date, t timestamp_ntz", [c[:2] for c in cases], C.age_months_approx("b", "t")
    )
    assert got == [c[2] for c in cases]


def test_life_stage_thresholds(spark):
    cases = [
        ("Canine", 11, "Puppy"),
        ("Canine", 12, "Adult"),
        ("Canine", 83, "Adult"),
        ("Canine", 84, "Senior"),
        ("Feline", 11, "Kitten"),
        ("Feline", 119, "Adult"),
        ("Feline", 120, "Senior"),
        ("Feline", -3, "Kitten"),
        ("Rabbit", 20, None),
        ("Canine", None, None),
        (None, 20, None),
    ]
    got = values(spark, "s string, a int", [c[:2] for c in cases], C.life_stage("s", "a"))
    assert got == [c[2] for c in cases]


def test_category_groups(spark):
    cases = [
        ("Prescription  12%", "Pharmacy"),
        ("prescription 5%", "Pharmacy"),
        ("Parenteral Medication 12%", "Pharmacy"),
        (" Pet shop", "Food & Pet Shop"),
        ("Non Prescription Items", "Food & Pet Shop"),
        ("Non-Prescription Items 18%", "Food & Pet Shop"),
        ("Diets/Food", "Food & Pet Shop"),
        ("Food", "Other"),
        ("Pathology", "Diagnostics"),
        ("Medvet", "Clinical Services"),
        ("At Home Protocols", "Other"),
        (None, "Other"),
    ]
    names = [(c[0],) for c in cases]
    assert values(spark, "c string", names, C.category_group("c")) == [c[1] for c in cases]
    trend = C.category_group("c", rules.CATEGORY_GROUP_TREND_RULES)
    variants = [("At Home Protocols",), ("Parenteral Medication 12%",)]
    assert values(spark, "c string", variants, trend) == ["Clinical Services", "Other"]


def test_logical_and_stock_groups(spark):
    names = [("Prescription+X",), ("PET SHOP  18%",), (" Surgery ",), (None,), ("Diets/Food",)]
    assert values(spark, "c string", names, C.logical_category("c")) == [
        "Prescription (All)",
        "Pet Shop (All)",
        "Surgery",
        None,
        "Diets/Food",
    ]
    assert values(spark, "c string", names, C.stock_group("c")) == [
        "Pharmacy",
        "Pet Shop",
        "Other",
        "Other",
        "Food",
    ]


def test_inventory_bucket(spark):
    cases = [
        (" Diets\\Food", "Food"),
        ("Diets/Food", "Food"),
        ("Medvet", "Pharmacy"),
        ("Preventive Medicine 12%", "Pharmacy"),
        ("prescription", "Non-Food"),
        (None, "Non-Food"),
    ]
    got = values(spark, "c string", [(c[0],) for c in cases], C.inventory_bucket("c"))
    assert got == [c[1] for c in cases]


def test_species_and_time_buckets(spark):
    species = [("Canine",), ("Avian",), (None,)]
    assert values(spark, "s string", species, C.species_bucket("s")) == [
        "Canine",
        rules.OTHER_SPECIES,
        rules.OTHER_SPECIES,
    ]
    hours = [(datetime(2024, 1, 1, h, 59),) for h in (8, 9, 20, 21)]
    day, night = rules.DAY_LABEL, rules.NIGHT_LABEL
    assert values(spark, "t timestamp_ntz", hours, C.time_band("t")) == [night, day, day, night]


def test_growth_and_trend(spark):
    pairs = [(110.0, 100.0), (0.0, 50.0), (5.0, 0.0), (5.0, None), (100.25, 100.0)]
    up = values(spark, "c double, p double", pairs, C.growth_pct("c", "p"))
    even = values(spark, "c double, p double", pairs, C.growth_pct("c", "p", half_even=True))
    assert up == [10.0, -100.0, None, None, 0.3]
    assert even == [10.0, -100.0, None, None, 0.2]
    growth = [(10.0,), (10.1,), (-10.1,), (-10.0,), (None,)]
    assert values(spark, "g double", growth, C.trend_label("g")) == [
        "Stable →",
        "Growing ↑",
        "Declining ↓",
        "Stable →",
        None,
    ]


def test_numbers(spark):
    text = [("12.345",), ("abc",), (None,)]
    assert values(spark, "v string", text, C.to_number_or_zero("v")) == [
        Decimal("12.35"),
        Decimal("0.00"),
        Decimal("0.00"),
    ]
    quantities = [(Decimal("-2.000"),), (None,), (Decimal("3.500"),)]
    got = values(spark, "q decimal(18,3)", quantities, C.nonneg("q"))
    assert got == [Decimal("0.000"), Decimal("0.000"), Decimal("3.500")]


def test_money_text(spark):
    money = [(947.0,), (5947.0,), (264946.5,), (12345678.0,), (-1000.0,), (0.4,)]
    assert values(spark, "v double", money, C.fmt_inr("v")) == [
        "₹947",
        "₹5,947",
        "₹2,64,946",
        "₹1,23,45,678",
        "₹1,000",
        "₹0",
    ]
    short = [(57300000.0,), (3970000.0,), (99999.0,), (None,)]
    assert values(spark, "v double", short, C.fmt_short("v")) == [
        "₹5.73Cr",
        "₹39.7L",
        "₹99,999",
        None,
    ]
    assert values(spark, "v double", [(12.34,), (-24.9,), (None,)], C.fmt_pct("v")) == [
        "+12.3%",
        "-24.9%",
        "—",
    ]


def test_periods():
    as_of = date(2026, 3, 31)
    assert P.months_back(as_of, 1) == date(2026, 2, 28)
    assert P.complete_months(as_of, 6) == (date(2025, 9, 1), date(2026, 3, 1))
    assert P.last_complete_month(as_of) == (date(2026, 2, 1), date(2026, 3, 1))
    assert P.previous_months(date(2026, 1, 15), 3) == (date(2025, 10, 1), date(2026, 1, 1))
    assert P.resolve_named_month(as_of, 3) == (date(2026, 3, 1), date(2026, 4, 1))
    assert P.resolve_named_month(as_of, 4) == (date(2025, 4, 1), date(2025, 5, 1))
    assert P.quarter(2001, 2) == (date(2001, 4, 1), date(2001, 7, 1))
    assert P.week_of(date(2024, 1, 28)) == (date(2024, 1, 22), date(2024, 1, 29))
    assert P.year(2024) == (date(2024, 1, 1), date(2025, 1, 1))
    assert P.year_to_date(as_of) == (date(2026, 1, 1), date(2026, 4, 1))
    assert P.day(as_of) == (as_of, date(2026, 4, 1))
    assert P.days_back(as_of, 30) == date(2026, 3, 1)
    assert P.inclusive("2024-01-22", "2024-01-28") == (date(2024, 1, 22), date(2024, 1, 29))


def test_presentation(spark):
    df = spark.createDataFrame(
        [("Canine", 202401, "01 Jan 2024 - 07 Jan 2024", None, 5.0)],
        "patient_species string, sort_key int, week_range string, growth_pct double, revenue double",
    )
    named = present.business_aliases(df)
    assert named.columns[0] == "species"
    assert "sort_key" not in present.drop_internal(named).columns
    shown = present.display_labels(present.drop_internal(named))
    assert shown.columns == ["Species", "Week", "Growth %", "Revenue"]
    assert present.null_to_zero(df).first()["growth_pct"] == 0.0
    assert present.non_zero_rows(df, "revenue").count() == 1
    assert present.add_trend(df).first()["trend"] is None
    monthly = df.withColumn("month_label", F.lit("2024-01"))
    title = present.granularity_title(monthly, "Sales", "Monthly").first()
    assert tuple(title) == ("Sales (Monthly)", "2024-01", "2024-01")
