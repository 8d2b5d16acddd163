"""Business constants that fix the meaning of every metric.

Everything here is a fixed value: names and thresholds as they occur in the
source data. All of it can be overridden through operator parameters.
"""

from __future__ import annotations

from typing import NamedTuple

# Walk-in account: counted as revenue, never as a customer.
PHANTOM_CLIENT = "13"

# Stock entries that are not physical goods (substrings of the lower-case name).
PHANTOM_STOCK_PATTERNS = ("cytopoint", "lasix 10mg")


class Rule(NamedTuple):
    """One branch of a category mapping: exact names and SQL LIKE patterns."""

    label: str
    names: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


# Five revenue groups of invoice categories; the first match wins.
CATEGORY_GROUP_RULES = (
    Rule("Diagnostics", ("Pathology", "Laboratory", "Imaging", "Cardiology")),
    Rule(
        "Pharmacy",
        (
            "Parenteral Medication",
            "Parenteral Fluids",
            "Parenteral Medication 12%",
            "Anesthesia Gas",
            "Anesthesia Parenteral",
            "Sedation",
        ),
        ("Prescription%", "Preventive Medicine%"),
    ),
    Rule(
        "Clinical Services",
        (
            "Consultation",
            "Surgery",
            "Hospitalization & Care",
            "Procedure",
            "Grooming",
            "Swimming",
            "Boarding",
            "Registration",
            "Behavior",
            "Euthanasia",
            "Certificates",
            "Exam",
            "Telephone",
            "Neoplasia / Tumor",
            "Medvet",
            "New Category",
            "Body Care",
            "Office Supplies",
        ),
    ),
    Rule(
        "Food & Pet Shop",
        ("Diets/Food", "Non Prescription Items"),
        ("Pet Shop%", "Non%Prescription Items%"),
    ),
)

# The variant of the grouping used by the weekly and monthly
# reports, where education and home protocols count as clinical services.
CATEGORY_GROUP_TREND_RULES = (
    CATEGORY_GROUP_RULES[0],
    Rule(
        "Pharmacy",
        (
            "Parenteral Medication",
            "Parenteral Fluids",
            "Preventive Medicine",
            "Preventive Medicine 12%",
            "Anesthesia Gas",
            "Anesthesia Parenteral",
            "Sedation",
        ),
        ("Prescription%",),
    ),
    Rule(
        "Clinical Services",
        CATEGORY_GROUP_RULES[2].names
        + (
            "Canine Education",
            "General Education",
            "Exotics Education",
            "Birds Education",
            "At Home Protocols",
            "Instructions",
        ),
    ),
    CATEGORY_GROUP_RULES[3],
)

# Groups of stock categories.
STOCK_GROUP_RULES = (
    Rule(
        "Pharmacy",
        (
            "Parenteral Medication",
            "Parenteral Fluids",
            "Preventive Medicine",
            "Preventive Medicine 12%",
            "Anesthesia Gas",
            "Anesthesia Parenteral",
            "Sedation",
        ),
        ("Prescription%",),
    ),
    Rule("Food", ("Diets/Food",)),
    Rule("Pet Shop", (), ("Pet Shop%", "Non%Prescription Items%")),
)

# Name variants that are reported as one category.
LOGICAL_CATEGORY_RULES = (
    Rule("Prescription (All)", (), ("Prescription%",)),
    Rule("Pet Shop (All)", (), ("Pet Shop%", "Non%Prescription Items%")),
)

# Inventory valuation buckets of the weekly dashboard.
INVENTORY_FOOD_NAMES = ("Diets/Food", "Diets\\Food")
INVENTORY_PHARMACY_NAMES = (
    "Parenteral Medication",
    "Parenteral Fluids",
    "Preventive Medicine",
    "Anesthesia Gas",
    "Anesthesia Parenteral",
    "Sedation",
    "Medvet",
)
INVENTORY_PHARMACY_PREFIXES = ("Prescription", "Preventive Medicine")

# Species with their own bucket, and the label of the rest.
MAIN_SPECIES = ("Canine", "Feline")
OTHER_SPECIES = "Others (Exotics)"

# First hour of day, first hour of night, labels.
DAY_HOURS = (9, 21)
DAY_LABEL = "Day (9AM-9PM)"
NIGHT_LABEL = "Night (9PM-9AM)"


class LifeStages(NamedTuple):
    """Stage names of a species; each ends before the age given in months."""

    young: str
    adult_from: int
    senior_from: int


# Life stages per species, in report order.
LIFE_STAGES = {
    "Canine": LifeStages("Puppy", 12, 84),
    "Feline": LifeStages("Kitten", 12, 120),
}

# Fixed value: mean month length used by the dashboard's age, in days.
MEAN_MONTH_DAYS = 30.44

# Trend wording, by growth in per cent.
TREND_THRESHOLD = 10.0
TREND_LABELS = ("Growing ↑", "Declining ↓", "Stable →")

# Warnings of the weekly dashboard; {} is the coverage in per cent.
PARTIAL_WEEK = "Only {}% of week days have data — partial week."
NO_CUSTOMERS = "No customer data for this week."
NO_NEW_CLIENTS = "new_client_ids is empty — clients ETL backfill (from 2010) has not run yet."

# Business names of technical columns in ad-hoc results.
BUSINESS_ALIASES = {
    "patient_species": "species",
    "plan_category_name": "category",
    "plan_item_name": "sku_name",
    "plan_item_id": "sku_id",
    "client_id": "customer_id",
    "onhand_qty": "stock_qty",
    "purchase_cost": "unit_cost",
}

# Column headings of presented tables.
DISPLAY_LABELS = {
    "week_range": "Week",
    "species": "Species",
    "patient_species": "Species",
    "category": "Category",
    "plan_category": "Category",
    "sku_name": "SKU",
    "plan_item_name": "SKU",
    "revenue": "Revenue",
    "growth_pct": "Growth %",
    "invoice_count": "Invoices",
    "customer_count": "Customers",
    "units_sold": "Units Sold",
    "stock_value": "Stock Value",
    "coverage_days": "Coverage Days",
}

# Ordering keys that are never shown.
INTERNAL_COLUMNS = ("sort_key", "week_key", "year_num", "month_num")

# Statements a log step may start with.
READ_ONLY_STATEMENTS = ("SELECT", "WITH", "SHOW", "DESCRIBE", "EXPLAIN")

# Text found in a raw error -> message shown; the first match wins.
_BUSY = "Analytics service is currently busy. Please try again in a few seconds."
_SLOW = "This request is taking longer than expected. Please try again."
_NO_DATA = "Unable to retrieve analytics data at the moment. Please try again shortly."
_FAILED = (
    "The requested analysis could not be completed. "
    "Please contact support if the problem persists."
)
_BUSY_SHORTLY = "Analytics service is currently busy. Please try again shortly."
_UNEXPECTED = "An unexpected error occurred. Please try again."
ERROR_MESSAGES = (
    ("rate limit", _BUSY),
    ("ratelimit", _BUSY),
    ("429", _BUSY),
    ("timed out", _SLOW),
    ("timeout", _SLOW),
    ("pymysql", _NO_DATA),
    ("operationalerror", _NO_DATA),
    ("sqlalchemy", _NO_DATA),
    ("unknown column", _FAILED),
    ("syntax error", _FAILED),
    ("doesn't exist", _FAILED),
    ("openai", _BUSY_SHORTLY),
    ("gpt-", _UNEXPECTED),
    ("traceback", _UNEXPECTED),
    ('file "', _UNEXPECTED),
    ("sk-", _UNEXPECTED),
    ("org-", _UNEXPECTED),
)
DEFAULT_ERROR_MESSAGE = "We were unable to process this request. Please try again."
