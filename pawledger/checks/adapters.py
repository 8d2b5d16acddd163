"""Logical tables derived from the benchmark's parquet tables.

The trade is a stand-in, the shapes are those of a clinic: a wide invoice-line
fact, an event-like visit fact, small dimensions and a query log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Category names by key, with the dirty variants of real data.
CATEGORIES = (
    "Prescription",
    "Prescription 12%",
    "Prescription  12%",
    "Pet Shop  18%",
    "Pet shop 18%",
    "Non-Prescription Items",
    "Diets/Food",
    "Pathology",
    "Laboratory",
    "Consultation",
    "Preventive Medicine 12%",
    "Medvet",
    "At Home Protocols",
    "Surgery",
    "Imaging",
    "Cardiology",
    "Parenteral Medication",
    "Parenteral Medication 12%",
    "Parenteral Fluids",
    "Preventive Medicine",
    "Anesthesia Gas",
    "Anesthesia Parenteral",
    "Sedation",
    "Non Prescription Items",
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
    "New Category",
    "Body Care",
    "Office Supplies",
    "Canine Education",
    "General Education",
    "Exotics Education",
    "Birds Education",
    "Instructions",
    "Diets\\Food",
    "PRESCRIPTION",
    "Gift Cards",
)
BREEDS = ("Beagle", "Indie", "Persian", None, "Siamese")
SPECIES = ("Canine", "Canine", "Canine", "Feline", "Feline", "Rabbit", "Avian")
VISIT_SPECIES = (*SPECIES[:6], None)
CLINICS = ((1, "North"), (2, "South"), (3, "East"), (4, "West"))

# SQL texts of the log's steps; {d} is the request's date.
LOG_SQL = (
    "SELECT SUM(total) AS revenue FROM visit_lines WHERE cancelled = 0 AND performed_date >= '{d}'",
    "SELECT * FROM step_one",
    "SELECT 'FROM step_one' AS note, COUNT(*) FROM visit_lines -- JOIN step_two",
    "SELECT SUM(i.invoice_amount) AS r FROM old_invoices i"
    " WHERE i.performed_date BETWEEN '{d}' AND '{d}'",
    "DELETE FROM visit_lines WHERE performed_date < '{d}'",
    "with step_two as (select 1) select * from step_two",
    "SELECT YEAR(performed_date) AS year_month FROM visit_lines WHERE YEAR(performed_date) = 2001",
    "SELECT COUNT(*) FROM visit_lines"
    " WHERE YEAR(performed_date) = 2001 AND MONTH(performed_date) = 7",
    "SELECT COUNT(*) FROM visit_lines WHERE cancelled = 'FALSE' /* JOIN step_one */",
    "  explain SELECT * FROM db.step_two WHERE x = 1",
    "",
    "UPDATE step_two SET note = 'it''s FROM step_one' WHERE cancelled = FALSE",
    "SELECT 'a -- b' AS n, x FROM step_one",
    "SELECT '/* ' AS a FROM step_two WHERE b = ' */'",
    "SELECT 'it''s # one' AS n, \"-- two\" AS m FROM step_two",
    "SELECT 1 /* it's */ AS a FROM step_one -- don't JOIN step_two",
    "WITH q AS (SELECT 1 AS a) INSERT INTO kept SELECT a FROM q",
    "WITH q AS (SELECT x FROM (SELECT 1 AS x) y) DELETE FROM kept WHERE a IN (SELECT x FROM q)",
    "SELECT * FROM `old_stock` s JOIN db.step_one t ON t.a = s.a",
    "SELECT 'open FROM step_one",
)
# Tables that no step of the log may read.
BANNED = ("old_invoices", "old_stock")
LOG_ERRORS = (
    None,
    "Rate limit reached for model",
    None,
    "HTTP 429 while waiting, connection timed out",
    "(pymysql.err.OperationalError) lost connection",
    "Unknown column 'x' in 'field list'",
    None,
    "Table 'db.y' doesn't exist",
    "Traceback (most recent call last)",
    "something odd happened",
    None,
)


_SCHEMAS: dict[str, T.StructType] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A raw table; its schema is read from the files only once."""
    path = f"{sf_dir}/{table}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _pick(values: tuple, key: Column) -> Column:
    items = F.array(*[F.lit(v) for v in values])
    return F.element_at(items, (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def invoices(spark: SparkSession, sf_dir: str, item_names: bool = False) -> DataFrame:
    """Invoice lines from lineitem and orders.

    The item table only adds the item's name, and every line has an item; so
    it is joined only for reports that show names. The conditions are never
    NULL, so filters on the derived columns turn into filters of the scan.
    """
    order, part = F.col("o_orderkey"), F.col("l_partkey")
    served = ~(order % 97).eqNullSafe(0)
    is_open = ~F.col("o_orderstatus").eqNullSafe("P")
    patient = F.col("o_custkey") * 2 + part % 2
    lines = load(spark, sf_dir, "lineitem").join(
        load(spark, sf_dir, "orders"), F.col("l_orderkey") == order
    )
    name = F.lit(None).cast("string")
    if item_names:
        lines = lines.join(load(spark, sf_dir, "part"), part == F.col("p_partkey"))
        name = F.col("p_name")
    return lines.select(
        _text(order).alias("invoice_id"),
        F.concat(_text(order), F.lit("-"), _text("l_linenumber")).alias("sales_id"),
        (F.col("o_orderdate") + F.make_dt_interval(days=(order % 3).cast("int"))).alias(
            "invoice_date"
        ),
        F.when(served, F.col("o_orderdate")).alias("performed_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("invoice_amount"),
        F.when(is_open, 0).otherwise(1).alias("cancelled"),
        _text("o_custkey").alias("client_id"),
        _text(patient).alias("patient_id"),
        _pick(SPECIES, patient).alias("patient_species"),
        _pick(BREEDS, patient).alias("patient_breed"),
        _text(part).alias("plan_item_id"),
        name.alias("plan_item_name"),
        _pick(CATEGORIES, part).alias("plan_category_name"),
        F.col("l_quantity").cast("decimal(18,3)").alias("quantity"),
        F.col("l_discount").cast("decimal(18,2)").alias("discount"),
        F.col("l_tax").cast("decimal(18,2)").alias("tax_amount"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("total"),
        _text(F.col("l_suppkey") % 3 + 1).alias("clinic_id"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit lines with a time of day, from events."""
    patient = F.col("user_id") * 2 + F.col("event_id") % 2
    return load(spark, sf_dir, "events").select(
        F.concat(_text("user_id"), F.lit("-"), _text(F.to_date("ts"))).alias("invoice_id"),
        F.col("ts").alias("invoice_date"),
        F.col("ts").alias("performed_date"),
        F.when(~F.col("event_type").eqNullSafe("error"), 0).otherwise(1).alias("cancelled"),
        _text("user_id").alias("client_id"),
        _text(patient).alias("patient_id"),
        _pick(VISIT_SPECIES, patient).alias("patient_species"),
        _pick(CATEGORIES, F.col("event_id")).alias("plan_category_name"),
        F.col("value").cast("decimal(18,2)").alias("total"),
    )


def _date_plus(start: str, days: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), days.cast("int"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered clients; three in ten have no row."""
    key = F.col("c_custkey")
    return (
        load(spark, sf_dir, "customer")
        .filter(key % 10 < 7)
        .select(
            _text(key).alias("client_id"),
            _date_plus("1995-01-01", key * 7919 % 2400).cast("timestamp_ntz").alias("first_activity"),
        )
    )


def _visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("user_id").distinct()


def visit_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("user_id")
    return (
        _visitors(spark, sf_dir)
        .filter(key % 10 < 8)
        .select(
            _text(key).alias("client_id"),
            _date_plus("2023-12-01", key * 13 % 60).cast("timestamp_ntz").alias("first_activity"),
        )
    )


def _two_patients(owners: DataFrame, owner: str, first_birth: str) -> DataFrame:
    twins = owners.select(
        F.col(owner).alias("owner"),
        F.explode(F.array(F.col(owner) * 2, F.col(owner) * 2 + 1)).alias("k"),
    )
    birth = _date_plus(first_birth, F.col("k") * 37 % 5000)
    return twins.select(
        _text("k").alias("patient_id"),
        _text("owner").alias("client_id"),
        F.when(F.col("k") % 100 != 0, birth).alias("birth_date"),
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two patients per client; one in a hundred without birth date."""
    return _two_patients(load(spark, sf_dir, "customer"), "c_custkey", "1985-01-01")


def visit_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_patients(_visitors(spark, sf_dir), "user_id", "2010-01-01")


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item and clinic, with negative quantities and missing costs."""
    part, clinic = F.col("p_partkey"), F.col("c")
    rows = load(spark, sf_dir, "part").withColumn("c", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return rows.select(
        _text(part).alias("stock_id"),
        _text(part * 3 + clinic).alias("stock_consumed_id"),
        F.col("p_name").alias("stock_name"),
        _text(part).alias("plan_item_id"),
        F.col("p_name").alias("plan_item_name"),
        _pick(CATEGORIES, part).alias("plan_category_name"),
        (F.col("p_size") - 8 - clinic).cast("decimal(18,3)").alias("onhand_qty"),
        F.when(part % 50 != 0, F.col("p_retailprice").cast("decimal(18,2)")).alias("purchase_cost"),
        _text(clinic).alias("clinic_id"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        _text("o_orderkey").alias("payment_id"),
        _text("o_orderkey").alias("invoice_id"),
        _text("o_custkey").alias("client_id"),
        F.col("o_orderdate").alias("payment_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("payment_amount"),
        F.col("o_orderpriority").alias("payment_type_name"),
        F.when(F.col("o_orderkey") % 20 == 0, 1).otherwise(0).alias("is_return"),
        F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0).alias("is_membership"),
    )


def clinic(spark: SparkSession) -> DataFrame:
    """Four clinics; the last one has no invoice."""
    rows = [
        F.struct(F.lit(str(i)).alias("clinic_id"), F.lit(name).alias("clinic_name"))
        for i, name in CLINICS
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged request of two steps per order."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")

    def step(number: int, alias: str) -> Column:
        text = F.replace(_pick(LOG_SQL, key + number * 5), F.lit("{d}"), day)
        return F.struct(
            F.lit(number).alias("step_id"),
            F.lit(f"step {number}").alias("description"),
            text.alias("sql"),
            F.lit(alias).alias("result_alias"),
        )

    return load(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("REQ-"), _text(key)).alias("request_id"),
        F.concat(F.lit("report for "), day).alias("query"),
        F.array(step(1, "step_one"), step(2, "step_two")).alias("sql_steps"),
        _pick(LOG_ERRORS, key).alias("error"),
    )
