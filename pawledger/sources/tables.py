"""Logical tables and how to read them.

Schemas are explicit. A source description is a plain mapping of reader
options, so the same call reads parquet, another file format or JDBC.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
QUANTITY = T.DecimalType(18, 3)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


INVOICES = _struct(
    invoice_id=T.StringType(),
    sales_id=T.StringType(),
    invoice_date=T.TimestampNTZType(),
    performed_date=T.TimestampNTZType(),
    invoice_type=T.StringType(),
    invoice_amount=MONEY,
    cancelled=T.IntegerType(),
    client_id=T.StringType(),
    client_unique_id=T.StringType(),
    patient_id=T.StringType(),
    patient_species=T.StringType(),
    patient_breed=T.StringType(),
    patient_gender=T.StringType(),
    plan_item_id=T.StringType(),
    plan_item_name=T.StringType(),
    plan_category_id=T.StringType(),
    plan_category_name=T.StringType(),
    plan_sub_category_id=T.StringType(),
    plan_sub_category_name=T.StringType(),
    quantity=QUANTITY,
    purchase_cost=MONEY,
    cost=MONEY,
    discount=MONEY,
    tax_amount=MONEY,
    total=MONEY,
    clinic_id=T.StringType(),
)
STOCKS = _struct(
    stock_id=T.StringType(),
    stock_consumed_id=T.StringType(),
    stock_name=T.StringType(),
    plan_item_id=T.StringType(),
    plan_item_name=T.StringType(),
    plan_category_id=T.StringType(),
    plan_category_name=T.StringType(),
    plan_sub_category_id=T.StringType(),
    plan_sub_category_name=T.StringType(),
    onhand_qty=QUANTITY,
    threshold_qty=QUANTITY,
    reorder_qty=QUANTITY,
    purchase_cost=MONEY,
    sales_markup=MONEY,
    orderable=T.StringType(),
    bin_id=T.StringType(),
    bin_name=T.StringType(),
    bin_location=T.StringType(),
    clinic_id=T.StringType(),
)
PATIENTS = _struct(
    patient_id=T.StringType(),
    patient_name=T.StringType(),
    client_id=T.StringType(),
    clinic_id=T.StringType(),
    birth_date=T.DateType(),
    first_activity=T.TimestampNTZType(),
    last_activity=T.TimestampNTZType(),
    status=T.StringType(),
)
CLIENTS = _struct(
    client_id=T.StringType(),
    first_name=T.StringType(),
    last_name=T.StringType(),
    city=T.StringType(),
    state=T.StringType(),
    first_activity=T.TimestampNTZType(),
    last_activity=T.TimestampNTZType(),
    status=T.StringType(),
    clinic_id=T.StringType(),
)
PAYMENTS = _struct(
    payment_id=T.StringType(),
    invoice_id=T.StringType(),
    client_id=T.StringType(),
    payment_date=T.TimestampNTZType(),
    payment_amount=MONEY,
    payment_type_name=T.StringType(),
    is_return=T.IntegerType(),
    is_membership=T.IntegerType(),
)
CLINIC = _struct(
    clinic_id=T.StringType(),
    clinic_name=T.StringType(),
    clinic_city=T.StringType(),
    clinic_state=T.StringType(),
    currency=T.StringType(),
)

SQL_STEP = _struct(
    step_id=T.IntegerType(),
    description=T.StringType(),
    sql=T.StringType(),
    result_alias=T.StringType(),
    success=T.BooleanType(),
    row_count=T.LongType(),
    columns=T.ArrayType(T.StringType()),
    error=T.StringType(),
    data_preview=T.ArrayType(T.StringType()),
)
QUERY_LOG = _struct(
    timestamp=T.StringType(),
    request_id=T.StringType(),
    query=T.StringType(),
    plan=T.StringType(),
    sql_steps=T.ArrayType(SQL_STEP),
    analysis=T.StringType(),
    insights=T.StringType(),
    error=T.StringType(),
)

SCHEMAS = {
    "invoices": INVOICES,
    "stocks": STOCKS,
    "patients": PATIENTS,
    "clients": CLIENTS,
    "payments": PAYMENTS,
    "clinic": CLINIC,
    "query_log": QUERY_LOG,
}


# Formats whose files name and type their own columns.
TYPED_FORMATS = ("parquet", "orc", "avro", "jdbc")
SPLIT = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}


def reader_options(name: str, cfg: Mapping[str, str]) -> tuple[str, dict[str, str]]:
    """Format and options of a source.

    For JDBC the table name defaults to the logical name, and the read has to
    be split by ``partitionColumn`` with its bounds; ``single_connection``
    set to ``true`` opts out, for small tables.
    """
    options = dict(cfg)
    fmt = options.pop("format", "parquet")
    options.pop("more_columns", None)
    if fmt == "jdbc":
        options.setdefault("dbtable", name)
        options.setdefault("fetchsize", "10000")
        options.setdefault("preferTimestampNTZ", "true")
        single = options.pop("single_connection", "false").lower() == "true"
        if not (SPLIT <= options.keys() or single and not SPLIT & options.keys()):
            raise ValueError(f"a JDBC read needs {sorted(SPLIT)}, or single_connection")
    elif "path" not in options:
        raise ValueError(f"source {name!r} needs a path")
    return fmt, options


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Known columns in their types, missing ones as NULL, unknown ones as they are.

    Only columns of another type are cast, so that filters on the others still
    reach the source.
    """
    found = {f.name.lower(): f for f in df.schema.fields}
    known = []
    for field in schema.fields:
        own = found.pop(field.name.lower(), None)
        if own is None:
            known.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif own.dataType == field.dataType:
            known.append(F.col(own.name).alias(field.name))
        else:
            known.append(F.col(own.name).cast(field.dataType).alias(field.name))
    return df.select(*known, *[F.col(f.name) for f in found.values()])


def read_table(spark: SparkSession, name: str, cfg: Mapping[str, str]) -> DataFrame:
    """A logical table with its known columns, and all others the source has.

    Text formats have no types of their own; ``more_columns`` names their
    unknown columns as DDL.
    """
    schema = SCHEMAS[name]
    fmt, options = reader_options(name, cfg)
    reader = spark.read.format(fmt).options(**options)
    if fmt in TYPED_FORMATS:
        return conform(reader.load(), schema)
    more = T.StructType.fromDDL(cfg["more_columns"]).fields if cfg.get("more_columns") else []
    return reader.schema(T.StructType([*schema.fields, *more])).load()
