from __future__ import annotations

import os
import sys
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from pawledger.sources import tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text) if text else None


def money(value) -> Decimal | None:
    return None if value is None else Decimal(str(value))


@pytest.fixture
def make(spark):
    """Build a logical table from partial rows; missing columns are NULL."""

    def build(name: str, rows: list[dict]):
        schema = tables.SCHEMAS[name]
        defaults = {"cancelled": 0, "quantity": Decimal(1)} if name == "invoices" else {}
        values = []
        for row in rows:
            full = {**defaults, **row}
            for field in schema.fields:
                kind, value = field.dataType.typeName(), full.get(field.name)
                if kind == "timestamp_ntz" and isinstance(value, str):
                    full[field.name] = ts(value)
                elif kind == "date" and isinstance(value, str):
                    full[field.name] = ts(value).date()
                elif kind == "decimal" and value is not None:
                    full[field.name] = money(value)
            values.append(tuple(full.get(f.name) for f in schema.fields))
        return spark.createDataFrame(values, schema)

    return build


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
