"""State that is carried from day to day, so that no report reads all history again.

The client state has a row for each client: first and last day of service and the
number of such days. The state through one day is the stored one through an
earlier day, merged with the lines between them.

Distinct clients of any period are counted exactly from bitmaps: each client has a
number, each day one bit for each client seen, and a period is the OR of its days.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pawledger.functions import periods as P
from pawledger.functions.rules import PHANTOM_CLIENT

#: Bits of a row's number inside its task.
PLACE_BITS = 33


# --- client state ----------------------------------------------------------


def client_days(
    invoices: DataFrame, period: P.Period | None = None, phantom: str = PHANTOM_CLIENT
) -> DataFrame:
    """client_id, first_day, last_day and visit_days (days with a line) of a period."""
    rows = P.exclude_phantom(P.period_rows(invoices, period), phantom=phantom)
    days = rows.select("client_id", F.to_date(P.SERVICE_DATE).alias("day")).distinct()
    return days.groupBy("client_id").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count(F.lit(1)).alias("visit_days"),
    )


def merged(state: DataFrame, later: DataFrame) -> DataFrame:
    """Two states over days that do not overlap, as one."""
    return (
        state.unionByName(later)
        .groupBy("client_id")
        .agg(
            F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
            F.sum("visit_days").alias("visit_days"),
        )
    )


def state_at(spark: SparkSession, path: str, through: date) -> DataFrame:
    """The stored state through a day."""
    return spark.read.parquet(f"{path}/through={through.isoformat()}")


def advance(
    invoices: DataFrame,
    path: str,
    through: date,
    since: date | None = None,
    phantom: str = PHANTOM_CLIENT,
) -> DataFrame:
    """Store the state through a day, from the stored one through ``since`` and the lines after it.

    Without ``since`` all lines are read. Each state lies in a folder of its own,
    so a day may be repeated: it is built again from the same earlier state.
    """
    if since is not None and since >= through:
        raise ValueError(f"a state through {since} cannot be advanced to {through}")
    spark = invoices.sparkSession
    start = None if since is None else since + timedelta(days=1)
    state = client_days(invoices, P.up_to(through, start), phantom)
    if since is not None:
        state = merged(state_at(spark, path, since), state)
    state.write.mode("overwrite").parquet(f"{path}/through={through.isoformat()}")
    return state_at(spark, path, through)


def known_clients(state: DataFrame, clients: DataFrame, before: date) -> DataFrame:
    """Ids of clients registered or served before a date, from the state through the day before it."""
    registered = clients.filter(P.in_range("first_activity", end=before))
    ids = registered.select("client_id").union(state.select("client_id"))
    return P.exclude_phantom(ids).distinct()


# --- distinct counts -------------------------------------------------------


def numbered(ids: DataFrame, path: str, known: DataFrame | None = None) -> DataFrame:
    """client_id and number for all ids: ``known`` ones as they are, new ones after them, without
    gaps from 1 on.

    The new ids are written to ``path``, each with its task and its place there;
    the tasks' counts (one row each) give the offsets. NULL has no number.
    """
    spark = ids.sparkSession
    fresh = ids.select("client_id").filter("client_id IS NOT NULL").distinct()
    highest = 0
    if known is not None:
        fresh = fresh.join(known, "client_id", "left_anti")
        highest = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    row = F.monotonically_increasing_id()
    placed = fresh.select(
        "client_id",
        F.shiftright(row, PLACE_BITS).alias("task"),
        row.bitwiseAND((1 << PLACE_BITS) - 1).alias("place"),
    )
    placed.write.mode("overwrite").parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    tasks = placed.groupBy("task").agg(F.count(F.lit(1)).alias("size"))
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = tasks.select("task", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    number = F.col("place") + F.col("offset") + (highest + 1)
    new = placed.join(F.broadcast(offsets), "task").select("client_id", number.alias("number"))
    return new if known is None else known.select("client_id", "number").unionByName(new)


def day_bitmaps(
    invoices: DataFrame,
    numbers: DataFrame,
    period: P.Period | None = None,
    dims: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """day, dims, bucket and bits: the clients of each day as bitmaps of 32,768 numbers each.

    Lines of clients without a number are left out. Lines become one row for each
    client, day and dims before they meet the numbers.
    """
    dims = dims or {}
    columns = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in dims.items()]
    rows = P.period_rows(invoices, period)
    seen = rows.select("client_id", F.to_date(P.SERVICE_DATE).alias("day"), *columns).distinct()
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    return seen.join(numbers, "client_id").groupBy("day", *dims, bucket).agg(bits)


def distinct_counts(
    bitmaps: DataFrame,
    by: Mapping[str, Column | str] | None = None,
    period: P.Period | None = None,
    name: str = "client_count",
) -> DataFrame:
    """Distinct clients of a period by any columns over day and dims; the lines are not read again."""
    by = by or {}
    columns = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in by.items()]
    rows = bitmaps.filter(P.in_period("day", period))
    whole = rows.groupBy(*columns, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    count = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))
    return whole.groupBy(*by).agg(count.alias(name))
