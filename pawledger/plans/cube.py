"""The weeks of a dashboard, read once and stored as few added-up lines.

Each metric needs the lines by other columns. One scan adds them up for all of
them by grouping sets, and the sums are stored in one folder for each part. A
part has the fact's columns, so a metric reads it as it would read the lines:
sums of sums and distinct counts are the same, only hours, weeks or clients are
one line each. Columns that a part's metrics don't read are NULL there.
"""

from __future__ import annotations

from collections.abc import Collection
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawledger.functions import periods as P
from pawledger.operators import weekly

#: The columns that tell the lines of a part apart; those of `client` and `visit`
#: are of the reported week alone.
PARTS = {
    "hour": ["hour"],
    "bill": ["week", "species", "invoice"],
    "category": ["week", "category"],
    "client": ["own_week", "own_client", "own_species"],
    "visit": ["own_week", "own_time", "own_patient", "own_species", "own_invoice"],
}
OWN = ("client", "visit")
#: The part that each metric of the fact reads.
PART_OF = {
    "total_sales": "hour",
    "day_night_split": "hour",
    "species_sales": "bill",
    "invoice_count_by_species": "bill",
    "category_top": "category",
    "repeat_customers": "client",
    "new_vs_existing_customers": "client",
    "new_vs_existing_revenue": "client",
    "life_stage_metrics": "visit",
}


def added_up(
    fact: DataFrame, ws: date, we: date, prior_weeks: int, parts: Collection[str] = tuple(PARTS)
) -> DataFrame:
    """The fact's columns and ``part``: the lines of the weeks, added up once for each part.

    Lines are combined before the shuffle, so a client or an invoice with very
    many of them is a line for each task. Lines of earlier weeks are one line
    for each part of the week alone, and left out after that. A week
    that begins before the compared ones stands at their first day.
    """
    kind = fact.schema[P.SERVICE_DATE].dataType
    time = F.col(P.SERVICE_DATE)
    rows = weekly.window_rows(fact, ws, we, prior_weeks)
    first = F.lit(P.weeks_back(ws, prior_weeks))
    current = F.col("week_bucket") == F.lit(ws)

    # Taken off and not truncated, so that the session's time zone never enters.
    past_hour = F.make_dt_interval(mins=F.minute(time), secs=F.extract(F.lit("SECOND"), time))

    def own(column: Column) -> Column:
        return F.when(current, column)

    keys = {
        "hour": (time - past_hour).cast(kind),
        "week": F.greatest("week_bucket", first).cast(kind),
        "species": F.col("patient_species"),
        "invoice": F.col("invoice_id"),
        "category": F.col("plan_category_name"),
        "own_week": own(F.lit(ws).cast(kind)),
        "own_time": own(time),
        "own_client": own(F.col("client_id")),
        "own_patient": own(F.col("patient_id")),
        "own_species": own(F.col("patient_species")),
        "own_invoice": own(F.col("invoice_id")),
    }
    sets = {part: PARTS[part] for part in PARTS if part in parts}
    # Every key belongs to a set and is NULL in the sets without it.
    used = [k for k in keys if any(k in s for s in sets.values())]
    # The first column of a set that no set before it has tells it from the others.
    sign = {"hour": "hour", "bill": "invoice", "category": "category", "client": "own_client", "visit": "own_time"}
    named = F.coalesce(*[F.when(F.grouping(sign[part]) == 0, part) for part in sets])
    sums = (
        rows.select("total", *[keys[k].alias(k) for k in used])
        .groupingSets(list(sets.values()), *used)
        .agg(named.alias("part"), F.sum("total").alias("sum"))
    )

    def cell(name: str, *choices: str) -> Column:
        given = [F.col(c) for c in choices if c in used]
        value = F.coalesce(*given) if given else F.lit(None)
        return value.cast(fact.schema[name].dataType).alias(name)

    if "own_week" in used:
        sums = sums.filter(~F.col("part").isin(*OWN) | F.col("own_week").isNotNull())
    return sums.select(
        "part",
        cell("invoice_id", "invoice", "own_invoice"),
        cell("client_id", "own_client"),
        cell("patient_id", "own_patient"),
        cell("patient_species", "species", "own_species"),
        cell("plan_category_name", "category"),
        F.col("sum").alias("total"),
        cell(P.SERVICE_DATE, "hour", "week", "own_time", "own_week"),
    )


def write_cube(
    fact: DataFrame,
    path: str,
    ws: date,
    we: date,
    prior_weeks: int = weekly.PRIOR_WEEKS,
    parts: Collection[str] = tuple(PARTS),
) -> DataFrame:
    """The added-up lines, stored below ``path`` by part; what lay there is replaced.

    Without lines the folder is empty and so is every part.
    """
    cube = added_up(fact, ws, we, prior_weeks, parts)
    cube.write.mode("overwrite").partitionBy("part").parquet(path)
    return fact.sparkSession.read.schema(cube.schema).parquet(path)


def part(cube: DataFrame, name: str) -> DataFrame:
    """The lines of one part; only its folder is read."""
    return cube.filter(F.col("part") == name).drop("part")
