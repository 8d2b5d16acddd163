"""Derived views of the invoice fact, and ad-hoc SQL over all tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawledger.functions import columns as C
from pawledger.functions import periods as P
from pawledger.functions import rules


def invoice_life_stage(
    invoices: DataFrame,
    patients: DataFrame,
    date_col: str = P.SERVICE_DATE,
    stages: Mapping[str, rules.LifeStages] = rules.LIFE_STAGES,
) -> DataFrame:
    """Every invoice line with birth date, age at the visit and life stage.

    A line without a known patient keeps its revenue and gets NULLs. Patients
    are unique, so the fact is the only side that can be skewed and the
    adaptive skew join may split it. Lines without a patient id are kept out of
    the join, where they would all meet in one task.
    """
    births = patients.select("patient_id", "birth_date")
    known = invoices.filter(F.col("patient_id").isNotNull()).join(births, "patient_id", "left")
    columns = [*invoices.columns, "birth_date"]
    unknown = invoices.filter(F.col("patient_id").isNull())
    unknown = unknown.withColumn("birth_date", F.lit(None).cast(births.schema["birth_date"].dataType))
    joined = known.select(*columns).union(unknown.select(*columns))
    return with_stage(joined, date_col, stages)


def with_stage(
    aged: DataFrame, date_col: str, stages: Mapping[str, rules.LifeStages]
) -> DataFrame:
    """Age in months and life stage at the visit, from the birth date."""
    rows = aged.withColumn("age_months_at_visit", C.age_months("birth_date", date_col))
    stage = C.life_stage("patient_species", "age_months_at_visit", stages)
    return rows.withColumn("life_stage", stage)


def staged_lines(
    invoices: DataFrame,
    patients: DataFrame,
    date_col: str = P.SERVICE_DATE,
    stages: Mapping[str, rules.LifeStages] = rules.LIFE_STAGES,
) -> DataFrame:
    """Only the lines that have a life stage: an inner join on few species."""
    births = patients.filter(F.col("birth_date").isNotNull()).select("patient_id", "birth_date")
    staged = invoices.filter(F.col("patient_species").isin(list(stages)))
    rows = with_stage(staged.join(births, "patient_id"), date_col, stages)
    return rows.filter(F.col("life_stage").isNotNull())


def category_normalized(
    invoices: DataFrame, bucket_rules: Sequence[rules.Rule] = rules.LOGICAL_CATEGORY_RULES
) -> DataFrame:
    """Every invoice line with its consolidated category name."""
    label = C.logical_category("plan_category_name", bucket_rules)
    return invoices.withColumn("logical_category", label)


def register_views(
    spark: SparkSession, tables: Mapping[str, DataFrame], prefix: str = ""
) -> None:
    """Temp views for ``spark.sql``: the given tables and the two derived views."""
    views = dict(tables)
    if "invoices" in tables:
        views["category_normalized"] = category_normalized(tables["invoices"])
        if "patients" in tables:
            views["invoice_life_stage"] = invoice_life_stage(
                tables["invoices"], tables["patients"]
            )
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)


def ask(
    spark: SparkSession, sql: str, args: Mapping[str, Any] | Sequence[Any] | None = None
) -> DataFrame:
    """Result of one read-only statement over the registered views.

    ``args`` fills the statement's parameters: ``:name`` from a mapping, ``?``
    from a list, as values and never as text. The statement is told by its first
    word; one that begins with WITH may still end as an insert, and is refused
    unless it can stand in parentheses, where only a query can. Nothing runs
    before. NULL numbers come back as zero, as in every ad-hoc report.
    """
    words = sql.split(None, 1)
    first = words[0].upper() if words else ""
    if first not in rules.READ_ONLY_STATEMENTS:
        raise ValueError(f"only {', '.join(rules.READ_ONLY_STATEMENTS)} are permitted")
    if first == "WITH":
        inner = sql.rstrip().rstrip(";")
        try:
            spark.sql(f"SELECT * FROM (\n{inner}\n)", args=args)
        except ParseException as error:
            raise ValueError("WITH is permitted before a query only") from error
    return spark.sql(sql, args=args).na.fill(0)
