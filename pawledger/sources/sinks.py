"""Sinks: the tidy export, the run log, runs that may be repeated, and the stored fact."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pawledger.functions import periods as P

PREVIEW_ROWS = 50
#: Lists merged at once, and how often.
MERGED, LEVELS = 64, 4
TASK_BITS = 33


def write_tidy(
    tidy: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """All dashboard figures as long rows, in any file format Spark writes."""
    writer = tidy.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def first_rows(result: DataFrame, row: Column, rows: int = PREVIEW_ROWS) -> DataFrame:
    """One row: ``row_count``, and in ``first`` the first values of ``row`` in the order of the tasks.

    Each task keeps its first rows. Their lists are merged in a tree: those of MERGED tasks, then of
    as many groups, and so on; each merge keeps the first rows only, so none reads more than MERGED
    lists, up to MERGED ** LEVELS tasks.
    """
    numbered = result.select(row.alias("row"), F.monotonically_increasing_id().alias("number"))
    # The upper bits number the task, the lower TASK_BITS its rows.
    early = F.col("number").bitwiseAND((1 << TASK_BITS) - 1) < rows
    merged = numbered.withColumn("task", F.shiftright("number", TASK_BITS))
    count, kept = F.count(F.lit(1)), F.collect_list(F.when(early, F.struct("number", "row")))
    for level in range(1, LEVELS + 1):
        keys = [F.floor(F.col("task") / MERGED).alias("task")] if level < LEVELS else []
        merged = merged.groupBy(*keys).agg(count.alias("row_count"), kept.alias("kept"))
        merged = merged.withColumn("kept", F.slice(F.sort_array("kept"), 1, rows))
        count, kept = F.coalesce(F.sum("row_count"), F.lit(0)), F.flatten(F.collect_list("kept"))
    return merged.select("row_count", F.transform("kept", lambda k: k["row"]).alias("first"))


def result_step(
    result: DataFrame, step_id: int, description: str, sql: str, result_alias: str
) -> DataFrame:
    """One log step for a finished result: row count, columns, first rows.

    Count and preview come from one pass: each task keeps its first rows, and
    the first of those, in the order of the tasks, are shown.
    """
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    merged = first_rows(result, row).withColumnRenamed("first", "data_preview")
    return merged.select(
        F.lit(step_id).alias("step_id"),
        F.lit(description).alias("description"),
        F.lit(sql).alias("sql"),
        F.lit(result_alias).alias("result_alias"),
        F.lit(True).alias("success"),
        "row_count",
        F.lit(result.columns).alias("columns"),
        F.lit(None).cast("string").alias("error"),
        "data_preview",
    )


def shorten_previews(log: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """Log records whose steps keep only their first preview rows."""
    short = F.transform(
        "sql_steps",
        lambda step: step.withField("data_preview", F.slice(step["data_preview"], 1, rows)),
    )
    return log.withColumn("sql_steps", short)


def append_run_log(log: DataFrame, path: str, fmt: str = "json") -> None:
    """Append run records with their nested steps; JSON lines or parquet."""
    shorten_previews(log).write.mode("append").format(fmt).save(path)


def write_run(rows: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> None:
    """Add the rows of one run, in a partition ``run_id`` of their own.

    A run that is written again replaces what it wrote before and leaves other
    runs alone, so a job that failed or ran twice can be repeated. The partition
    is exchanged when all tasks are done. A run without rows leaves none.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"a run id has letters, digits, '_', '.' and '-' only: {run_id!r}")
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    writer = counted.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("run_id").save(path)
    if seen.get["n"] == 0:
        rows.limit(0).write.mode("overwrite").format(fmt).save(f"{path}/run_id={run_id}")


def write_fact(invoices: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store invoice lines by month of service; reports then read the months they ask for.

    The months that occur in the lines are replaced whole, others stay as they
    are. Months are split or put together by their size (rebalance), so neither a
    large one nor the lines without a date end in one task; inside a file lines
    are sorted by date.
    """
    day = F.col(P.SERVICE_DATE)
    rows = invoices.withColumn(P.SERVICE_MONTH, F.year(day) * 100 + F.month(day))
    rows = rows.hint("rebalance", F.col(P.SERVICE_MONTH))
    writer = rows.sortWithinPartitions(P.SERVICE_MONTH, P.SERVICE_DATE).write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(P.SERVICE_MONTH)
    writer.format(fmt).save(path)
