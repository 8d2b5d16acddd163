"""Token-budget batches inside length buckets whose bounds minimise padding.

Sequences are whole documents; a longer one than `longest` is cut into pieces of `longest` tokens
and a rest, so nothing is lost. Dynamic programming over the histogram of all sequence lengths (at
most `longest` rows) chooses the bucket bounds. Inside a bucket, sequences are numbered in order of
(doc_id, piece), and every `budget // bound` of them make a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .store import stored
from .tokens import default_path, encoder
from .words import blocks

LONGEST, BUCKETS, BUDGET = 2048, 16, 1 << 16


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens (with one end id) of each document; a null text has the end id alone."""
    path = path or default_path()

    def work(batches):
        code = encoder(path)
        for batch in blocks(batches):
            counts = [len(code.encode(text or "")) // 4 + 1 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_tokens long")


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` bounds, the last the longest length, with the least padding in all.

    Among equal totals the one with fewer buckets, then smaller bounds, is taken.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate(([0], np.cumsum(counts)))
    # Cost of all lengths up to j in buckets: slots of each bucket; the tokens in them are fixed.
    best = lengths * rows[1:]
    choices, totals = [np.zeros(n, np.int64)], [int(best[-1])]
    for _ in range(1, min(buckets, n)):
        new, choice = best.copy(), np.zeros(n, np.int64)
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (rows[j + 1] - rows[1 : j + 1])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], choice[j] = cost[i], i + 1
        choices.append(choice)
        best = new
        totals.append(int(best[-1]))
    level, at, bounds = int(np.argmin(totals)), n, []
    while at:
        bounds.append(int(lengths[at - 1]))
        at = int(choices[level][at - 1])
        level -= 1
        if level < 0:
            break
    return bounds[::-1]


def packed(lengths: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket, bucket_length, batch, slot for each sequence.

    `lengths` has doc_id and n_tokens. bucket_length is the padded length; a batch of a bucket has
    up to max(budget // bucket_length, 1) sequences, numbered from 0 (slot). Rows without a doc_id
    come first. Null lengths and lengths below one have nothing to pack and no rows. Repeated rows
    are packed each. Other columns are ignored; an empty table gives no rows.
    """
    spark = lengths.sparkSession
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("total"))
    rows = rows.where("total > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / longest))))
    start = F.col("piece") * longest
    rows = rows.select("doc_id", "piece", start.alias("start"), F.least(F.col("total") - start, F.lit(longest)).alias("n_tokens"))
    rows = stored(rows, "sequences")
    histogram = rows.groupBy("n_tokens").count().collect()  # at most `longest` rows
    bounds = bucket_bounds(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), buckets)
    bucket = sum((F.when(F.col("n_tokens") > bound, 1).otherwise(0) for bound in bounds), F.lit(0))
    length = F.element_at(F.array(*[F.lit(b) for b in bounds or [1]]), F.col("bucket") + 1).cast("long")
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("bucket_length", length)
    numbered = numbered_rows(rows, "bucket", ["doc_id", "piece", "n_tokens"])
    size = F.greatest(F.floor(F.lit(budget) / F.col("bucket_length")), F.lit(1))
    return numbered.select(
        "doc_id", "piece", "start", "n_tokens", "bucket", "bucket_length",
        F.floor(F.col("number") / size).alias("batch"),
        (F.col("number") % size).alias("slot"),
    )


def numbered_rows(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with `number`, from 0 on in each group. Groups may be few and large: rows are dealt
    by ranges of (group, order), counted in each range, and shifted by the ranges before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    fields = [*rows.columns, "part", "within"]

    def work(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            within = np.empty(len(values), np.int64)
            for value in np.unique(values).tolist():
                at = np.flatnonzero(values == value)
                within[at] = np.arange(len(at)) + seen.get(value, 0)
                seen[value] = seen.get(value, 0) + len(at)
            columns = [*batch.columns, pa.array(np.full(len(values), part, np.int32)), pa.array(within)]
            yield pa.RecordBatch.from_arrays(columns, fields)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int, within long"
    found = stored(dealt.mapInArrow(work, schema), "numbered")
    counts = found.groupBy("part", group).agg(F.count(F.lit(1)).alias("rows"))
    # One row for each range and group in it: about as many as there are ranges.
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    joined = found.join(F.broadcast(counts), ["part", group])
    return joined.withColumn("number", F.col("within") + F.col("offset")).drop("part", "within", "offset")
