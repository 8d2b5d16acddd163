"""Token ids as frequency-ranked numbers in byte-aligned variable-length coding.

The file format is a folder of two Parquet tables that any Hadoop store can hold:

- `ranks`: one row, the token ids by falling frequency in the corpus (ties: smaller id first), as
  little-endian unsigned 32-bit integers;
- `blocks`: blocks of whole documents in ascending order of doc_id, file after file. `control` has
  two bits for each number (its bytes less one; the first number in the lowest bits), `data` the
  bytes of the numbers, lowest first. A number is the rank of a token id, from 0 on.

Control and data bytes are apart, so a reader looks the lengths of four numbers up at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import new_path, stored
from .tokens import default_path, encoder
from .words import blocks

END = 0
#: Tokens of a block, unless one document has more; tokens of a file, about; and files at most (the
#: reader broadcasts a row for each), which then get longer: they are read block by block.
BLOCK_TOKENS, FILE_TOKENS, MOST_FILES = 1 << 18, 1 << 23, 20_000
#: Lengths of the four numbers of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    numbers = numbers.astype(np.uint32)
    extra = (numbers > 0xFF).astype(np.uint8)
    extra += numbers > 0xFFFF
    extra += numbers > 0xFFFFFF
    padded = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    padded[: len(numbers)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    ends = np.cumsum(extra.astype(np.int64) + 1)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    first = ends - extra - 1
    data[first] = numbers & 0xFF
    for k in range(1, 4):
        longer = np.flatnonzero(extra >= k)
        if not len(longer):
            break
        data[first[longer] + k] = numbers[longer] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of control and data bytes."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    first = np.cumsum(lengths, dtype=np.int64) - lengths
    source = np.frombuffer(data, np.uint8)
    numbers = source[first].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        numbers[longer] |= source[first[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return numbers


def tokenized(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (unsigned integers of two bytes, or four if the vocabulary needs
    them) of each document with the end id; and, where n_tokens is null, counts by token id."""
    kind, size = id_kind(path)

    def work(batches):
        counts = np.zeros(size, np.int64)
        code = encoder(path)
        for batch in blocks(batches):
            found = []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(code.encode(text or ""), "<u4")
                found.append(np.append(ids, END).astype(kind))
            counts += np.bincount(np.concatenate(found), minlength=size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids binary")


def id_kind(path: str) -> tuple[str, int]:
    size = max(encoder(path).tokenizer.get_vocab().values()) + 1
    return ("<u2" if size <= 1 << 16 else "<u4"), size


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column(0).to_pylist():
            counts = np.frombuffer(value, "<i8")
            total = counts.copy() if total is None else total + counts
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["ids"])


def by_frequency(counts: DataFrame, size: int, fold: int = 8) -> np.ndarray:
    """Token ids by falling frequency. Counts are added up in two steps; what reaches the driver are
    at most `fold` rows as long as the vocabulary."""
    part = counts.mapInArrow(_total, "ids binary").repartition(fold).mapInArrow(_total, "ids binary")
    total = np.zeros(size, np.int64)
    for row in part.collect():
        total += np.frombuffer(bytes(row.ids), "<i8")
    return np.argsort(-total, kind="stable").astype("<u4")


def write_ids(documents: DataFrame, folder: str, path: str | None = None) -> None:
    """Encode every whole text, add the end id, and write the format in ascending order of doc_id.

    A null or empty text has the end id alone. Rows without a doc_id come first; repeated rows stay,
    in the order of their ids. Other columns are ignored. An empty table gives empty tables.
    """
    path = path or default_path()
    spark = documents.sparkSession
    kind, size = id_kind(path)
    rows = stored(tokenized(documents, path), "tokens")
    order = by_frequency(rows.where("n_tokens is null").select("ids"), size)
    spark.createDataFrame([(bytearray(order.tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)
    rows = rows.where("n_tokens is not null")
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    files = min(int(total // FILE_TOKENS) + 1, MOST_FILES)

    def work(batches):
        rank, part, before, block = shared.value, TaskContext.get().partitionId(), 0, 0
        docs, sizes, numbers, held = [], [], [], 0

        def flush():
            joined = np.concatenate(numbers)
            control, data = pack(rank[joined])
            values = [part, block, before, len(joined), docs, sizes, control, data]
            return pa.RecordBatch.from_pylist([dict(zip(BLOCK.names, values))], schema=BLOCK)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                found = np.frombuffer(ids, kind)
                if numbers and held + len(found) > BLOCK_TOKENS:
                    yield flush()
                    before, block, docs, sizes, numbers, held = before + held, block + 1, [], [], [], 0
                docs.append(doc)
                sizes.append(len(found))
                numbers.append(found)
                held += len(found)
        if numbers:
            yield flush()

    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(work, BLOCK_COLUMNS).write.option("compression", "zstd").parquet(f"{folder}/blocks")


BLOCK_COLUMNS = (
    "part int, block int, before long, n_tokens long, doc_ids array<long>, sizes array<long>, control binary, data binary"
)
BLOCK = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("before", pa.int64()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("control", pa.binary()),
        ("data", pa.binary()),
    ]
)


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, and `ids` (array) of each
    document; with digest, `ids_crc32` of the ids as little-endian unsigned 32-bit integers instead."""
    rows = spark.read.parquet(f"{folder}/blocks")
    order = np.frombuffer(bytes(spark.read.parquet(f"{folder}/ranks").first()[0]), "<u4")
    shared = spark.sparkContext.broadcast(order)
    ends = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # One row for each file, MOST_FILES at most: the only window without keys.
    offsets = ends.selectExpr("part", "sum(size) over (order by part) - size as offset")
    rows = rows.join(F.broadcast(offsets), "part").withColumn("before", F.col("before") + F.col("offset"))
    last = "ids_crc32 long" if digest else "ids array<long>"
    rows = rows.select("before", "n_tokens", "doc_ids", "sizes", "control", "data")
    return rows.mapInArrow(partial(_decode, shared=shared, digest=digest), f"doc_id long, start long, n_tokens long, {last}")


def _decode(batches, shared, digest: bool):
    for batch in batches:
        for row in range(batch.num_rows):
            before, n, docs, sizes, control, data = (c[row].as_py() for c in batch.columns)
            ids = shared.value[unpack(control, data, n)]
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            if digest:
                raw = memoryview(ids.astype("<u4").tobytes())
                last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.int64())
            else:
                last = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(before + bounds[:-1]), pa.array(sizes, pa.int64()), last],
                ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
            )


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files written for documents."""
    spark = documents.sparkSession
    folder = new_path(spark, "token-ids")
    write_ids(documents, folder, path)
    return read_ids(spark, folder, digest=True)
