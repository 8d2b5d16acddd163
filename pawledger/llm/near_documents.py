"""Near-duplicate documents: b-bit MinHash, a multi-index Hamming join, exact Jaccard.

A signature has SYMBOLS symbols of 16 bits, the low bits of a MinHash each. It is split
into CHUNKS chunks. Two signatures that differ in at most 2 * CHUNKS - 1 symbols have a chunk
with at most one difference (pigeonhole), so a chunk is probed once for each symbol left out:
every such pair shares a key, and DISTANCE is no larger. Pairs that share a key and are near as
signatures, by the low halves of their symbols, span coarse groups; inside a group all members are
compared on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .groups import candidate_edges, compared, components
from .store import stored
from .words import blocks, fingerprint, mix, shingle_sets, stream, text_buffers

SHINGLE = 5
SYMBOLS, CHUNKS = 40, 10
#: Symbols in which near signatures may differ; the join finds every such pair. Pairs that differ in
#: more: at a similarity of 0.85 less than one in a million, at 0.80 about two in 100,000.
DISTANCE = 2 * CHUNKS - 1
FLIPS = (stream(11, SYMBOLS) >> np.uint64(32)).astype(np.uint32)[:, None]
FACTORS = ((stream(12, SYMBOLS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols of 16 bits."""
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), 4096):
        values = (short[start : start + 4096] ^ FLIPS) * FACTORS
        values ^= values >> np.uint32(15)
        np.minimum(low, (values * np.uint32(0x2C1B3C6D)).min(axis=1), out=low)
    return (mix(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def signed(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, print (a fingerprint of the set), sketch and upper (the low and the high
    bytes of the signature's symbols), from doc_id (of any type) and text."""

    def work(batches):
        for batch in blocks(batches):
            sets = shingle_sets(*text_buffers(batch.column(1)), shingle)
            symbols = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) for s in sets], pa.binary()),
                    pa.array([(s & np.uint16(0xFF)).astype(np.uint8).tobytes() for s in symbols], pa.binary()),
                    pa.array([(s >> np.uint16(8)).astype(np.uint8).tobytes() for s in symbols], pa.binary()),
                ],
                ["doc_id", "n_shingles", "print", "sketch", "upper"],
            )

    ids = documents.select("doc_id", F.col("text").cast("string"))
    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(work, f"doc_id {kind}, n_shingles long, print binary, sketch binary, upper binary")


def matrix(sketches: pa.ChunkedArray, width: int) -> np.ndarray:
    joined = b"".join(sketches.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, width)


def probes(classes: DataFrame) -> DataFrame:
    """key, node, sketch: for each chunk and each symbol left out, a hash of the chunk's others."""
    width = SYMBOLS // CHUNKS

    def work(batches):
        for batch in batches:
            table = matrix(batch.column(1), SYMBOLS) | matrix(batch.column(2), SYMBOLS).astype(np.uint64) << np.uint64(8)
            keys = np.empty((batch.num_rows, SYMBOLS), np.uint64)
            for chunk in range(CHUNKS):
                for left_out in range(width):
                    value = np.full(batch.num_rows, chunk * width + left_out, np.uint64)
                    for i in range(width):
                        if i != left_out:
                            value = value << np.uint64(16) | table[:, chunk * width + i]
                    keys[:, chunk * width + left_out] = value
            rows = pa.array(np.repeat(np.arange(batch.num_rows), SYMBOLS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(keys.ravel()).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)],
                ["key", "node", "sketch"],
            )

    return classes.select("node", "sketch", "upper").mapInArrow(work, "key long, node long, sketch binary")


def near_signatures(sketches: pa.ChunkedArray) -> Callable:
    table = matrix(sketches, SYMBOLS)
    return lambda i, j: (table[i] != table[j]).sum(axis=1) <= DISTANCE


def similar_sets(table: pa.Table, percent: int) -> Callable:
    """Tells which pairs have 100 * intersection >= percent * union, on the full sets."""
    near = near_signatures(table.column("sketch"))
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)

    def linked(i, j):
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        hit = (100 * small >= percent * large) & near(i, j)
        for k in np.flatnonzero(hit):
            both = np.concatenate((sets[i[k]], sets[j[k]]))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            hit[k] = 100 * common >= percent * (len(both) - common)
        return hit

    return linked


def sets_of(documents: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, shingles for the wanted rows (node, print, doc_id), from the whole texts."""

    def work(batches):
        for batch in blocks(batches):
            sets = shingle_sets(*text_buffers(batch.column(0)), shingle)
            asked = batch.column(2).to_pylist()
            keep = [k for k, found in enumerate(sets) if fingerprint(found) == asked[k]]
            nodes = batch.column(1).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([nodes, pa.array([sets[k].tobytes() for k in keep], pa.binary())], ["node", "shingles"])

    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = texts.join(wanted, "doc_id").select("text", "node", "print")
    return texts.mapInArrow(work, "node long, shingles binary").dropDuplicates(["node"])


def near_duplicates(documents: DataFrame, percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents (doc_id, text, ...).

    Documents are linked if 100 * intersection >= percent * union of their sets of word shingles
    (blanks part words, A-Z in lower case; fewer words than a shingle are one shingle).
    component_id is the smallest doc_id reachable; kept marks that document.

    Null or empty texts have no shingles: they are linked with nothing and kept. Rows without a
    doc_id are linked with nothing, kept, and have a null component_id. Rows that repeat a doc_id
    are rows of their own and share what that id has. Other columns are ignored. An empty table
    gives no rows.
    """
    return _verdicts(documents.withColumn("doc_id", F.col("doc_id").cast("long")), percent, shingle)


def _verdicts(documents: DataFrame, percent: int, shingle: int) -> DataFrame:
    """near_duplicates with a doc_id of any type that has an order."""
    rows = stored(signed(documents, shingle), "signed")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("print")
    # Equal sets have equal signatures, so any of them will do.
    classes = classes.agg(F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch"), F.min("upper").alias("upper"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    coarse = components(candidate_edges(probes(classes), near_signatures, "near"), "coarse")
    members = coarse.join(classes, "node").withColumn("group", F.xxhash64("root"))
    sets = sets_of(documents, members.select("doc_id", "node", "print"), shingle)
    members = stored(members.join(sets, "node").select("node", "sketch", "group", "shingles"), "members")
    links = compared(members, "group", "node", lambda table: similar_sets(table, percent))
    linked = components(stored(links, "links"), "linked")
    smallest = linked.join(classes, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(smallest, "root").select("node", "component_id")
    named = classes.join(named, "node", "left")
    named = named.select("print", F.coalesce("component_id", "doc_id").alias("component_id"))
    solid = rows.where("n_shingles > 0 and doc_id is not null").join(named, "print")
    other = rows.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    result = solid.select(*columns).union(other.select(*columns))
    return result.withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def without_duplicates(documents: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group that near_duplicates links, with all columns.

    A document is a (doc_id, version of the text): of a group, one row of the smallest stays, rows
    without a doc_id coming last. Rows without shingles all stay.
    """
    unnamed = F.col("doc_id").isNull()
    own = F.struct(
        unnamed.alias("unnamed"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("version"),
    )
    verdicts = _verdicts(documents.select(own.alias("doc_id"), "text"), percent, shingle).where("n_shingles > 0")
    found = verdicts.groupBy(F.col("doc_id").alias("own")).agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    found = stored(found.where("not kept or n > 1"), "duplicates")
    # The row is one column, so that its names cannot clash with those added.
    boxed = documents.select(own.alias("own"), F.struct(*documents.columns).alias("row"))
    single = boxed.join(found.select("own"), "own", "left_anti").select("row.*")
    repeated = found.where("kept").select("own")
    if repeated.isEmpty():
        return single
    return single.union(boxed.join(repeated, "own").dropDuplicates(["own"]).select("row.*"))
