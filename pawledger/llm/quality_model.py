"""Text quality by nearest-neighbour voting in a latent-semantic space.

A text is a vector of hashed byte trigrams (weighted by how rare they are in all documents) and a
few shares. Singular vectors of a bounded sample of labelled texts span the latent space; the
labelled vectors are broadcast, every document meets all of them in blocks of exact cosine
products, and the labels of its nearest neighbours are weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .columns import hash_sample
from .store import Shipped
from .token_ids import _total
from .words import SOLID, UPPER, blocks, lower_code, text_buffers, word_bounds, word_hashes

BINS, SHARES, LATENT = 1024, 9, 48
#: Bounds of the fit: labelled texts, and neighbours that vote.
LABELLED, NEIGHBOURS = 4000, 25
#: How much the shares weigh against the trigrams, whose vector has length one.
SHARE_WEIGHT = 1.5
SHARPNESS = 8.0
TRIGRAM = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
SYMBOL = ((UPPER >= 0x21) & (UPPER <= 0x7E)) & ~np.isin(UPPER, list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:'\"!?()-"))
CAPITAL = (UPPER >= 0x41) & (UPPER <= 0x5A)
DIGIT = (UPPER >= 0x30) & (UPPER <= 0x39)
MARK = np.isin(UPPER, list(b"!?"))
STOP = np.isin(UPPER, list(b".,;:"))


def trigrams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each text has a trigram of each bin; texts by bins."""
    n = len(bounds) - 1
    if len(data) < 3:
        return np.zeros((n, BINS), np.int64)
    wide = data.astype(np.uint32)
    code = wide[:-2] * TRIGRAM[0] + wide[1:-1] * TRIGRAM[1] + wide[2:] * TRIGRAM[2]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    inside = row[:-2] == row[2:]
    key = row[:-2] * np.int32(BINS) + (code >> np.uint32(22)).astype(np.int32)
    return np.bincount(key[inside], minlength=n * BINS).reshape(n, BINS)


def shares(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Figures between 0 and 1 of each text."""
    n = len(bounds) - 1
    starts, ends, before = word_bounds(data, bounds, SOLID)
    hashes = word_hashes(data, starts, ends, lower_code(SOLID))
    n_words = np.maximum(np.diff(before), 1)
    row = np.repeat(np.arange(n), np.diff(before))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(row)))
    most = np.zeros(n)
    np.maximum.at(most, row[first], runs)
    n_bytes = np.maximum(np.diff(bounds), 1)

    def count(table):
        total = np.concatenate(([0], np.cumsum(table[data])))
        return total[bounds[1:]] - total[bounds[:-1]]

    words = np.diff(before)
    return np.column_stack(
        [
            np.minimum(np.log2(words + 1) / 12, 1) * 0.5,
            np.minimum(words, 50) / 50,
            np.bincount(row[first], minlength=n) / n_words,
            most / n_words,
            np.minimum(count(SYMBOL) / n_words, 1),
            np.minimum(4 * count(CAPITAL) / n_bytes, 1),
            np.minimum(4 * count(DIGIT) / n_bytes, 1),
            np.minimum(count(MARK) / n_words, 1),
            np.minimum(5 * count(STOP) / n_words, 1) * 0.5,
        ]
    )


def vectors(texts: pa.Array, rarity: np.ndarray) -> np.ndarray:
    data, bounds = text_buffers(texts)
    weighted = np.log1p(trigrams(data, bounds)) * rarity
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
    return np.hstack((weighted, SHARE_WEIGHT * shares(data, bounds))).astype(np.float32)


def document_counts(documents: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents have a trigram of each bin, and how many documents there are."""

    def work(batches):
        total = np.zeros(BINS + 1, np.int64)
        for batch in blocks(batches):
            total[:BINS] += (trigrams(*text_buffers(batch.column(0))) > 0).sum(axis=0)
            total[BINS] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["ids"])

    counts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(work, "ids binary")
    total = np.zeros(BINS + 1, np.int64)
    # Added up in two steps; what reaches the driver are eight rows of BINS numbers.
    for row in counts.repartition(8).mapInArrow(_total, "ids binary").collect():
        total += np.frombuffer(bytes(row.ids), "<i8")
    return total[:BINS], int(total[BINS])


@dataclass
class Neighbours:
    rarity: np.ndarray
    space: np.ndarray
    points: np.ndarray
    labels: np.ndarray
    #: The share of good labels, for texts that resemble nothing.
    share: float

    def latent(self, texts: pa.Array) -> np.ndarray:
        points = vectors(texts, self.rarity) @ self.space
        return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: pa.Array, block: int = 512) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.share)
        points, out = self.latent(texts), np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(points), block):
            near = points[start : start + block] @ self.points.T
            at = np.argpartition(near, len(self.labels) - k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(near, at, axis=1), 0) ** SHARPNESS
            total = weight.sum(axis=1)
            good = (weight * self.labels[at]).sum(axis=1)
            out[start : start + block] = np.where(total > 1e-9, good / np.maximum(total, 1e-9), self.share)
        return np.clip(out, 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fitted(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> Neighbours:
    """Learn from about `most` labelled rows that are not held out, those with the smallest hashes,
    or from all if there are fewer. Rows without an id, a label or a text teach nothing; of rows
    that repeat an id and label, one does."""
    counts, n = document_counts(documents)
    rarity = (np.log((n + 1) / (counts + 1)) + 0.1).astype(np.float32)
    # Two columns of the labels are read; the sample is bounded by `most`.
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__label"))
    known = known.where("__id is not null and __label is not null").where(~held_out(F.col("__id"))).distinct()
    known = hash_sample(known, ["__id", "__label"], most)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("text is not null").join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("doc_id", "__label", "text")

    def work(batches):
        for batch in blocks(batches):
            found = [v.tobytes() for v in vectors(batch.column(2), rarity)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "label", "vector"])

    taught = rows.mapInArrow(work, "doc_id long, label int, vector binary").groupBy("doc_id", "label")
    taught = taught.agg(F.min("vector").alias("vector")).collect()
    taught.sort(key=lambda r: (r.doc_id, r.label, bytes(r.vector)))
    table = np.array([np.frombuffer(bytes(r.vector), np.float32) for r in taught], np.float32).reshape(-1, BINS + SHARES)
    good = np.array([1.0 if r.label == 1 else 0.0 for r in taught])
    if not len(good):
        empty = np.zeros((0, LATENT), np.float32)
        return Neighbours(rarity, np.zeros((BINS + SHARES, LATENT), np.float32), empty, good, 0.5)
    values, axes = np.linalg.eigh((table.T @ table).astype(np.float64))
    space = axes[:, np.argsort(-values)[:LATENT]].astype(np.float32)
    points = table @ space
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    return Neighbours(rarity, space, points, good, float((good.sum() + 1) / (len(good) + 2)))


def scored(documents: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Labels, lang, source and doc_id are no inputs of a score. A null text counts as an empty one,
    and both are scored by their shares. Without labels to learn from every score is 0.5. held_out
    is false for rows without an id. Repeated rows are scored each. Other columns are ignored; an
    empty table gives no rows.
    """
    shared = Shipped(documents.sparkSession, fitted(documents, labels))

    def work(batches):
        for batch in blocks(batches):
            scores = shared.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(work, "doc_id long, score double")
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
