"""Product codes of vectors: whole-number k-means codebooks, nearest entries by Orchard search.

Components become whole numbers, floor(SCALE * x), and a vector is cut into equal parts. Each part
position has a codebook; a part's code is the index of the nearest entry. Orchard search keeps, for
every entry, the list of all entries by their distance from it. A part starts at some entry and
walks that entry's list; a nearer entry takes over and its own list begins; marked entries are not
measured again; where the list is farther than twice the part's distance, nothing nearer is left.
In squared distances that is four times; only entries beyond it are skipped, so ties go to the
lower index for certain. All sums are exact at any size of the components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Parts searched at once.
SEARCHED = 1 << 14
#: Bits of each limb of a sum on its way through Spark; so many tasks add up without overflow.
LIMB = 40


def wholes(values: np.ndarray, exact: bool) -> np.ndarray:
    """floor(SCALE * x) of each number; as Python's own integers if they may be large."""
    if not exact:
        return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)
    parts = [float(x).as_integer_ratio() for x in values.ravel()]
    return np.array([n * SCALE // d for n, d in parts], object).reshape(values.shape)


def is_large(largest: float, width: int) -> bool:
    """Whether four times a squared distance of such parts may not fit into 63 bits."""
    return 16 * width * (SCALE * int(largest) + SCALE + 1) ** 2 >= 1 << 62


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by distance, and the squared distances."""
    apart = entries[:, None] - entries[None]
    far = (apart * apart).sum(axis=2)
    order = np.argsort(far, axis=1, kind="stable")
    return order, np.take_along_axis(far, order, 1)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance for each point, by Orchard search."""
    order, far = neighbour_lists(entries)
    # A search may start anywhere: here at the entry whose sum is next above the point's.
    sums = entries.sum(axis=1)
    by_sum = np.argsort(sums, kind="stable")
    start = by_sum[np.minimum(np.searchsorted(sums[by_sum], points.sum(axis=1)), len(entries) - 1)]
    best, distance = np.empty(len(points), np.int64), np.empty(len(points), points.dtype)
    for first in range(0, len(points), SEARCHED):
        here = slice(first, first + SEARCHED)
        best[here], distance[here] = _orchard(points[here], entries, order, far, start[here])
    return best, distance


def _orchard(points, entries, order, far, best):
    best = best.astype(np.int64)
    apart = points - entries[best]
    distance = (apart * apart).sum(axis=1)
    seen = np.zeros((len(points), len(entries)), bool)
    seen[np.arange(len(points)), best] = True
    place = np.zeros(len(points), np.int64)
    active = np.arange(len(points))
    while len(active):
        entry, at = best[active], place[active]
        more = at < len(entries)
        more[more] = far[entry[more], at[more]] <= 4 * distance[active[more]]
        active, entry, at = active[more], entry[more], at[more]
        place[active] += 1
        next_entry = order[entry, at]
        new = ~seen[active, next_entry]
        point, tried = active[new], next_entry[new]
        seen[point, tried] = True
        apart = points[point] - entries[tried]
        found = (apart * apart).sum(axis=1)
        nearer = (found < distance[point]) | ((found == distance[point]) & (tried < best[point]))
        point = point[nearer]
        best[point], distance[point], place[point] = tried[nearer], found[nearer], 0
    return best, distance


class Codebooks:
    """entries[part][entry] is a list of whole numbers; `dimension` and `exact` say how to cut and
    count vectors."""

    def __init__(self, entries: list, dimension: int, exact: bool):
        self.entries, self.dimension, self.exact = entries, dimension, exact

    def arrays(self) -> list[np.ndarray]:
        kind = object if self.exact else np.int64
        return [np.array(part, kind) for part in self.entries]

    def sha256(self) -> str:
        flat = (str(x) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()

    def decoded(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        indexes = bytes.fromhex(code)
        return [x / SCALE for part, k in zip(self.entries, indexes) for x in part[k]]


def usable(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, embedding and label of the rows whose vector has finite numbers only, in a number
    that cuts into equal parts. Other columns play no part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return rows.where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).where(good)


def table_of(column: pa.Array, dimension: int, exact: bool) -> np.ndarray:
    """The whole-number components of a list column's vectors, a row each."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return wholes(values, exact).reshape(len(column), dimension)


def limbs(totals: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as limbs of LIMB bits; the last one is signed."""
    out = []
    while len(totals) and max(abs(int(totals.max())), abs(int(totals.min()))) >= 1 << LIMB:
        out.append((totals & ((1 << LIMB) - 1)).astype(np.int64))
        totals = totals >> LIMB
    return [*out, totals.astype(np.int64)]


def partial_sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, place, limb, value: counts (place -1) and sums of the parts nearest to each
    entry, added up in each task first."""
    arrays, dimension, exact = books.arrays(), books.dimension, books.exact
    width = dimension // len(arrays)

    def work(batches):
        sums = [np.zeros((len(entries), width + 1), object if exact else np.int64) for entries in arrays]
        for batch in batches:
            table = table_of(batch.column(0), dimension, exact)
            for k, entries in enumerate(arrays):
                points = table[:, k * width : (k + 1) * width]
                best, _ = nearest(points, entries)
                np.add.at(sums[k], (best, 0), 1)
                np.add.at(sums[k], (best, slice(1, None)), points)
        for k, table in enumerate(sums):
            used = np.flatnonzero(table[:, 0])
            for j in range(width + 1):
                for limb, values in enumerate(limbs(table[used, j])):
                    size = len(values)
                    places = [np.full(size, x, np.int32) for x in (k, j - 1, limb)]
                    columns = [pa.array(x) for x in (places[0], used.astype(np.int32), *places[1:], values)]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "limb", "value"])

    found = rows.select("embedding").mapInArrow(work, "part int, entry int, place int, limb int, value long")
    return found.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the usable vectors; None if there are none.

    The first entries are the parts of the vectors of the smallest ids that are not null (equal ids
    by vector; repeated rows count each). The smallest one gives the dimension, and vectors of
    another one stay out. Each round assigns all parts and moves every used entry to the floor of
    its parts' mean. What reaches the driver is one number for each entry and component.
    """
    rows = usable(vectors, parts)
    ordered = rows.where("vec_id is not null").orderBy("vec_id", "embedding")
    first = ordered.limit(1).collect()
    if not first:
        return None
    dimension = len(first[0].embedding)
    rows = rows.where(F.size("embedding") == dimension)
    seeds = ordered.where(F.size("embedding") == dimension).limit(entries).collect()
    largest = rows.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0]
    width = dimension // parts
    exact = is_large(largest, width)
    table = wholes(np.array([r.embedding for r in seeds]), True)
    start = [table[:, k * width : (k + 1) * width].tolist() for k in range(parts)]
    books = Codebooks(start, dimension, exact)
    for _ in range(rounds):
        totals: dict[tuple, int] = {}
        for r in partial_sums(rows, books).collect():
            key = r.part, r.entry, r.place
            totals[key] = totals.get(key, 0) + (r.value << (LIMB * r.limb))
        moved = [[list(entry) for entry in part] for part in books.entries]
        for (part, entry, place), total in totals.items():
            if place >= 0:
                moved[part][entry][place] = total // totals[part, entry, -1]
        books = Codebooks(moved, dimension, exact)
    return books


def encoded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distance of whole numbers,
    null if it does not fit into a long) of each usable vector of the codebooks' dimension."""
    arrays, dimension, exact = books.arrays(), books.dimension, books.exact
    width = dimension // len(arrays)
    rows = usable(vectors, len(arrays)).where(F.size("embedding") == dimension)

    def work(batches):
        for batch in batches:
            table = table_of(batch.column(2), dimension, exact)
            codes = np.empty((len(table), len(arrays)), np.uint8)
            error = np.zeros(len(table), table.dtype)
            for k, entries in enumerate(arrays):
                codes[:, k], distance = nearest(table[:, k * width : (k + 1) * width], entries)
                error = error + distance
            digits, size = codes.tobytes().hex(), 2 * len(arrays)
            shown = [digits[i : i + size] for i in range(0, len(digits), size)]
            errors = [int(x) if x < 1 << 63 else None for x in error] if exact else error
            columns = [batch.column(0), batch.column(1), pa.array(shown, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    kinds = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}"
    return rows.select("vec_id", "label", "embedding").mapInArrow(work, f"{kinds}, code string, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each usable vector.

    vectors: vec_id, embedding (an array of numbers) and label; other columns play no part. Rows
    whose vector is null, empty, holds a null or a number that is not finite, or has a length other
    than that of the smallest usable id or not a multiple of `parts`, are dropped. Rows with a null
    id are encoded but never first entries. Repeated rows are encoded each. label_error adds up the
    errors of equal labels, nulls together. No usable row gives no rows. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    books = trained(vectors, parts, entries, rounds)
    if books is None:
        books = Codebooks([[[0]]] * parts, parts, False)
    rows = stored(encoded(vectors, books), "vector-codes")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    rows = rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    return rows.withColumn("codebooks_sha256", F.lit(books.sha256()))
