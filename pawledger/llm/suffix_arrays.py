"""Benchmark passages in documents by suffix arrays of the training text.

Each shard (a block of whole documents) is turned into numbers: a word of the benchmark has its
number, any other word ends what can match. The shard's suffixes that begin with a benchmark word
are sorted by prefix doubling; every benchmark suffix is then looked up by binary search, all of
them at once, one word deeper at a time. Documents never leave their task: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Shipped
from .words import ALNUM, blocks, lower_code, text_buffers, word_bounds, word_hashes

WINDOW = 10
#: Text bytes of the benchmark that are held at once; a larger benchmark is done in several passes.
BENCHMARK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
#: Text bytes of a whole benchmark. All its passes lie in every worker, so a larger one is refused.
BENCHMARK_MOST = 256 << 20


@dataclass
class Queries:
    """Benchmark texts as word numbers, from 1 on; a 0 follows each item."""

    vocabulary: np.ndarray
    words: np.ndarray
    item: np.ndarray
    ids: list
    #: Words to the end of the item, for each place.
    rest: np.ndarray
    #: Length of the window that begins at a place; 0 if none does.
    window: np.ndarray


def read_queries(ids: list, texts: list, window: int) -> Queries:
    data, bounds = text_buffers(pa.array(texts, pa.string()))
    starts, ends, before = word_bounds(data, bounds, ALNUM)
    hashes = word_hashes(data, starts, ends, lower_code(ALNUM))
    vocabulary = np.unique(hashes)
    numbers = np.searchsorted(vocabulary, hashes) + 1
    sizes = np.diff(before)
    n = len(numbers) + len(ids)
    words, item, rest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = 0
    for k, size in enumerate(sizes.tolist()):
        words[at : at + size] = numbers[before[k] : before[k] + size]
        item[at : at + size + 1] = k
        rest[at : at + size] = np.arange(size, 0, -1)
        at += size + 1
    whole = np.zeros(n, bool)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    whole[first] = sizes > 0
    short = whole & (rest < window)
    return Queries(vocabulary, words, item, ids, rest, np.where(short, rest, np.where(rest >= window, window, 0)))


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places with words > 0, sorted by the next `depth` words; a 0 ends a suffix and comes first."""
    n = len(words)
    places = np.flatnonzero(words)
    rank = words.astype(np.int64)
    order = places[np.argsort(rank[places], kind="stable")]
    length = 1
    open_places = None
    while length < depth and len(order):
        # Rows of equal rank whose suffix goes on are sorted by the rank that lies `length` further.
        ranks = rank[order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = ranks[1:] == ranks[:-1]
        open_places = np.flatnonzero(same[1:] | same[:-1])
        if not len(open_places):
            break
        rows = order[open_places]
        beyond = rows + length
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], 0)
        by = np.lexsort((second, rank[rows]))
        rows, first, second = rows[by], rank[rows][by], second[by]
        order[open_places] = rows
        new = np.ones(len(rows), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        if length == 1:
            # From here on a rank is the first row of its group, so that other groups keep theirs.
            all_new = np.ones(len(order), bool)
            all_new[1:] = ranks[1:] != ranks[:-1]
            group = np.flatnonzero(all_new)[np.cumsum(all_new) - 1] + 1
            fresh = np.zeros(n, np.int64)
            fresh[order] = group
            rank = fresh
        leader = open_places[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
        rank[rows] = leader
        length *= 2
    return order


def search(words: np.ndarray, order: np.ndarray, queries: Queries, deepest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Depth by depth: depth, the benchmark places that match so far, and their ranges in the array."""
    place = np.flatnonzero(queries.rest > 0)
    low, high = np.zeros(len(place), np.int64), np.full(len(place), len(order), np.int64)
    depth = 0
    while len(place) and depth < deepest:
        going = queries.rest[place] > depth
        place, low, high = place[going], low[going], high[going]
        if not len(place):
            return
        asked = queries.words[place + depth]
        low, high = bound(words, order, depth, asked, low, high, False), bound(words, order, depth, asked, low, high, True)
        found = low < high
        place, low, high = place[found], low[found], high[found]
        depth += 1
        if len(place):
            yield depth, place, low, high


def longest(words: np.ndarray, order: np.ndarray, queries: Queries, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the shard and of the benchmark that agree in `least[benchmark place]` words or more,
    and in how many words they do. A range shrinks as the search goes deeper: what leaves it at some
    depth agrees in one word less."""
    parts, held = [], None

    def leave(length, place, low, high):
        some = (low < high) & (least[place] <= length)
        at, row = spread(low[some], high[some])
        parts.append((order[at], place[some][row], np.full(len(at), length)))

    for depth, place, low, high in search(words, order, queries, int(queries.rest.max(initial=1))):
        if held is not None:
            length, before, first, last = held
            found = np.minimum(np.searchsorted(place, before), len(place) - 1)
            on = place[found] == before
            found = found[on]
            leave(length, before[~on], first[~on], last[~on])
            leave(length, before[on], first[on], low[found])
            leave(length, before[on], high[found], last[on])
        held = depth, place, low, high
    if held is not None:
        leave(*held)
    if not parts:
        parts = [(np.zeros(0, np.int64),) * 3]
    return tuple(np.concatenate(column) for column in zip(*parts))


def bound(words, order, depth, asked, low, high, after: bool) -> np.ndarray:
    """Binary search in ranges of the array that agree before `depth`: the first suffix whose word
    at that depth is not less than (or greater than) the one asked for."""
    low, high = low.copy(), high.copy()
    n = len(words)
    while True:
        busy = np.flatnonzero(low < high)
        if not len(busy):
            return low
        middle = (low[busy] + high[busy]) >> 1
        at = order[middle] + depth
        word = np.where(at < n, words[np.minimum(at, n - 1)], 0)
        up = word <= asked[busy] if after else word < asked[busy]
        low[busy] = np.where(up, middle + 1, low[busy])
        high[busy] = np.where(up, high[busy], middle)


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number in the ranges, and the row of its range."""
    sizes = high - low
    row = np.repeat(np.arange(len(low)), sizes)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[row], row


def shard_words(texts: pa.Array, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of a block of documents with a 0 after each, where each begins, and their sizes."""
    data, bounds = text_buffers(texts)
    starts, ends, before = word_bounds(data, bounds, ALNUM)
    hashes = word_hashes(data, starts, ends, lower_code(ALNUM))
    known = queries.vocabulary
    at = np.searchsorted(known, hashes)
    numbers = np.where(known[np.minimum(at, len(known) - 1)] == hashes, at + 1, 0) if len(known) else np.zeros(len(hashes), np.int64)
    sizes = np.diff(before)
    words = np.zeros(len(hashes) + len(sizes), np.int64)
    document = np.repeat(np.arange(len(sizes)), sizes)
    words[np.arange(len(hashes)) + document] = numbers
    return words, before[:-1] + np.arange(len(sizes)), sizes


def read_benchmark(benchmark: DataFrame, most: int = BENCHMARK_BYTES) -> Iterator[tuple[list, list]]:
    """The benchmark's ids and texts in passes of bounded size, in the order of the ids."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > BENCHMARK_MOST:
        raise ValueError(f"the benchmark has {total} bytes of text; up to {BENCHMARK_MOST} are held at once, so split it")
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if row.item_id is None or row.text is None:
            continue
        if texts and size + len(row.text) > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
    yield ids, texts


def matches(documents: DataFrame, benchmark: DataFrame, least: int = WINDOW) -> DataFrame:
    """doc_id, item_id, item_word, doc_word, n_words: for each benchmark suffix and document, its longest
    verbatim match and where it is (words from 0; of several, the first), from `least` words on.

    Null texts and ids match nothing; an empty table on either side gives no rows. Repeated rows
    are searched each. Other columns are ignored.
    """
    parts = [_matches(documents, read_queries(ids, texts, least), least) for ids, texts in read_benchmark(benchmark)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _matches(documents: DataFrame, queries: Queries, least: int) -> DataFrame:
    shared = Shipped(documents.sparkSession, queries)
    first = np.concatenate(([0], np.flatnonzero(np.diff(queries.item)) + 1))

    def work(batches):
        queries = shared.value
        depth = int(queries.rest.max(initial=1))
        for batch in blocks(batches, most=SHARD_BYTES):
            words, begins, _ = shard_words(batch.column(1), queries)
            order = suffix_array(words, depth)
            at, place, length = longest(words, order, queries, np.full(len(queries.rest), least))
            if len(at):
                document = np.searchsorted(begins, at, side="right") - 1
                best = first_of((place, document), (-length, at))
                at, place, length, document = at[best], place[best], length[best], document[best]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(document)),
                        pa.array([queries.ids[k] for k in queries.item[place]], pa.string()),
                        pa.array(place - first[queries.item[place]]),
                        pa.array(at - begins[document]),
                        pa.array(length),
                    ],
                    ["doc_id", "item_id", "item_word", "doc_word", "n_words"],
                )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(work, "doc_id long, item_id string, item_word long, doc_word long, n_words long")


def first_of(groups: tuple, by: tuple) -> np.ndarray:
    """The first row, by the columns `by`, of each group of rows equal in the columns `groups`."""
    order = np.lexsort((*by[::-1], *groups[::-1]))
    new = np.ones(len(order), bool)
    for column in groups:
        new[1:] &= column[order][1:] == column[order][:-1]
    new[1:] = ~new[1:]
    return order[new]


MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("n_words", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())]))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, longest and matches for each
    row.

    A window is `window` consecutive words of an item, or the whole of a shorter one. A word inside
    any occurrence of a window is hit. `matches` has, for each item found, its longest verbatim match
    and where it is: item_id, n_words, doc_word, item_word (words from 0; of several, the first).
    `longest` is the largest n_words, 0 without a match. Null and empty texts have no words and are clean; so is
    everything if the benchmark is empty or has no words. Items with a null id or text are left
    out; an item_id that repeats counts once. Repeated rows are judged each. Other columns are
    ignored.
    """
    shared = _broadcast(documents, benchmark, window)

    def work(batches):
        for batch in blocks(batches, most=SHARD_BYTES):
            sizes, n_hit, found = judge(batch, [part.value for part in shared])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array(n_hit),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in found], pa.string()),
                    pa.array(n_hit > 0),
                    pa.array([sorted(s) for s in found], pa.list_(pa.string())),
                    pa.array([max((-n for n, _, _ in s.values()), default=0) for s in found], pa.int64()),
                    pa.array([[(item, -n, *place) for item, (n, *place) in sorted(s.items())] for s in found], MATCHES),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "longest", "matches"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        work,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, "
        "longest long, matches array<struct<item_id: string, n_words: long, doc_word: long, item_word: long>>",
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, row by row and with all their columns.

    Null and empty texts stay, very long ones are judged whole, repeated rows each. An empty table on
    either side is no error: nothing is left, or everything.
    """
    shared = _broadcast(documents, benchmark, window)

    def work(batches):
        for batch in blocks(batches, most=SHARD_BYTES):
            _, n_hit, _ = judge(batch, [part.value for part in shared])
            yield batch.filter(pa.array(n_hit == 0))

    return documents.mapInArrow(work, documents.schema)


def _broadcast(documents: DataFrame, benchmark: DataFrame, window: int) -> list:
    spark = documents.sparkSession
    return [Shipped(spark, read_queries(ids, texts, window)) for ids, texts in read_benchmark(benchmark)]


def judge(batch: pa.RecordBatch, parts: list[Queries]) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """Words and hit words of each document of a shard, and its items: for each id the longest match
    (-length, document word, item word)."""
    text = batch.column(batch.schema.get_field_index("text"))
    items: list[dict] = [{} for _ in range(batch.num_rows)]
    hit = None
    for queries in parts:
        words, begins, sizes = shard_words(text, queries)
        hit = np.zeros(len(words) + 1, np.int64) if hit is None else hit
        order = suffix_array(words, int(queries.rest.max(initial=1)))
        least = np.where(queries.window > 0, queries.window, len(queries.rest) + 1)
        at, place, length = longest(words, order, queries, least)
        window = queries.window[place]
        once = first_of((at, window), ())
        np.add.at(hit, at[once], 1)
        np.add.at(hit, at[once] + window[once], -1)
        document = np.searchsorted(begins, at, side="right") - 1
        item = queries.item[place]
        begin = np.concatenate(([0], np.flatnonzero(np.diff(queries.item)) + 1))
        doc_word, item_word = at - begins[document], place - begin[item]
        best = first_of((document, item), (-length, doc_word, item_word))
        for k, i, *match in zip(*(column[best].tolist() for column in (document, item, -length, doc_word, item_word))):
            name = queries.ids[i]
            items[k][name] = min(items[k].get(name, tuple(match)), tuple(match))
    inside = np.concatenate(([0], np.cumsum(np.cumsum(hit[:-1]) > 0)))
    return sizes, inside[begins + sizes] - inside[begins], items
