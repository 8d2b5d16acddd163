"""Runs of periodic words: string synchronising sets at dyadic scales, and highly periodic regions.

A run is a maximal stretch of words with a smallest period q, of at least 2 * q words. At a scale t
(a power of two) a position is selected if the least hash among the t + 1 stretches of t words that
begin at it or up to t words after it is that of the first or the last of them; stretches with a
period of at most t / 3 do not count. Which positions are selected depends on the 2 * t words after
them alone, so a run of period q in [3 * t, 6 * t) has a selected position and, q words on, another
one with an equal context. Pairs of equal contexts so far apart propose periods; words in common
before and after them, found by binary search on prefix hashes, give the run.

Where nothing is selected, the text has a period of at most t / 3: highly periodic regions, which
are the runs found at lower scales. They hide runs of two nearly whole copies of one region; these
are proposed from neighbouring runs of one small period that touch. Periods 1 and 2 are read off
directly. Every run is checked word by word at the end; words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import BYTE_CODE, SOLID, blocks, mix, stream, text_buffers, word_bounds, word_hashes

LEAST = 12
#: Text bytes worked on at once: their arrays take some fifty times as much.
BLOCK = 1 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Sequence:
    """Hashes of words with a separator of its own before and after each text, and prefix hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        powers = np.full(len(words) + 1, STEP)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * self.powers[:-1], dtype=np.uint64)))

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches at i and at j > i have equal hashes."""
        one, two = self.prefix[i + size] - self.prefix[i], self.prefix[j + size] - self.prefix[j]
        return one * self.powers[j - i] == two

    def stretches(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch around i < j that has the period j - i."""
        n = len(self.words)
        ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        size = 1 << max(n.bit_length() - 1, 0)
        while size:
            fits = np.flatnonzero(j + ahead + size <= n)
            fits = fits[self.equal(i[fits] + ahead[fits], j[fits] + ahead[fits], size)]
            ahead[fits] += size
            fits = np.flatnonzero(i - back - size >= 0)
            fits = fits[self.equal(i[fits] - back[fits] - size, j[fits] - back[fits] - size, size)]
            back[fits] += size
            size >>= 1
        return i - back, j + ahead


def direct_runs(words: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches with a small period, of twice the period or more."""
    same = np.zeros(max(len(words) - period, 0) + 2, np.int8)
    same[1:-1] = words[period:] == words[: len(words) - period] if len(words) > period else 0
    turn = np.diff(same)
    start, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = stop - start >= period
    return start[long], stop[long] + period


def covered(start: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
    """Marks of the places inside any of the stretches."""
    change = np.zeros(size + 1, np.int64)
    start, stop = np.minimum(start, size), np.minimum(stop, size)
    np.add.at(change, start, 1)
    np.add.at(change, np.maximum(stop, start), -1)
    return np.cumsum(change[:-1]) > 0


def synchronised(hashes: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """The selected positions, given the hash of each stretch of `scale` words."""
    value = np.where(periodic, NONE, hashes)
    least, width = value, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(value) - scale], value[scale:])
    chosen = (least == value[: len(least)]) | (least == value[scale:])
    return np.flatnonzero(chosen & (least != NONE))


def equal_contexts(context: np.ndarray, position: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions i < j of equal contexts with low <= j - i < high. Equal contexts lie more
    than high / 18 apart, so each position has a bounded number of partners."""
    order = np.argsort(context, kind="stable")
    context, position = context[order], position[order]
    ones, twos = [], []
    left = np.arange(max(len(position) - 1, 0))
    step = 1
    while len(left):
        left = left[left + step < len(position)]
        apart = position[left + step] - position[left]
        near = (context[left + step] == context[left]) & (apart < high)
        left, apart = left[near], apart[near]
        wide = apart >= low
        ones.append(position[left[wide]])
        twos.append(position[left[wide] + step])
        step += 1
    return _joined(ones), _joined(twos)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def without_repeats(text: Sequence, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs without those that lie in the same stretch as the pair before them."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    keep = np.ones(len(i), bool)
    same = np.flatnonzero((j - i)[1:] == (j - i)[:-1])
    keep[same + 1] = ~text.equal(i[same], j[same], i[same + 1] - i[same])
    return i[keep], j[keep]


def hidden_pairs(words: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that propose the runs which two touching highly periodic regions hide."""
    order = np.lexsort((start, period))
    start, stop, period = start[order], stop[order], period[order]
    both = np.minimum((stop - start)[:-1], (stop - start)[1:])
    touch = (period[1:] == period[:-1]) & (start[1:] <= stop[:-1]) & (both >= 9 * period[:-1])
    ones, twos = [], []
    for k in np.flatnonzero(touch).tolist():
        small, end, after = int(period[k]), int(stop[k]), int(start[k + 1])
        block = words[end - small : end]
        views = np.lib.stride_tricks.sliding_window_view(words[after : after + 2 * small - 1], small)
        for x in np.flatnonzero((views == block).all(axis=1)).tolist():
            shift = (after + x - end) % small
            sizes = np.arange(shift + 9 * small, int(both[k]) + 1, small)
            first = np.maximum(start[k], after - sizes)
            ones.append(first)
            twos.append(first + sizes)
    return _joined(ones).astype(np.int64), _joined(twos).astype(np.int64)


def found_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs, of any length, in the texts of a sequence that
    has a separator first and after each text; the texts lie in the order of falling sizes."""
    text = Sequence(words)
    starts, stops, periods = [], [], []

    def add(start, stop, period):
        long = stop - start >= 2 * period
        starts.append(start[long])
        stops.append(stop[long])
        periods.append(period[long])

    def lowest() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All so far, each stretch once with its smallest period."""
        start, stop, period = _joined(starts), _joined(stops), _joined(periods)
        order = np.lexsort((period, stop, start))
        start, stop, period = start[order], stop[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
        return start[new], stop[new], period[new]

    for small in (1, 2):
        start, stop = direct_runs(words, small)
        add(start, stop, np.full(len(start), small))
    ends = 1 + np.cumsum(sizes + 1)
    scale, hashes = 1, words
    while len(sizes) and sizes[0] >= 6 * scale:
        # Runs of these periods need 6 * scale words; shorter texts stay out.
        limit = int(ends[np.searchsorted(-sizes, -6 * scale, side="right") - 1])
        hashes = hashes[: limit - scale + 1]
        start, stop, period = lowest()
        dense = (3 * period <= scale) & (stop - start >= scale)
        periodic = covered(start[dense], stop[dense] - scale + 1, len(hashes))
        position = synchronised(hashes, scale, periodic)
        wider = mix(hashes[:-scale] * STEP + mix(hashes[scale:] + np.uint64(scale)))
        i, j = equal_contexts(wider[position], position, 3 * scale, 6 * scale)
        i, j = without_repeats(text, i, j)
        add(*text.stretches(i, j), j - i)
        scale, hashes = 2 * scale, wider
    i, j = hidden_pairs(words, *lowest())
    i, j = without_repeats(text, i, j)
    add(*text.stretches(i, j), j - i)
    return checked(words, *lowest())


def checked(words: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray):
    """The same runs, compared word by word; one that prefix hashes drew wrongly is drawn anew."""
    wrong = (words[start - 1] == words[start - 1 + period]) | (words[stop] == words[stop - period])
    size = stop - start - period
    first = 0
    ends = np.cumsum(size)
    while first < len(start):
        done = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, done + len(words), side="right")), first + 1)
        at = np.arange(int(ends[last - 1] - done)) - np.repeat(ends[first:last] - size[first:last] - done, size[first:last])
        at += np.repeat(start[first:last], size[first:last])
        off = words[at] != words[at + np.repeat(period[first:last], size[first:last])]
        wrong[first:last] |= np.add.reduceat(off, ends[first:last] - size[first:last] - done) > 0
        first = last
    if wrong.any():
        fixed = [direct_runs(words, q) for q in np.unique(period[wrong]).tolist()]
        more = [np.full(len(s), q) for (s, _), q in zip(fixed, np.unique(period[wrong]).tolist())]
        start = np.concatenate((start[~wrong], *[s for s, _ in fixed]))
        stop = np.concatenate((stop[~wrong], *[e for _, e in fixed]))
        period = np.concatenate((period[~wrong], *more))
        order = np.lexsort((period, stop, start))
        start, stop, period = start[order], stop[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
        start, stop, period = start[new], stop[new], period[new]
    return start, stop, period


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of each run of `least` words or more, sorted, from the word
    hashes of all texts in turn and how many words each has; and whether each word stays."""
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(sizes), np.int64)
    place[order] = 1 + np.concatenate(([0], np.cumsum(sizes[order] + 1)))[:-1]
    first = np.concatenate(([0], np.cumsum(sizes)))
    here = np.arange(len(words)) - np.repeat(first[:-1], sizes) + np.repeat(place, sizes)
    line = stream(31, len(words) + len(sizes) + 1)
    line[here] = words
    start, stop, period = found_runs(line, sizes[order])
    long = stop - start >= least
    start, stop, period = start[long], stop[long], period[long]
    staying = ~covered(start + period, stop, len(line))[here]
    row = order[np.searchsorted(place[order], start, side="right") - 1] if len(start) else start
    start, size = start - place[row], stop - start
    by = np.lexsort((period, start, row))
    return row[by], start[by], size[by], period[by], staying


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """The words of each of n texts, joined by one space; rows are in order."""
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    size = ends - starts + ~last
    bounds = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(int(bounds[-1])) - np.repeat(bounds[:-1] - starts, size)
    space = np.zeros(len(at), bool)
    space[bounds[1:][~last] - 1] = True
    at[space] = 0
    out = np.where(space, np.uint8(0x20), data[at]) if len(at) else np.zeros(0, np.uint8)
    offsets = bounds[np.searchsorted(row, np.arange(n + 1))]
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out.tobytes()))


RUN = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, sorted by start and period) and collapsed (the
    text's words without those that a run repeats, joined by one space) for each row of documents.

    Words are the parts between blanks; a run has at least `least` words and two whole periods, and
    its first period stays. Whole texts are used; a null text counts as an empty one, which has no
    words, no runs and an empty collapsed text. Repeated rows are each judged, ids play no part and
    may be null, and further columns play no part. An empty table gives no rows. One text has to fit
    into a task's memory some fifty times.
    """
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))

    def work(batches):
        for batch in blocks(batches, most=BLOCK):
            data, bounds = text_buffers(batch.column(1))
            starts, ends, before = word_bounds(data, bounds, SOLID)
            words = word_hashes(data, starts, ends, np.where(SOLID, BYTE_CODE, np.uint64(0)))
            sizes = np.diff(before)
            row, start, size, period, stays = runs_of(words, sizes, least)
            n = batch.num_rows
            of = np.repeat(np.arange(n), sizes)[stays]
            text = joined_words(data, starts[stays], ends[stays], of, n)
            run = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, size, period)], ["start", "length", "period"])
            offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, run), text.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_words long, runs {RUN}, collapsed string")
