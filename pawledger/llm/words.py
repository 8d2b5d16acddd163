"""Vectorised text helpers for Arrow batches: bytes, word bounds, hashes, shingles.

All of them work on whole texts. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20

UPPER = np.arange(256, dtype=np.uint8)
LOWER = np.where((UPPER >= 0x41) & (UPPER <= 0x5A), UPPER + 32, UPPER).astype(np.uint8)
#: Letters, digits and everything beyond ASCII.
ALNUM = ((UPPER >= 0x30) & (UPPER <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (UPPER >= 0x80)
#: Everything but blanks.
SOLID = ~((UPPER == 0x20) | ((UPPER >= 0x09) & (UPPER <= 0x0D)))


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each 64-bit value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * step)


BYTE_CODE = stream(1, 256)
PLACES = 1 << 16
PLACE_CODE = stream(2, PLACES) | np.uint64(1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 bounds of its texts."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    first, last = int(bounds[0]), int(bounds[-1])
    data = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return data, bounds.astype(np.int64) - first


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most so many text bytes (or of one row)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, bounds = text_buffers(column)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def word_bounds(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and how many words precede each text (n + 1)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    inside, after = inside[:-1], inside[1:]
    starts = np.flatnonzero(after & (~inside | cut))
    ends = np.flatnonzero(inside & (~after | cut))
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; code gives a value for each byte (0 for bytes of no word)."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + BLOCK_BYTES, side="right")), first + 1)
        lo, hi = int(starts[first]), int(ends[last - 1])
        begin = starts[first:last] - lo
        place = np.arange(hi - lo, dtype=np.int32)
        place -= np.repeat(begin, np.diff(np.append(begin, hi - lo))).astype(np.int32)
        if len(place) and int((ends[first:last] - starts[first:last]).max()) > PLACES:
            weight = PLACE_CODE[place & (PLACES - 1)] ^ mix((place >> 16).astype(np.uint64) << np.uint64(1))
        else:
            weight = PLACE_CODE[np.minimum(place, PLACES - 1)]
        weight *= code[data[lo:hi]]
        out[first:last] = np.add.reduceat(weight, begin)
        first = last
    return mix(out + (ends - starts).astype(np.uint64))


def lower_code(kind: np.ndarray) -> np.ndarray:
    """Byte values for hashes that do not tell A-Z from a-z."""
    return np.where(kind, BYTE_CODE[LOWER], np.uint64(0))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of so many words, one for each start (also across texts)."""
    n = max(len(words) - width + 1, 0)
    out = np.full(n, np.uint64(width))
    for weight, i in zip(stream(3, width) | np.uint64(1), range(width)):
        out += words[i : i + n] * weight
    return mix(out)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `width` consecutive words (blanks part words, A-Z in
    lower case). A text of fewer words has one, of all its words; a text without words none."""
    starts, ends, before = word_bounds(data, bounds, SOLID)
    words = word_hashes(data, starts, ends, lower_code(SOLID))
    windows = window_hashes(words, width)
    out = []
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist()):
        if hi - lo >= width:
            found = np.sort(windows[lo : hi - width + 1])
            keep = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            out.append(found[keep])
        else:
            out.append(window_hashes(words[lo:hi], hi - lo) if hi > lo else words[:0])
    return out


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits for a set of distinct hashes, whatever their order."""
    a = mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix(values + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return np.array([a, b + np.uint64(len(values))], np.uint64).tobytes()
