"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, union-find.

Lines are the parts of a text between newlines. They are compared in lower case (A-Z), with runs of
blanks as one space and none at the ends; a line without anything else is left alone. A line's set
are its runs of SHINGLE characters, or the whole of a shorter line. Equal lines are one class; each
class has BANDS keys of BAND_ROWS MinHashes each (a pair at a similarity of 0.8 shares none about
once in 800, at 0.9 once in two million). A sketch of all its MinHashes tells which classes have a
near one among those that share a key with them; only their lines are read again, once, and go to
each of these keys. There near lines that are not connected yet are compared by their full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .groups import components, linked_edges, partnered
from .store import stored
from .words import LOWER, blocks, mix, stream, text_buffers

SHINGLE = 10
BANDS, BAND_ROWS = 10, 3
HASHES = BANDS * BAND_ROWS
#: MinHashes of which two bits may differ in near sketches. At a similarity of 0.8, 4.5 of 30
#: do on average and more than 13 about once in 20,000 pairs; of unrelated lines, 22.5 do.
DISTANCE = 13
LINE_BLOCK = 1 << 18
#: Each hash function gives two MinHashes: the least value, and the greatest, which is the least of
#: the reverse order.
FUNCTIONS = HASHES // 2
FLIPS = (stream(21, FUNCTIONS) >> np.uint64(32)).astype(np.uint32)
FACTORS = (stream(22, FUNCTIONS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: Values hashed at once, so that they stay in the cache.
CACHED = 1 << 15
#: 64-bit words of the parity of a line's set; a power of two.
PARITY_WORDS = 8
#: Two codes for each of the first places of a line.
PLACES = 1 << 12
PLACE_CODES = (stream(24, PLACES) | np.uint64(1), stream(25, PLACES) | np.uint64(1))
STEPS = stream(23, 8) | np.uint64(1)
NEWLINE, SPACE = 0x0A, 0x20
#: A-Z in lower case, and each blank of a line as a space.
NORMAL = bytes(SPACE if b in b"\t\v\f\r" else int(LOWER[b]) for b in range(256))
#: Codes of the characters up to 255.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes and the bounds of the texts in them."""
    text = data.tobytes().decode()
    if len(text) == len(data):
        return data, bounds
    before = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    try:
        points = np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return points, before[bounds].astype(np.int64)


def line_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised UTF-8 bytes of all lines, the lines' n + 1 bounds in them, the row of each line and
    its number in the row. A null text has no lines."""
    data, bounds = text_buffers(column)
    low, ends = data.tobytes().translate(NORMAL), bounds.tolist()
    # One newline after each text ends its last line.
    text = np.frombuffer(bytearray(b"".join([low[a:b] + b"\n" for a, b in zip(ends[:-1], ends[1:])])), np.uint8)
    last = bounds[1:] + np.arange(len(bounds) - 1)
    breaks = np.flatnonzero(text == NEWLINE)
    line_start = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else breaks
    # A blank goes if another blank or the line's end follows it, or if it begins the line.
    blank = (text == SPACE) | (text == NEWLINE)
    twice = blank[:-1] & blank[1:]
    early = np.flatnonzero(twice)
    ends_run = early[~np.append(twice, False)[early + 1]] + 1
    begins_run = early[~np.append(False, twice)[early]]
    leads = ends_run[(begins_run == 0) | (np.searchsorted(breaks, begins_run) < np.searchsorted(breaks, ends_run))]
    single = text[line_start] == SPACE
    text[early] = NEWLINE
    text[leads] = NEWLINE
    text[line_start[single]] = NEWLINE
    gone = np.flatnonzero(text == NEWLINE)
    starts = line_start - np.searchsorted(gone, line_start)
    starts = np.append(starts, len(text) - len(gone))
    row = np.searchsorted(last, breaks)
    first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(last)))))[:-1]
    number = np.arange(len(breaks)) - first[row] if len(breaks) else breaks
    if column.null_count:
        # A null text is one empty line here: it holds no bytes, so bounds stay in order.
        drop = np.flatnonzero(~np.asarray(column.is_valid())[row])
        starts, row, number = np.delete(starts, drop), np.delete(row, drop), np.delete(number, drop)
    return np.frombuffer(text.tobytes().translate(None, b"\n"), np.uint8), starts, row, number


def characters(column: pa.Array, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the lines of a column, and the lines' bounds in them. Where the texts are no
    UTF-8, bytes count as one character each."""
    try:
        text_buffers(column)[0].tobytes().decode()
    except UnicodeDecodeError:
        return data, starts
    return code_points(data, starts)


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised characters of all lines, the lines' n + 1 bounds in them, the row of each line and
    its number in the row. A null text has no lines."""
    data, starts, row, number = line_bytes(column)
    return *characters(column, data, starts), row, number


def digests(data: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """16 bytes for each line, by its bytes."""
    raw = memoryview(data.tobytes())
    ends = starts.tolist()
    return [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:])]


def prints(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each line, by its characters' codes and their places."""
    sizes = np.diff(starts)
    out = np.zeros((len(sizes), 2), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        place = np.arange(len(code)) - np.repeat(starts[full], sizes[full])
        beyond = np.flatnonzero(place >= PLACES)
        for k, codes in enumerate(PLACE_CODES):
            weight = codes[place & (PLACES - 1)]
            weight[beyond] += mix((place[beyond] >> 12).astype(np.uint64) + np.uint64(k)) << np.uint64(1)
            weight *= code
            out[full, k] = np.add.reduceat(weight, starts[full])
    out[:, 1] += sizes.astype(np.uint64)
    return mix(out)


def char_codes(chars: np.ndarray) -> np.ndarray:
    if chars.dtype == np.uint8:
        return BYTE_CODES[chars]
    return mix(chars.astype(np.uint64) + np.uint64(1))


def shingles(code: np.ndarray, starts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lines (one for a line of up to `width` characters, none for an empty
    one) and their n + 1 bounds, from the characters' codes."""
    n = len(code)
    powers, length, value = {1: code}, 1, code
    while 2 * length <= width:
        step = STEPS[length.bit_length()]
        value = value[: max(n - 2 * length + 1, 0)] * step + value[length : max(n - length + 1, length)]
        length *= 2
        powers[length] = value
    total, done = powers[length], length
    while done < width:
        part = max(k for k in powers if k <= width - done)
        size = max(n - done - part + 1, 0)
        total = total[:size] * STEPS[0] + powers[part][done : done + size]
        done += part
    sizes = np.diff(starts)
    windows = np.maximum(sizes - width + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(np.where(sizes > 0, np.maximum(windows, 1), 0))))
    out = np.empty(int(bounds[-1]), np.uint64)
    # A window begins at each character but the last width - 1 of a line.
    begins = np.ones(n, bool)
    for k in range(1, width):
        begins[starts[1:][sizes >= k] - k] = False
    short_line = (sizes > 0) & (windows == 0)
    short = np.flatnonzero(short_line)
    if len(short):
        whole = np.ones(len(out), bool)
        whole[bounds[short]] = False
        out[whole] = total[begins[: len(total)]]
        whole = np.repeat(short_line, sizes)
        out[bounds[short]] = prints(code[whole], np.concatenate(([0], np.cumsum(sizes[short]))))[:, 0]
    else:
        out[:] = total[begins[: len(total)]]
    return out, bounds


def min_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES MinHashes of each line that has shingles."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    out = np.full((len(bounds) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    first, ends = 0, bounds[full + 1]
    while first < len(full):
        last = int(np.searchsorted(ends, bounds[full[first]] + CACHED, side="right"))
        last = max(last, first + 1)
        rows = full[first:last]
        begin = bounds[rows]
        part = short[begin[0] : ends[last - 1]]
        begin = begin - begin[0]
        value = np.empty_like(part)
        for k in range(FUNCTIONS):
            np.bitwise_xor(part, FLIPS[k], out=value)
            np.multiply(value, FACTORS[k], out=value)
            out[rows, 2 * k] = np.minimum.reduceat(value, begin)
            out[rows, 2 * k + 1] = np.maximum.reduceat(value, begin)
        first = last
    return out


def sketch(low: np.ndarray) -> np.ndarray:
    """Two bits of each MinHash in one 64-bit number."""
    bits = mix(low.astype(np.uint64)) & np.uint64(3)
    return (bits << (np.arange(HASHES, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    bands = low.reshape(len(low), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(BAND_ROWS):
        key = mix(key ^ bands[:, :, k])
    return key


def line_table(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, version (of the text), line, print, sketch, keys: a row for each line that is not blank."""

    def work(batches):
        for batch in blocks(batches, most=LINE_BLOCK):
            data, starts, row, number = line_bytes(batch.column(1))
            chars, places = characters(batch.column(1), data, starts)
            low = min_hashes(*shingles(char_codes(chars), places, shingle))
            full = np.flatnonzero(np.diff(starts))
            ends = np.append(starts[full], starts[-1])  # blank lines hold no bytes
            rows = pa.array(row[full])
            keys = (band_keys(low[full]) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(len(full), BANDS, 8)[:, :, :6]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(2).take(rows),
                    pa.array(number[full].astype(np.int32)),
                    pa.array(digests(data, ends), pa.binary()),
                    pa.array(sketch(low[full]).view(np.int64)),
                    fixed(np.ascontiguousarray(keys.reshape(len(full), BANDS * 6))),
                ],
                ["doc_id", "version", "line", "print", "sketch", "keys"],
            )

    return versions(documents).where("doc_id is not null").mapInArrow(
        work, "doc_id long, version long, line int, print binary, sketch long, keys binary"
    )


def versions(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("version", F.xxhash64("text"))


def fixed(table: np.ndarray) -> pa.Array:
    """The rows of a table of numbers as binary values."""
    data = np.ascontiguousarray(table).view(np.uint8).reshape(len(table), table.shape[1] * table.itemsize)
    bounds = np.arange(len(table) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(bounds), pa.py_buffer(data.tobytes())])


def probes(classes: DataFrame) -> DataFrame:
    """key, node, sketch: one row for each band."""

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n * BANDS, 6)
            keys = np.zeros((n * BANDS, 8), np.uint8)
            keys[:, :6] = raw
            rows = pa.array(np.repeat(np.arange(n), BANDS))
            numbers = keys.reshape(-1).view(np.int64)
            sketches = np.repeat(batch.column(1).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column(0).take(rows), pa.array(sketches)], ["key", "node", "sketch"])

    return classes.select("node", "sketch", "keys").mapInArrow(work, "key long, node long, sketch long")


def near_sketches(sketches: pa.ChunkedArray) -> Callable:
    table = sketches.to_numpy().view(np.uint64)

    def linked(i, j):
        differ = table[i] ^ table[j]
        differ = (differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)
        return np.bitwise_count(differ) <= DISTANCE

    return linked


def parities(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """PARITY_WORDS * 64 bits for each distinct set: each element turns one bit over. Two of them differ
    in at most as many bits as elements are in one set only."""
    out = np.zeros((len(bounds) - 1, PARITY_WORDS), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    bit = np.uint64(1) << (values & np.uint64(63))
    word = (values >> np.uint64(6)) & np.uint64(PARITY_WORDS - 1)
    for k in range(PARITY_WORDS if len(full) else 0):
        out[full, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), bounds[full])
    return out


def line_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each line of a column."""
    for batch in blocks([pa.RecordBatch.from_arrays([column], ["text"])], most=LINE_BLOCK):
        chars, starts, _, _ = lines(batch.column(0))
        values, bounds = shingles(char_codes(chars), starts, shingle)
        ends = bounds.tolist()
        for a, b in zip(ends[:-1], ends[1:]):
            found = values[a:b]
            found.sort()
            yield found[np.concatenate(([True], found[1:] != found[:-1]))] if b > a else found


def similar_lines(table: pa.Table, percent: int, shingle: int = SHINGLE) -> Callable:
    """Tells which pairs have 100 * intersection >= percent * union of their shingle sets.

    Pairs whose parities show that too many elements differ are not compared further.
    """
    near = near_sketches(table.column("sketch"))
    sets = [found for column in table.column("text").chunks for found in line_sets(column, shingle)]
    sizes = np.array([len(s) for s in sets], np.int64)
    parity = parities(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum(sizes))))

    def linked(i, j):
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        hit = (100 * small >= percent * large) & near(i, j)
        some = np.flatnonzero(hit)
        # With d elements in one set only, 100 * intersection >= percent * union is
        # (100 + percent) * d <= (100 - percent) * (sum of the sizes).
        differ = np.bitwise_count(parity[i[some]] ^ parity[j[some]]).sum(axis=1, dtype=np.int64)
        hit[some] = (100 + percent) * differ <= (100 - percent) * (small + large)[some]
        for k in np.flatnonzero(hit):
            both = np.concatenate((sets[i[k]], sets[j[k]]))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            hit[k] = 100 * common >= percent * (len(both) - common)
        return hit

    return linked


def texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, sketch, keys and text for the wanted lines (their doc_id, version and line)."""
    one = F.struct("line", "node", "keys", "sketch")
    asked = wanted.groupBy("doc_id", "version").agg(F.collect_list(one).alias("asked"))
    parts = versions(documents).join(asked.hint("shuffle_hash"), ["doc_id", "version"])
    parts = parts.select(F.split("text", "\n").alias("parts"), F.explode("asked").alias("one"))
    lines = parts.select("one.node", "one.sketch", "one.keys", F.get("parts", F.col("one.line")).alias("text"))
    return lines.dropDuplicates(["node"])  # rows may repeat a document


def line_verdicts(documents: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, version, line and first (whether the line stays) for each line that is not blank.

    Lines are linked if 100 * intersection >= percent * union of their shingle sets. Of each
    component the line of the smallest (doc_id, version, line) stays.
    """
    found = stored(line_table(documents, shingle), "lines")
    owner = F.min(F.struct("doc_id", "version", "line")).alias("owner")
    size = F.count(F.lit(1)).alias("size")
    classes = found.groupBy("print").agg(owner, size, F.min("sketch").alias("sketch"), F.min("keys").alias("keys"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "line-classes")
    near = stored(partnered(probes(classes), lambda table: near_sketches(table.column("sketch"))), "near-lines")
    asked = near.groupBy("node").agg(F.collect_set("key").alias("asked"))
    wanted = classes.select("node", "sketch", "owner").join(asked.hint("shuffle_hash"), "node").select("node", "sketch", F.col("asked").alias("keys"), "owner.*")
    texts = stored(texts_of(documents, wanted), "line-texts")
    met = texts.select(F.explode("keys").alias("key"), "node", "sketch", "text")
    links = linked_edges(met, lambda table: similar_lines(table, percent, shingle), "line-links")
    linked = components(links, "linked-lines")
    # A line that is alone in its class and linked to nothing stays: only the other classes are joined.
    others = classes.join(linked.hint("shuffle_hash"), "node", "left").where("size > 1 or root is not null")
    others = stored(others.select("print", "owner", "root"), "line-members")
    tied = others.where("root is not null")
    firsts = tied.groupBy("root").agg(F.min("owner").alias("first"))
    named = tied.join(firsts, "root").select("print", "first")
    named = named.union(others.where("root is null").select("print", F.col("owner").alias("first")))
    here = F.struct("doc_id", "version", "line")
    rows = found.select("doc_id", "version", "line", "print").join(named.hint("shuffle_hash"), "print", "left")
    return rows.select("doc_id", "version", "line", F.coalesce(here == F.col("first"), F.lit(True)).alias("first"))


def cut_lines(rows: DataFrame) -> DataFrame:
    """text (without the lines numbered in `gone`), row, lines (of the whole text) and removed."""

    def work(batches):
        for batch in blocks(batches):
            texts, lost = batch.column("text"), batch.column("gone")
            count = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int32())
            removed = pc.fill_null(pc.list_value_length(lost), 0).cast(pa.int32())
            cut = np.asarray(removed) > 0
            if cut.any():
                left = []
                for k in np.flatnonzero(cut).tolist():
                    drop = set(lost[k].as_py())
                    left.append("\n".join([line for i, line in enumerate(texts[k].as_py().split("\n")) if i not in drop]))
                texts = pc.replace_with_mask(texts, pa.array(cut), pa.array(left, texts.type))
            yield pa.RecordBatch.from_arrays([texts, batch.column("row"), count, removed], ["text", "row", "lines", "removed"])

    return rows.mapInArrow(work, rows.select("text", "row").schema.add("lines", "integer").add("removed", "integer"))


def deduplicated(documents: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """All columns of documents with the text of the lines that stay, and `__lines`, `__removed`.

    Each row keeps its lines but those that repeat, exactly or nearly, another line of a smaller
    (doc_id, version of the text, line). Blank lines stay as they are, and so do rows without a
    doc_id. A null text stays null and has no lines; an empty one has one blank line. Rows that
    repeat a doc_id and its text are one document and all keep the same lines. Columns named like
    the two added ones are replaced. An empty table gives no rows.
    """
    return _with_row(documents, _lines_left(documents, percent, shingle), {"lines": "__lines", "removed": "__removed"})


def _lines_left(documents: DataFrame, percent: int, shingle: int) -> DataFrame:
    """text (of the lines that stay), row (the other columns), lines and removed for each row."""
    gone = line_verdicts(documents, percent, shingle).where("not first")
    gone = stored(gone.groupBy("doc_id", "version").agg(F.collect_set("line").alias("gone")), "lines-gone")
    others = [c for c in documents.columns if c != "text"]
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("version"),
        F.col("text").cast("string").alias("text"),
        F.struct(*others).alias("row"),
    )
    rows = rows.join(gone.hint("shuffle_hash"), ["doc_id", "version"], "left").select("text", "row", "gone")
    return cut_lines(rows)


def _with_row(documents: DataFrame, left: DataFrame, more: dict[str, str]) -> DataFrame:
    """The columns of documents with the new text, and more columns by their new names."""
    own = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns if c not in more.values()]
    return left.select(*own, *[F.col(name).alias(new) for name, new in more.items()])


def without_repeated_lines(documents: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """The documents with the lines that stay; one that had lines and has none left goes."""
    left = _lines_left(documents, percent, shingle)
    emptied = (F.col("removed") > 0) & ~F.col("text").rlike("[^ \\t-\\r]")
    return _with_row(documents, left.where(~F.coalesce(emptied, F.lit(False))), {})
