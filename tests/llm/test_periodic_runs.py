import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from . import brute
from .brute import SMALL
from pawledger.llm import queries
from pawledger.llm.periodic_runs import checked, periodic_runs, runs_of
from pawledger.llm.words import mix

COLUMNS = "doc_id long, text string, n_words string, runs string, collapsed string, best string"


def runs(words, least=12):
    """All (start, length, period), period by period; a stretch counts with its smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                best.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def cycled(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in small("documents").collect()}
    found = queries.op12_periodic_runs(spark, SMALL).collect()
    assert len(found) == len(texts)
    seen = 0
    for r in found:
        words = cycled(r.doc_id, re.findall(brute.BLANKS, texts[r.doc_id] or ""))
        want = runs(words) if len(words) < 3000 else numpy_runs(words)
        best = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in want))
        assert r.collapsed_sha256 == brute.sha(collapsed(words, want))
        seen += bool(want)
    assert seen > 10


def numpy_runs(words):
    """The same as runs(), by one comparison of the whole text for each period."""
    names = {w: i for i, w in enumerate(sorted(set(words)))}
    line, best = np.array([names[w] for w in words]), {}
    for q in range(1, len(line) // 2 + 1):
        same = np.concatenate(([False], line[q:] == line[:-q], [False])).astype(np.int8)
        turn = np.diff(same)
        for s, e in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
            if e - s >= q and e + q - s >= 12:
                best.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def of_numbers(texts, least=2):
    words = np.array([x for t in texts for x in t], np.uint64)
    row, start, size, period, stays = runs_of(mix(words + np.uint64(1)), np.array([len(t) for t in texts]), least)
    out = [[] for _ in texts]
    for k, *run in zip(row.tolist(), start.tolist(), size.tolist(), period.tolist()):
        out[k].append(tuple(run))
    return out, stays


def agrees(texts):
    found, stays = of_numbers(texts)
    at = 0
    for text, got in zip(texts, found):
        assert got == runs(text, 2), text
        drop = {i for s, n, q in got for i in range(s + q, s + n)}
        assert stays[at : at + len(text)].tolist() == [i not in drop for i in range(len(text))]
        at += len(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), min_size=1, max_size=6))
def test_runs_of_few_letters(texts):
    agrees(texts)


def power(rng, size):
    """Words made of powers of powers, with a few changes."""
    word = [rng.randrange(3) for _ in range(rng.randrange(1, 5))]
    while len(word) < size:
        word = word * rng.randrange(1, 14) + word[: rng.randrange(len(word) + 1)]
        if rng.random() < 0.4:
            word = word + [rng.randrange(4) for _ in range(rng.randrange(1, 4))]
    word = word[:size]
    for _ in range(rng.randrange(3)):
        word[rng.randrange(size)] = rng.randrange(5)
    return word


def test_runs_of_powers():
    rng = random.Random(7)
    for _ in range(60):
        agrees([power(rng, rng.randrange(20, 700)) for _ in range(3)])


def test_hidden_runs():
    """Two touching highly periodic regions make runs of many longer periods."""
    for small in ([0, 1], [0, 1, 2], [0, 0, 1], [0, 1, 0, 2, 2]):
        for cut in range(1, len(small)):
            region = small * 40
            agrees([region + region[cut:], region[: 25 * len(small) + cut] + region[: 30 * len(small) + cut] + [9] + region])


def test_words_of_well_known_sequences():
    fibonacci, thue = [[1], [0]], [0]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    while len(thue) < 4096:
        thue = thue + [1 - x for x in thue]
    agrees([fibonacci[-1], thue[:1100]])
    found, _ = of_numbers([thue + thue], 12)
    want = numpy_runs(thue + thue)
    assert found[0] == want and (0, 8192, 4096) in want


def test_wrongly_drawn_runs_are_drawn_anew():
    text = [90, *[x for x in range(7)] * 5, 17, 18, *[13, 14] * 9, 91]
    start, stop, period = checked(np.array(text, np.uint64), np.array([1, 2, 38]), np.array([30, 40, 56]), np.array([7, 7, 2]))
    assert (start.tolist(), stop.tolist(), period.tolist()) == ([1, 38], [36, 56], [7, 2])


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a " * 12), (4, "a " * 12), (5, "a " * 11), (None, "x y " * 10), (6, "é\x00 ñ " * 8),
        (7, "one"), (8, " ".join(str(k % 700) for k in range(30_000))), (9, "w" * 300_000 + " v" * 20),
    ]
    table = spark.createDataFrame([(d, t, "a", "b", "c", "d") for d, t in rows], COLUMNS)
    found = periodic_runs(table.coalesce(1)).collect()
    assert len(found) == len(rows)
    for r, (doc, text) in zip(found, rows):
        words = re.findall(brute.BLANKS, text or "")
        want = numpy_runs(words) if words else []
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs]) == (doc, len(words), want)
        assert r.collapsed == collapsed(words, want)
    assert periodic_runs(table.limit(0)).collect() == []


@pytest.mark.parametrize("sizes", [[], [0], [0, 0, 3]])
def test_texts_without_runs(sizes):
    row, *_, stays = runs_of(mix(np.arange(sum(sizes), dtype=np.uint64)), np.array(sizes, np.int64))
    assert len(row) == 0 and stays.all()
