import numpy as np
import pytest

from . import brute
from .brute import SMALL, prose
from pawledger.llm import queries, suffix_arrays
from pawledger.llm.suffix_arrays import clean, contamination, matches, suffix_array

ORDER = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_query_equals_brute_force(spark, small):
    items = [tuple(r) for r in small("benchmark").select("item_id", "text").collect()]
    found = {r.doc_id: tuple(r[c] for c in ORDER) for r in queries.op3_decontamination(spark, SMALL).collect()}
    rows = small("documents").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for row in rows:
        assert found[row.doc_id] == brute.contamination(row.text, items), row.doc_id
    assert any(v[4] for v in found.values())


@pytest.fixture
def benchmark(spark):
    passage = prose(30, 1)
    rows = [("b", passage, "x"), ("a", passage, "x"), ("short", "Two words", "x"), ("none", "...", "x"), ("null", None, "x"), (None, "lost item", "x"),
            ("twice", prose(9, 5) + " " + prose(9, 5), "x")]
    return spark.createDataFrame(rows, "item_id string, text string, doc_id string")


def documents():
    passage = prose(30, 1)
    return [
        (1, None), (2, ""), (3, "x " + passage + " y"), (4, passage.upper().replace(" ", ", ")), (5, "two, WORDS two words"),
        (6, " ".join(passage.split()[:9])), (7, " ".join(passage.split()[:10])), (8, prose(20_000, 7) + " " + passage + " " + prose(20_000, 8)),
        (8, "lost item"), (None, passage), (9, "two"), (9, "two"), (10, "words two"), (11, prose(9, 5) + " " + prose(9, 5) + " " + prose(9, 5)),
    ]


def test_odd_rows(spark, table, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    rows = documents()
    for most in (1, 1 << 20):
        passes = list(suffix_arrays.read_benchmark(benchmark, most))
        assert most > 1 or len(passes) > 2
    found = contamination(table(rows), benchmark).collect()
    got = sorted(((r.doc_id, *[r[c] for c in ORDER]) for r in found), key=str)
    assert got == sorted(((doc, *brute.contamination(text, items)) for doc, text in rows), key=str)
    kept = sorted((r.doc_id or -1, r.text or "") for r in clean(table(rows), benchmark).collect())
    assert kept == sorted((doc or -1, text or "") for doc, text in rows if not brute.contamination(text, items)[4])
    assert clean(table(rows), benchmark).columns == table(rows).columns


def test_passes_over_a_large_benchmark(table, benchmark, monkeypatch):
    whole = sorted(map(str, contamination(table(documents()), benchmark).collect()))
    parts = list(suffix_arrays.read_benchmark(benchmark, 1))
    monkeypatch.setattr(suffix_arrays, "read_benchmark", lambda b: parts)
    assert sorted(map(str, contamination(table(documents()), benchmark).collect())) == whole


def test_empty_tables(table, benchmark):
    assert contamination(table([]), benchmark).count() == 0
    found = contamination(table([(1, "two words")]), benchmark.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in found] == [(2, 0, False)]
    assert matches(table([(1, "two words")]), benchmark.limit(0)).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n, most in ((0, 3), (1, 2), (200, 3), (500, 2), (300, 50)):
        words = rng.integers(0, most, n)
        for depth in (1, 2, 5, 64):
            order = suffix_array(words, depth)
            assert sorted(order.tolist()) == np.flatnonzero(words).tolist()

            def key(at):
                suffix = []
                for word in words[at : at + depth].tolist():
                    if not word:
                        break
                    suffix.append(word)
                return suffix

            keys = [key(at) for at in order.tolist()]
            assert keys == sorted(keys)


def test_longest_matches(table, spark):
    item = prose(20, 2).split()
    benchmark = spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")
    text = "zz " + " ".join(item[3:18]) + " yy " + " ".join(item[:4])
    found = matches(table([(1, text), (2, " ".join(item[5:])), (None, None)]), benchmark, least=4).collect()
    got = {(r.doc_id, r.item_word, r.doc_word, r.n_words) for r in found}
    assert (1, 3, 1, 15) in got and (1, 0, 17, 4) in got and (2, 5, 0, 15) in got
    words = text.split()
    for doc, at, place, n in got:
        if doc == 1:
            assert words[place : place + n] == item[at : at + n]


def brute_longest(text, passage, least):
    """The longest run of words that a text and a passage share: (-length, text word, passage word)."""
    a, b = brute.re.findall(brute.ALNUM, brute.lower(text)), brute.re.findall(brute.ALNUM, brute.lower(passage))
    best, before = (0, 0, 0), [0] * (len(b) + 1)
    for i, word in enumerate(a):
        now = [0] * (len(b) + 1)
        for j, other in enumerate(b):
            if word == other:
                now[j + 1] = before[j] + 1
                best = min(best, (-now[j + 1], i - now[j + 1] + 1, j - now[j + 1] + 1))
        before = now
    return best if -best[0] >= min(least, len(b)) > 0 else None


def test_longest_match_of_each_document_and_item(table, spark):
    rng = np.random.default_rng(4)
    items = [(f"i{k}", " ".join(f"v{x}" for x in rng.integers(0, 3, n))) for k, n in enumerate((3, 9, 10, 14, 25, 40))]
    rows = [(k, " ".join(f"v{x}" for x in rng.integers(0, 3, 120))) for k in range(12)]
    rows += [(100 + k, prose(30, k) + " " + " ".join(text.split()[:n]) + " " + prose(9, k)) for k, (_, text) in enumerate(items) for n in (8, 12, 40)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = contamination(table(rows), benchmark).collect()
    texts = [text for _, text in rows]
    by_text = {}
    for r, text in zip(found, texts):
        by_text[text] = r
    for text, r in by_text.items():
        want = {item: brute_longest(text, passage, 10) for item, passage in items}
        want = {item: m for item, m in want.items() if m}
        assert {m.item_id: (-m.n_words, m.doc_word, m.item_word) for m in r.matches} == want
        assert r.item_ids == sorted(want) and r.longest == max((-m[0] for m in want.values()), default=0)


def test_longest_matches_of_every_suffix_and_document(table, spark):
    """Also where a shard has a longer match of the same suffix in another document."""
    item = prose(30, 2).split()
    benchmark = spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")
    rows = [(1, " ".join(item)), (2, "x " + " ".join(item[:12]) + " y"), (3, " ".join(item[4:20]))]
    got = {(r.doc_id, r.item_word, r.doc_word, r.n_words) for r in matches(table(rows).coalesce(1), benchmark).collect()}
    want = {(1, k, k, 30 - k) for k in range(21)} | {(2, k, k + 1, 12 - k) for k in range(3)} | {(3, k, k - 4, 20 - k) for k in range(4, 11)}
    assert got == want


def test_a_benchmark_beyond_the_bound_is_refused(table, benchmark, monkeypatch):
    monkeypatch.setattr(suffix_arrays, "BENCHMARK_MOST", 100)
    with pytest.raises(ValueError):
        contamination(table(documents()), benchmark)
