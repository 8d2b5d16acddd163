import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import brute
from .brute import SMALL, prose
from pawledger.llm import groups, near_documents, queries
from pawledger.llm.groups import whole_runs

ORDER = ["doc_id", "n_shingles", "component_id", "kept"]


def by_id(df):
    return sorted((tuple(r) for r in df.select(*ORDER).collect()), key=str)


def expected(rows, percent=85):
    found = brute.components(rows, percent)
    return sorted(((doc, *found[k], found[k][1] is None or found[k][1] == doc) for k, (doc, _) in enumerate(rows)), key=str)


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in small("documents").select("doc_id", "text").collect()]
    assert by_id(queries.op5_near_duplicates(spark, SMALL)) == expected(rows)


def test_odd_rows(table):
    long_text = prose(30_000, 3)
    rows = [
        (9, None), (8, ""), (7, " \t\n"), (6, "one two"), (5, "ONE  two"), (4, "one two three four five"),
        (3, long_text), (2, long_text + " more"), (None, long_text), (1, prose(40, 1)), (1, prose(40, 1)), (1, prose(40, 2)),
        (0, "É two"), (10, "é two"), (11, "one two"),
    ]
    assert by_id(near_documents.near_duplicates(table(rows))) == expected(rows)


def test_empty_table(table):
    assert near_documents.near_duplicates(table([])).count() == 0


def chains(n, words=60):
    """Copies that each differ from the one before in a few words: links are chains."""
    base = prose(words, 5).split()
    out = []
    for k in range(n):
        base = base[:]
        base[(7 * k) % words] = f"new{k}"
        out.append((100 + k, " ".join(base)))
    return out


def test_chains_and_a_hot_group(table, monkeypatch):
    rows = chains(40) + [(k, prose(80, 9)) for k in range(50)]
    base = prose(100, 11).split()
    for k in range(60):
        changed = base[:]
        changed[k] = f"x{k}"
        changed[(k * 7 + 3) % 100] = f"y{k}"
        rows.append((500 + k, " ".join(changed)))
    assert by_id(near_documents.near_duplicates(table(rows), 80)) == expected(rows, 80)


def test_blocks_give_the_same_links(spark):
    values = [3, 7, 8, 20, 21, 22, 23, 40, 60, 61, 90, 91, 92, 93]
    rows = spark.createDataFrame([(1, v) for v in values], "grp long, node long")

    def links(table):
        node = table.column("node").to_numpy()
        return lambda i, j: np.abs(node[i] - node[j]) == 1

    for most in (2, 3, 5, 100):
        edges = groups.compared(rows, "grp", "node", links, most)
        found = {r.node: r.root for r in groups.components(edges, "test").collect()}
        assert found == {7: 7, 8: 7, 20: 20, 21: 20, 22: 20, 23: 20, 60: 60, 61: 60, 90: 90, 91: 90, 92: 90, 93: 90}, most


def test_long_runs_pass_through(spark):
    rows = [(k % 2, k, bytes([k // 10] * near_documents.SYMBOLS)) for k in range(60)] + [(5, 99, b"\x00" * 40)]
    keys = spark.createDataFrame(rows, "key long, node long, sketch binary")
    for most in (4, 1000):
        edges = groups.candidate_edges(keys, near_documents.near_signatures, "test", most)
        found = {r.node: r.root for r in groups.components(edges, "test").collect()}
        assert found == {k: k // 10 * 10 + k % 2 for k in range(60)}, most


def test_whole_runs_across_batches():
    key = np.sort(np.random.default_rng(1).integers(0, 40, 500))
    for size in (1, 7, 100, 500):
        batches = [pa.record_batch([pa.array(key[i : i + size])], ["key"]) for i in range(0, 500, size)]
        for most in (5, 12, 1000):
            tables = list(whole_runs(iter(batches), ["key"], most))
            assert np.array_equal(np.concatenate([t.column("key").to_numpy() for t, _ in tables]), key)
            for t, is_long in tables:
                for value in np.unique(t.column("key").to_numpy()):
                    own = (t.column("key").to_numpy() == value).sum()
                    assert is_long == ((key == value).sum() > most)
                    assert is_long or own == (key == value).sum()


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    union = brute.Union()
    for a, b in pairs:
        if a != b:
            union.join(a, b)
    roots = {}
    for x in union.up:
        roots[union.find(x)] = min(roots.get(union.find(x), x), x)
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.root for r in groups.components(edges, "test").collect()}
    assert found == {x: roots[union.find(x)] for x in union.up}
    assert groups.components(edges.where(F.lit(False)), "test").count() == 0


def test_pigeonhole_keys():
    """Signatures that differ in up to 2 * CHUNKS - 1 symbols share a key, however the differences lie."""
    rng = np.random.default_rng(3)
    width = near_documents.SYMBOLS // near_documents.CHUNKS
    for _ in range(200):
        differ = rng.choice(near_documents.SYMBOLS, 2 * near_documents.CHUNKS - 1, replace=False)
        assert np.bincount(differ // width, minlength=near_documents.CHUNKS).min() <= 1


def test_one_row_of_each_group_stays(table):
    x, y = prose(100, 1), prose(100, 2)
    near = near_documents.without_duplicates
    left = near(table([(1, x), (2, x), (2, y), (3, y)]))
    assert left.columns == table([]).columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, x), (2, y)]
    rows = [(5, x), (5, x), (5, x + " end"), (None, x), (None, y), (None, y), (7, None), (7, None), (8, "")]
    got = [(r.doc_id, r.text) for r in near(table(rows)).collect()]
    assert sorted(got, key=str) in [
        sorted([first, (None, y), (7, None), (7, None), (8, "")], key=str) for first in ((5, x), (5, x + " end"))
    ]
    assert near(table([])).count() == 0


def test_the_threshold_is_guaranteed():
    """No pair within the distance lacks a key; few pairs at the similarity lie beyond the distance."""
    size, far = near_documents.SYMBOLS, near_documents.DISTANCE
    assert far <= 2 * near_documents.CHUNKS - 1 and size % near_documents.CHUNKS == 0

    def beyond(differ):
        return sum(math.comb(size, k) * differ**k * (1 - differ) ** (size - k) for k in range(far + 1, size + 1))

    assert beyond(0.15) < 1e-6 and beyond(0.2) < 3e-5


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    for common, own in ((80, 10), (85, 8)):
        pairs = []
        for _ in range(300):
            base = rng.integers(0, 2**63, common, np.int64).astype(np.uint64)
            pairs += [near_documents.signature(np.concatenate((base, rng.integers(0, 2**63, own, np.int64).astype(np.uint64)))) for _ in range(2)]
        rows = [(k, (s & 255).astype(np.uint8).tobytes(), (s >> 8).astype(np.uint8).tobytes()) for k, s in enumerate(pairs)]
        keys = near_documents.probes(spark.createDataFrame(rows, "node long, sketch binary, upper binary").coalesce(1))
        edges = groups.candidate_edges(keys, near_documents.near_signatures, "test")
        roots = {r.node: r.root for r in groups.components(edges, "test").collect()}
        assert all(roots.get(2 * k, -1) == roots.get(2 * k + 1, -2) == 2 * k for k in range(300))
