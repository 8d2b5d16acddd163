import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import brute
from .brute import SMALL, prose
from pawledger.llm import groups, near_lines, queries
from pawledger.llm.near_lines import char_codes, deduplicated, lines, shingles, without_repeated_lines


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in small("documents").select("doc_id", "text").orderBy("doc_id").collect()]
    found = {r.doc_id: r for r in queries.op10_near_lines(spark, SMALL).collect()}
    for (doc, text), left in zip(rows, brute.deduplicated(rows)):
        got = found[doc]
        assert got.text_sha256 == brute.sha(left), doc
        assert got.n_lines == text.count("\n") + 1 and got.n_lines - got.n_removed == (left.count("\n") + 1 if left else 0)


def odd():
    line = prose(12, 1)
    return [
        (1, None), (2, ""), (3, line + "\n\n" + line.upper() + "  \n" + "short"), (4, "  " + line + " more\nshort\nSHORT"), (5, "short"),
        (6, "\n\n"), (7, prose(30_000, 4)), (8, prose(30_000, 4) + " x\nother"), (9, "É\né\nÉ"), (10, "a b c d e f\na b c d e g\nabc\tdef"), (11, "abc  def"),
    ]


def test_odd_rows(table):
    rows = odd()
    found = {r.doc_id: r.text for r in deduplicated(table(rows)).collect()}
    assert [found[doc] for doc, _ in rows] == brute.deduplicated(rows)
    left = without_repeated_lines(table(rows))
    assert left.columns == table(rows).columns
    emptied = {doc for (doc, text), after in zip(rows, brute.deduplicated(rows)) if text and after != text and not after.strip()}
    assert emptied == {4, 5, 11}
    assert {r.doc_id for r in left.collect()} == {doc for doc, _ in rows} - emptied


def test_rows_without_id_and_repeated_rows(table):
    rows = [(None, "same line here\nsame line here"), (1, "same line here"), (1, "same line here"), (1, "new\nsame line here")]
    found = sorted(((r.doc_id, r.text) for r in deduplicated(table(rows)).collect()), key=str)
    kept = [text for doc, text in found if doc == 1]
    assert (None, "same line here\nsame line here") in found
    assert sorted(kept) in (["", "", "new\nsame line here"], ["new", "same line here", "same line here"])
    assert deduplicated(table([])).count() == 0


def test_lines_and_shingles():
    texts = ["A  b\n c \n\n", None, "", "xyz", "é　ü  \t q", "\n", "0123456789AB\n0123456789"]
    chars, starts, row, number = lines(pa.array(texts, pa.string()))
    got = [(int(r), int(k), "".join(map(chr, chars[a:b]))) for r, k, a, b in zip(row, number, starts[:-1], starts[1:])]
    assert got == [(r, k, brute.normal(line)) for r, text in enumerate(texts) if text is not None for k, line in enumerate(text.split("\n"))]
    values, bounds = shingles(char_codes(chars), starts)
    sets = [brute.line_set(line) if line else set() for _, _, line in got]
    assert np.diff(bounds).tolist() == [len(s) for s in sets]
    for width in (1, 2, 3, 5, 7, 8, 10, 13):
        text = pa.array(["abcabcabcabcabcabcd", "bcabcabcabca"])
        chars, starts, _, _ = lines(text)
        values, bounds = shingles(char_codes(chars), starts, width)
        parts = [[s[i : i + width] for i in range(max(len(s) - width, 0) + 1)] for s in text.to_pylist()]
        names = {}
        for part, value in zip(sum(parts, []), values.tolist()):
            assert names.setdefault(part, value) == value
        assert len(set(names.values())) == len(names)


def test_bad_bytes():
    data = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 3], np.int32)), pa.py_buffer(b"a\xffb")])
    chars, starts, _, _ = lines(data)
    assert len(chars) == 3 and starts.tolist() == [0, 3]
    assert near_lines.min_hashes(*shingles(char_codes(chars), starts)).shape == (1, near_lines.HASHES)


def test_clashing_names_stay(spark):
    """Columns named like those of intermediate steps keep their values."""
    names = ["__id", "__version", "__gone", "__drop", "version", "row", "gone", "lines", "removed", "node", "key"]
    line = "the quick brown fox jumps over the lazy dog and runs away from here at once"
    rows = [(k, f"{line}\nonly {k} here", *[f"{n}{k}" for n in names]) for k in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = {r.doc_id: r for r in near_lines.without_repeated_lines(table).collect()}
    assert [found[k].text.count("\n") for k in range(4)] == [1, 0, 0, 0]
    for k in range(4):
        assert [found[k][n] for n in names] == [f"{n}{k}" for n in names]


def test_chains_of_lines_cost_in_proportion(spark):
    """A long chain of lines, each near the next one only: all are linked, and the pairs compared and
    the lines read again grow with the lines, not with their square."""
    rng = random.Random(2)
    compared = {}
    for n in (500, 2000):
        words = [f"{rng.randrange(10**6):06d}" for _ in range(n + 40)]
        rows = [(k, " ".join(words[k : k + 40])) for k in range(n)]
        table = spark.createDataFrame(rows, "doc_id long, text string")
        lines = near_lines.line_table(table, 5)
        classes = lines.withColumn("node", F.monotonically_increasing_id())
        links = lambda rows: near_lines.near_sketches(rows.column("sketch"))
        compared[n] = groups.partnered(near_lines.probes(classes), links).count()
        kept = near_lines.line_verdicts(table, 80, 5).where("first").count()
        assert kept < n / 20
    assert compared[2000] < 6 * compared[500] < 6 * 10 * 500


def test_recall_at_the_threshold():
    """Of pairs at a similarity of 0.8, few share no key or have far sketches."""
    rng = np.random.default_rng(5)
    pairs = 4000
    shared = rng.integers(0, 2**63, (pairs, 80), np.int64).astype(np.uint64)
    own = rng.integers(0, 2**63, (pairs, 20), np.int64).astype(np.uint64)
    one, two = np.concatenate((shared, own[:, :10]), axis=1), np.concatenate((shared, own[:, 10:]), axis=1)
    bounds = np.arange(pairs + 1) * 90
    low = [near_lines.min_hashes(side.ravel(), bounds) for side in (one, two)]
    keys = [near_lines.band_keys(x) for x in low]
    sketches = [near_lines.sketch(x) for x in low]
    differ = sketches[0] ^ sketches[1]
    differ = (differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)
    met = (keys[0] == keys[1]).any(axis=1) & (np.bitwise_count(differ) <= near_lines.DISTANCE)
    assert pairs - int(met.sum()) <= pairs // 200


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(8)
    for _ in range(50):
        base = rng.integers(0, 2**63, 120, np.int64).astype(np.uint64)
        one, two = np.unique(base[rng.random(120) < 0.7]), np.unique(base[rng.random(120) < 0.7])
        both = near_lines.parities(np.concatenate((one, two)), np.array([0, len(one), len(one), len(one) + len(two)]))
        assert not both[1].any()
        assert 0 < np.bitwise_count(both[0] ^ both[2]).sum() <= len(np.setxor1d(one, two))


def test_lines_that_meet_under_many_keys_are_compared_once(spark):
    """Near lines share several bands; the pair is one set with one key, whatever they share."""
    rows = []
    for k in range(20):
        line = prose(60, 100 + k)
        rows += [(2 * k, line), (2 * k + 1, line + " end")]
    lines = near_lines.line_table(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = lines.withColumn("node", F.col("doc_id"))
    links = lambda rows: near_lines.near_sketches(rows.column("sketch"))
    met = groups.partnered(near_lines.probes(classes), links)
    found = {tuple(sorted(r.nodes)) for r in met.groupBy("key").agg(F.collect_set("node").alias("nodes")).collect()}
    assert found == {(2 * k, 2 * k + 1) for k in range(20)}
    assert met.distinct().count() == 40 < met.count()


def test_sets_of_links():
    nodes = np.array([7, 5, 9, 5, 7, 1], np.int64)
    one = groups.linked_sets(nodes, [(0, 1), (2, 5)]).to_pydict()
    two = groups.linked_sets(nodes, [(3, 4)]).to_pydict()
    assert sorted(one["node"]) == [1, 5, 7, 9] and sorted(two["node"]) == [5, 7]
    keys = dict(zip(one["node"], one["key"]))
    assert keys[5] == keys[7] != keys[1] == keys[9] and set(two["key"]) == {keys[5]}
    assert groups.linked_sets(nodes, []).num_rows == 0


def test_lines_of_random_texts():
    rng = random.Random(3)
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices("aB \n\t\r\v\fé日Z\x1f", k=rng.randrange(25))) for _ in range(rng.randrange(6))]
        chars, starts, row, number = lines(pa.array(texts, pa.string()))
        got = [(int(r), int(k), "".join(map(chr, chars[a:b]))) for r, k, a, b in zip(row, number, starts[:-1], starts[1:])]
        assert got == [(r, k, brute.normal(line)) for r, text in enumerate(texts) if text is not None for k, line in enumerate(text.split("\n"))]
