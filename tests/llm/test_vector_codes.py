import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from .brute import SMALL
from pawledger.llm import queries
from pawledger.llm.vector_codes import Codebooks, compressed, encoded, nearest, trained

COLUMNS = "vec_id long, embedding array<double>, label int, code string, error string, of string"


def coded(rows, parts=16, entries=64, rounds=2):
    """{row number: (code, error)}, label errors and the digest, entry by entry."""
    kept = {}
    for k, (vec, vector, _) in enumerate(rows):
        if vector and len(vector) % parts == 0 and all(x is not None and math.isfinite(x) for x in vector):
            kept[k] = vector
    named = sorted((rows[k][0], kept[k]) for k in kept if rows[k][0] is not None)
    if not named:
        return {}, {}, None
    size = len(named[0][1])
    wide = size // parts
    cut = lambda v: [[math.floor(256 * x) for x in v[p * wide : (p + 1) * wide]] for p in range(parts)]
    points = {k: cut(v) for k, v in kept.items() if len(v) == size}
    books = list(zip(*[cut(v) for _, v in named if len(v) == size][:entries]))
    books = [[list(e) for e in part] for part in books]

    def best(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for point in points.values():
                groups[best(point[p], book)[1]].append(point[p])
            for k, members in groups.items():
                book[k] = [sum(column) // len(members) for column in zip(*members)]
    codes, labels = {}, defaultdict(int)
    for k, point in points.items():
        found = [best(part, book) for part, book in zip(point, books)]
        codes[k] = "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)
        labels[rows[k][2]] += codes[k][1]
    flat = ",".join(str(x) for part in books for e in part for x in e)
    return codes, labels, hashlib.sha256(flat.encode()).hexdigest()


def agrees(found, rows, **how):
    codes, labels, digest = coded(rows, **how)
    want = sorted((rows[k][0] is None, rows[k][0] or 0, *codes[k], labels[rows[k][2]], digest) for k in codes)
    got = [(r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found]
    assert sorted(got) == want


def test_query_equals_brute_force(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in small("embeddings").collect()]
    agrees(queries.op13_vector_codes(spark, SMALL).collect(), rows)


def build(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], COLUMNS)


def odd(rng, n, scale=1.0):
    """Vectors of few values: many ties and equal entries; ids repeat, some are null."""
    return [(rng.choice([None, *range(40)]), [rng.choice([-1.5, 0.0, 0.25, 2.0]) * scale for _ in range(32)], rng.choice([None, 1, 2])) for _ in range(n)]


@pytest.mark.parametrize("scale", [1.0, 1e30])
def test_ties_nulls_and_large_numbers(spark, scale):
    rng = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = odd(rng, 150, scale)
    rows += [(-1, None, 1), (-2, [], 1), (-3, [None] * 32, 1), (-4, [nan] * 32, 2), (-5, [inf] + [0.0] * 31, 2)]
    rows += [(500, [1.0] * 16, 1), (501, [1.0] * 31, 1), rows[0], rows[0]]
    found = compressed(build(spark, rows)).collect()
    if scale == 1.0:
        agrees(found, rows)
    else:
        codes, _, digest = coded(rows)
        assert sorted(r.code for r in found) == sorted(code for code, _ in codes.values())
        assert {r.codebooks_sha256 for r in found} == {digest}
        assert all(r.error == 0 or r.error is None for r in found)


def test_no_usable_rows(spark):
    assert compressed(build(spark, [])).collect() == []
    assert compressed(build(spark, [(1, None, 1), (2, [None] * 16, None)])).collect() == []


def test_fewer_rows_than_entries_and_other_sizes(spark):
    rows = odd(random.Random(5), 7)
    agrees(compressed(build(spark, rows), parts=4, entries=5, rounds=3).collect(), rows, parts=4, entries=5, rounds=3)


def test_orchard_search_is_exact():
    rng = np.random.default_rng(1)
    for size, spread in ((1, 5), (7, 3), (64, 40), (256, 4)):
        entries, points = rng.integers(-spread, spread, (size, 4)), rng.integers(-2 * spread, 2 * spread, (3000, 4))
        apart = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        best, distance = nearest(points, entries)
        assert (best == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()


def test_codes_stand_for_vectors(spark):
    rows = [(k, [float(k % 4)] * 16, 1) for k in range(20)]
    table = build(spark, rows)
    books = trained(table, entries=4)
    for r in encoded(table, books).collect():
        assert r.error == 0 and books.decoded(r.code) == rows[r.vec_id][1]


def test_entries_fit_two_digits(spark):
    with pytest.raises(ValueError):
        compressed(build(spark, []), entries=257)
    assert Codebooks([[[1, -2]], [[3, 4]]], 4, False).sha256() == hashlib.sha256(b"1,-2,3,4").hexdigest()
