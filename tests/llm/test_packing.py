import itertools

import numpy as np
import pytest

from .brute import SMALL, prose
from pawledger.llm import queries
from pawledger.llm.packing import bucket_bounds, packed, token_counts
from pawledger.llm.tokens import Encoder, default_path


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= size) - size) for size, n in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(1, 40), rng.integers(1, 8), replace=False))
        counts = rng.integers(1, 20, len(lengths))
        for buckets in (1, 2, 3, 10):
            bounds = bucket_bounds(lengths, counts, buckets)
            best = min(
                padding(lengths, counts, [*some, lengths[-1]])
                for k in range(min(buckets, len(lengths)))
                for some in itertools.combinations(lengths[:-1].tolist(), k)
            )
            assert len(bounds) <= buckets and bounds[-1] == lengths[-1] and bounds == sorted(bounds)
            assert padding(lengths, counts, bounds) == best
    assert bucket_bounds(np.array([]), np.array([]), 3) == []


def expected(lengths, longest, buckets, budget):
    pieces = []
    for doc, total in lengths:
        for piece in range(-(-total // longest) if total and total > 0 else 0):
            pieces.append((doc, piece, piece * longest, min(total - piece * longest, longest)))
    if not pieces:
        return []
    sizes, counts = np.unique([p[3] for p in pieces], return_counts=True)
    bounds, seen, out = bucket_bounds(sizes, counts, buckets), {}, []
    for piece in sorted(pieces, key=lambda p: (p[0] is not None, p[0] or 0, p[1], p[3])):
        bucket = next(k for k, b in enumerate(bounds) if b >= piece[3])
        number, size = seen.get(bucket, 0), max(budget // bounds[bucket], 1)
        seen[bucket] = number + 1
        out.append((*piece, bucket, bounds[bucket], number // size, number % size))
    return out


@pytest.mark.parametrize("longest, buckets, budget", [(2048, 16, 65536), (30, 3, 100), (7, 1, 5)])
def test_packing_equals_brute_force(spark, longest, buckets, budget):
    rng = np.random.default_rng(6)
    lengths = [(k, int(n)) for k, n in enumerate(rng.integers(0, 100, 300))] + [(None, 5), (3, 40), (3, 40), (1000, None), (1001, -2), (1002, 5000)]
    df = spark.createDataFrame([(d, n, "x", 1) for d, n in lengths], "doc_id long, n_tokens long, batch string, piece int")
    got = packed(df, longest, buckets, budget).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(lengths, longest, buckets, budget), key=str)


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_query_packs_every_token(spark, small):
    code = Encoder(default_path())
    lengths = [(r.doc_id, len(code.encode(r.text or "")) // 4 + 1) for r in small("documents").collect()]
    got = sorted(map(tuple, queries.op2_packing(spark, SMALL).collect()))
    assert got == sorted(expected(lengths, 2048, 16, 65536))


def test_null_and_empty_texts(table):
    found = token_counts(table([(1, None), (2, ""), (None, "a"), (3, prose(50_000))])).collect()
    assert [(r.doc_id, r.n_tokens) for r in found][:3] == [(1, 1), (2, 1), (None, 2)]
