import zlib

import numpy as np

from .brute import SMALL, prose
from pawledger.llm import quality_model, queries
from pawledger.llm.quality_model import Neighbours, fitted, scored

LABELS = "doc_id long, quality int, toxic int"


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    good = labels == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op6_quality_model(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert len(found) == docs
    for doc, r in found.items():
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(found[r.doc_id].score, r.quality) for r in labels if found[r.doc_id].held_out]
    scores, truth = map(np.array, zip(*held))
    assert auc(scores, truth) > 0.95
    assert ((scores >= 0.3) == truth).mean() > 0.9


def test_odd_rows(spark, table):
    rows = [(1, None), (2, ""), (3, "a"), (4, prose(30_000)), (None, prose(60)), (5, prose(60)), (5, prose(60)), *[(k, prose(80, k)) for k in range(6, 30)], *[(k, "!! ## $$ " * 30) for k in range(30, 50)]]
    labels = spark.createDataFrame([(k, int(k < 30), 0) for k in range(6, 50)] + [(3, None, 0), (None, 1, 0), (6, 1, 1)], LABELS)
    found = scored(table(rows), labels).collect()
    assert sorted(map(str, [r.doc_id for r in found])) == sorted(str(doc) for doc, _ in rows)
    assert all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[5].predicted == 1 and by_id[35].predicted == 0 and by_id[None].held_out is False
    assert scored(table([]), labels).count() == 0
    assert {r.score for r in scored(table(rows[:3]), labels.limit(0)).collect()} == {0.5}


def test_held_out_rows_teach_nothing(spark, table):
    rows = [(k, prose(80, k)) for k in range(40)]
    labels = [(k, k % 2, 0) for k in range(40)]
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q, t) for k, q, t in labels]
    a, b = (sorted((r.doc_id, r.score) for r in scored(table(rows), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert a == b


def test_votes_equal_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = pa.array([prose(int(n), int(n)) for n in rng.integers(1, 90, 40)])
    space = rng.normal(size=(quality_model.BINS + quality_model.SHARES, 8)).astype(np.float32)
    points = rng.normal(size=(60, 8)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    model = Neighbours(np.ones(quality_model.BINS, np.float32), space, points, rng.integers(0, 2, 60).astype(float), 0.5)
    got = model.scores(texts, block=7)
    for row, score in zip(model.latent(texts), got):
        near = sorted(((float(row @ p), y) for p, y in zip(points, model.labels)), reverse=True)[: quality_model.NEIGHBOURS]
        weights = [max(c, 0) ** quality_model.SHARPNESS for c, _ in near]
        assert abs(score - sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)) < 1e-4


def test_bounded_fit(spark, small):
    model = fitted(small("documents"), small("labels"), most=20)
    assert 0 < len(model.labels) <= 40 and model.points.shape[1] == quality_model.LATENT


def test_query_equals_brute_force(spark, small):
    """Every score of the query, from its model's vectors and all labelled ones, pair by pair."""
    import pyarrow as pa

    model = fitted(small("documents"), small("labels"))
    found = {r.doc_id: r.score for r in queries.op6_quality_model(spark, SMALL).collect()}
    rows = small("documents").select("doc_id", "text").collect()
    checked = 0
    for r, point in zip(rows, model.latent(pa.array([r.text for r in rows], pa.string()))):
        near = sorted(((float(point @ p), y) for p, y in zip(model.points, model.labels)), reverse=True)
        k = quality_model.NEIGHBOURS
        if len(near) > k and near[k - 1][0] - near[k][0] < 1e-5:
            continue  # a tie at the last neighbour
        weights = [max(c, 0) ** quality_model.SHARPNESS for c, _ in near[:k]]
        assert abs(found[r.doc_id] - sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)) < 1e-3, r.doc_id
        checked += 1
    assert checked > len(rows) / 2
