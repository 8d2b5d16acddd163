import corpus_pipeline
from .brute import SMALL, prose
from types import SimpleNamespace

from pawledger.llm.store import shared_dir, stored


def test_stages_keep_columns_and_clean_documents(spark, table, tmp_path):
    clean = [(k, f"{prose(120, k)}.\n{prose(60, 100 + k)}.") for k in range(12)]
    passage = prose(30, 500)
    rows = [*clean, (50, clean[0][1]), (51, "### $$$ *** " * 60), (52, prose(100, 70) + ".\n" + passage + "."), (53, None), (54, prose(100, 1))]
    spark.createDataFrame([("q", passage)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = table(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, str(tmp_path)), "test-stage")
        seen[name] = sorted({r.doc_id for r in docs.collect()})
        if name != "packing":
            assert docs.columns == before.columns
    kept = {k for k, _ in clean}
    assert 51 not in seen["quality_rules"] and 53 not in seen["quality_rules"]
    assert 50 in seen["quality_rules"] and 50 not in seen["line_dedup"]
    assert 52 in seen["near_dedup"] and 52 not in seen["decontamination"]
    assert kept <= set(seen["packing"])


def test_lines_with_one_changed_character_are_one(spark, table):
    import random

    rng, rows = random.Random(6), []
    for size in range(49, 101):
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz      ", k=size - 2)).replace("  ", " x")
        line = "y" + line.replace("  ", " z") + "y"
        at = rng.randrange(6, size - 6)
        rows += [(2 * size, line), (2 * size + 1, f"{line[:at]}7{line[at + 1 :]}\nown line number {size * 7919} {line[::-1]}")]
    found = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, table(rows), "").collect()}
    missed = [size for size in range(49, 101) if "\n" in found[2 * size + 1] or found[2 * size] != dict(rows)[2 * size]]
    assert not missed


def test_run(spark, small):
    found = corpus_pipeline.run(spark, SMALL)
    ids = {r.doc_id for r in small("documents").collect()}
    got = [r.doc_id for r in found.collect()]
    assert got and set(got) <= ids
    assert found.columns == ["doc_id", "piece", "start", "n_tokens", "bucket", "bucket_length", "batch", "slot"]


def test_the_named_folder_is_used():
    def session(named, current, app):
        context = SimpleNamespace(getCheckpointDir=lambda: current, applicationId=app)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)

    assert shared_dir(session("hdfs://a/b/", None, "x")) == "hdfs://a/b"
    assert shared_dir(session(None, "/c", "x")) == "/c"
    own = shared_dir(session(None, None, "x"))
    assert own == shared_dir(session(None, None, "x")) != shared_dir(session(None, None, "y"))


def test_columns_of_any_name_keep_their_values(table, spark, tmp_path):
    spark.createDataFrame([("q", prose(30, 500))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(k, f"{prose(120, k)}.\n{prose(60, 100 + k)}.") for k in range(5)]
    docs = table([*rows, rows[0]])
    want = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stored(stage(spark, docs, str(tmp_path)), "test-stage")
        assert {tuple(r) for r in docs.collect()} == want, name


def test_empty_table(table, spark, tmp_path):
    spark.createDataFrame([("q", prose(30, 500))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table([])
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), "test-stage")
        assert docs.count() == 0, name
