from __future__ import annotations

import pytest

from .brute import SMALL

CLASHING = ["n_words", "kept", "score", "batch", "__q", "__lines", "__id", "__version", "__gone", "__drop", "__own", "__t", "row", "own", "t"]
COLUMNS = "doc_id long, text string, lang string, " + ", ".join(f"{name} string" for name in CLASHING)


@pytest.fixture
def table(spark):
    """A table of (doc_id, text) with further columns, some named like those of results."""

    def build(rows):
        return spark.createDataFrame([(doc, text, "en", *"abcdefghijklmno") for doc, text in rows], COLUMNS)

    return build


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
