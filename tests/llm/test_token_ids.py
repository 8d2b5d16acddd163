import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from .brute import SMALL, prose
from pawledger.llm import queries, token_ids
from pawledger.llm.token_ids import pack, read_ids, unpack, write_ids
from pawledger.llm.tokens import Encoder, default_path

ENCODER = Encoder(default_path())


def ids_of(text):
    return [*ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def digests(rows):
    out, at = [], 0
    for doc, text in rows:
        ids = ids_of(text)
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_the_library(spark, small):
    rows = [tuple(r) for r in small("documents").select("doc_id", "text").orderBy("doc_id").collect()]
    found = queries.op1_token_ids(spark, SMALL).collect()
    assert sorted(tuple(r) for r in found) == digests(rows)


def test_odd_rows_and_many_files(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(token_ids, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(token_ids, "FILE_TOKENS", 400)
    rows = [(None, "no id"), (1, None), (2, ""), (3, prose(300)), (4, "<|endoftext|> x"), (5, "é　 a  b\n\n c"), (6, "same"), (6, "same"), *[(k, prose(20, k)) for k in range(7, 60)]]
    folder = str(tmp_path / "ids")
    write_ids(table(rows[::-1]), folder)
    found = sorted(read_ids(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, r.ids) for r in found] == [(doc, len(ids_of(text)), ids_of(text)) for doc, text in rows]
    assert [r.start for r in found] == [d[1] for d in digests(rows)]
    assert spark.read.parquet(f"{folder}/blocks").select("part").distinct().count() > 2
    ranks = np.frombuffer(bytes(spark.read.parquet(f"{folder}/ranks").first()[0]), "<u4")
    assert sorted(ranks.tolist()) == list(range(len(ranks)))
    counts = np.bincount(np.concatenate([ids_of(text) for _, text in rows]), minlength=len(ranks))[ranks]
    assert (np.diff(counts) <= 0).all()


def test_empty_table(spark, table, tmp_path):
    write_ids(table([]), str(tmp_path / "ids"))
    assert read_ids(spark, str(tmp_path / "ids")).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_coding_round_trip(numbers):
    numbers = np.array(numbers, np.uint32)
    control, data = pack(numbers)
    assert len(control) == -(-len(numbers) // 4)
    assert np.array_equal(unpack(control, data, len(numbers)), numbers)


@pytest.mark.parametrize(
    "text",
    ["", "  ", "a", "a  b", "\n\n", "x \n y", "it's we're 'shell 'll 123abc a1 .a a.b !a'b", "é è", "日本 語", "a　 b", "a\x1c b", "a \x1cb",
     "tab\tx\r\ny", "  lead", "trail  ", "x\u0085 y", "a_b-c  --- d'", "'s 's", "\x0b\x0c a", "A.B 'RE", "a\n b", "a\nb\n\nc  d\n", "été, là.",
     "été n", "12٣4 a", "a…b", "ſt ĸ", "x‍y"],
)
def test_encoder_equals_the_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)[:-1]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Zé'.,!19\n\t 　́日\x1c…s-_") | st.characters(codec="utf-8")))
def test_encoder_equals_the_library_on_any_text(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)[:-1]
