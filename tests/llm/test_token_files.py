"""Token files: blocks against the ids that went in, files against the tokenizer itself."""

import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wellspring.llm import queries, token_files

ODD = [None, "", " ", "\n\n  \t", "a", "don't  stop  ", "Ünïcode ẞß ŉ ſ", "漢字かな交じり 😀👩‍👩‍👧", "x\x00y\x1cz\x85w\xa0v", "<|endoftext|> in text", "1234 ²³ ½", "'s 'S ''t", "z" * 70_000, "wörd " * 9_000, "  　 a", "\n" * 300]


def whole_ids(text, end=2):
    tok = Tokenizer.from_file(queries.byte_tokenizer_path())
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 90), st.integers(0, 2**32 - 1)), max_size=700), st.integers(0, 800), st.integers(0, 800))
def test_blocks_give_back_their_ids(ids, first, count):
    ids = np.array(ids, dtype=np.uint32)
    (s,) = token_files.read_segments(token_files.write_segment(3, 4, 5, [7, None], [len(ids), 0], ids) + b"\n")
    assert (s.part, s.number, s.place, s.doc_ids, s.lengths.tolist()) == (3, 4, 5, [7, None], [len(ids), 0])
    assert np.array_equal(s.tokens(), ids)
    assert np.array_equal(s.tokens(first, count), ids[first : first + count])


def test_outliers_are_listed_and_do_not_widen_a_block():
    ids = np.arange(128, dtype=np.uint32) % 4 + 100
    ids[[5, 90]] = 50_000
    least, width, exceptions, start, body = token_files.pack_blocks(ids)
    assert (least[0], width[0], exceptions[0], len(body)) == (100, 2, 2, 128 * 2 // 8 + 2 * 5)


def test_damage_is_an_error():
    made = bytearray(token_files.write_segment(0, 0, 0, [1], [3], np.arange(3, dtype=np.uint32)))
    made[-9] ^= 1
    with pytest.raises(ValueError):
        list(token_files.read_segments(bytes(made)))


def test_query_equals_tokenizer(spark, sf):
    got = queries.op13_token_files(spark, sf).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    start = 0
    for r, text in zip(got.itertuples(), docs.text, strict=True):
        ids = whole_ids(text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_odd_documents_over_many_segments_and_files(spark, tmp_path):
    rows = [(i // 2 if i % 5 else None, t, "x") for i, t in enumerate(ODD + ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    path = f"file://{tmp_path}/tokens"
    token_files.write_files(docs, queries.byte_tokenizer_path(), path, segment_tokens=500, segments_per_file=2)
    got = token_files.read_documents(spark, path).toPandas().sort_values("start")
    ids = got.doc_id.map(lambda v: -1 if pd.isna(v) else v).tolist()
    assert ids == sorted(ids)
    want = sorted((-1 if i is None else i, len(x := whole_ids(t)), zlib.crc32(x.tobytes())) for i, t, _ in rows)
    assert sorted(zip(ids, got.n_tokens, got.ids_crc32)) == want
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    segments = token_files.read_tokens(spark, path).orderBy("part", "place").collect()
    assert len(segments) > 3
    stream = np.array([x for s in segments for x in s.ids], dtype="<u4")
    for r in got.itertuples():
        assert zlib.crc32(stream[r.start : r.start + r.n_tokens].tobytes()) == r.ids_crc32


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.written_and_read(docs, queries.byte_tokenizer_path()).count() == 0
