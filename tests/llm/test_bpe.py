"""Chunked byte-level BPE against the library on whole texts."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from palimpsest.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")

TEXTS = [
    None,
    "",
    " ",
    "one",
    "The quick  brown\n\n fox's 'll they're   \t jumps over 12345 dogs!!! ",
    "a" * 3000,
    " " * 500 + "x" + " \n" * 300 + "y",
    "word " * 900,
    "für êtes 日本語 текст 😀 " * 60,
    "!" * 400 + "a" * 400 + "1" * 400,
    ("line one\n  line two   \n\n\tend " * 40) + "z" * 300 + " tail",
    "word " * 900,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 9), (64, 16), (50, 49), (7, 3)])
def test_ids_and_round_trip(spark, library, chunk, overlap):
    rows = [(i if i else None, t, f"x{i}") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, chunk=chunk, overlap=overlap), RANKS).collect()
    want = sorted((i or -1, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    have = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got)
    assert have == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_empty_table_and_text_ids(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect() == []
    docs = spark.createDataFrame([("k", "abc")], "doc_id string, text string")
    assert bpe.encode(docs, RANKS, P.PATTERN).columns == ["doc_id", "n_tokens", "ids"]


def test_query_over_whole_table(spark, library):
    from palimpsest.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in REGISTRY.queries["op3_byte_bpe"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = np.array(library.encode_ordinary(row.text or ""), "<u4")
        assert got.pop(row.doc_id) == (ids.size, hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
    assert not got
