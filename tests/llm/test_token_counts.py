"""Cached token counts against the library on whole texts."""

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from palimpsest.llm import token_counts
from palimpsest.llm.token_counts import Tokenizer, count_tokens

MODEL = Tokenizer(P.path("piece_bpe_32k.model"))
LIBRARY = SentencePieceProcessor(model_file=MODEL.path)

TEXTS = [None, "", " ", "  ", "   ", "a", " a", "a ", "a  ", "  a  b ", "a▁b", "▁", "▁▁ a", "tab\tand\n line \n", "<s> </s> <unk> <0x41>", "　 x", "日本 語", "é é", "long " * 5000, "q" * 20000, "a", "\x00 b"]


def want(text):
    return len(LIBRARY.encode(text or ""))


def test_counts_and_cache(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(i or None, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    first = count_tokens(docs, MODEL, cache).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in first) == [(i, len((t or "").encode()), want(t)) for i, t in enumerate(TEXTS)]
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in TEXTS})
    more = spark.createDataFrame([(1, "a"), (2, "new text")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in count_tokens(more, MODEL, cache).collect()) == sorted([want("a"), want("new text")])
    assert spark.read.parquet(cache).count() == stored + 1


def test_hits_come_from_the_cache(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    spark.sql(f"select '{MODEL.version}' tokenizer, unhex(sha2('hello', 256)) content, 77L n_tokens").write.partitionBy("tokenizer").parquet(cache)
    spark.sql("select 'other' tokenizer, unhex(sha2('bye', 256)) content, 55L n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)
    docs = spark.createDataFrame([(1, "hello"), (2, "bye")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, MODEL, cache).collect()} == {1: 77, 2: want("bye")}


def test_empty_table_and_json_tokenizer(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert count_tokens(none, MODEL, f"file://{tmp_path}/c").collect() == []
    from tokenizers import Tokenizer as Library

    file = P.path("word_bpe_49k.json")
    docs = spark.createDataFrame([("k", "Hello <|endoftext|> there")], "doc_id string, text string")
    got = count_tokens(docs, Tokenizer(file), f"file://{tmp_path}/c").collect()
    assert got[0].n_tokens == len(Library.from_file(file).encode("Hello <|endoftext|> there", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" ▁\n\tab,éß日😀<s>"), max_size=40))
def test_by_word_is_exact(text):
    assert COUNT([text]) == [want(text)]


COUNT = MODEL.counter()


def test_word_path_is_taken():
    assert COUNT.__qualname__.startswith("_by_word")
    assert token_counts._words_are_apart(LIBRARY)


def test_query(spark):
    from palimpsest.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in REGISTRY.queries["op1_token_counts"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert got == {r.doc_id: (len((r.text or "").encode()), want(r.text), want(r.text) > 4096) for r in docs}
