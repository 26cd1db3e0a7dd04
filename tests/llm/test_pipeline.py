"""The pipeline's stages against plain versions of each, and what must come through."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from palimpsest.llm import bpe, decontamination, ngram_join
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_ngram_join import brute as linked


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with junk, copies, near copies and leaks; benchmark and labels."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeiourstlmnd") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [(k, text(25)) for k in range(6)]
    docs = [text(rng.randrange(30, 120)) for _ in range(80)]
    docs += [" ".join(w.upper() + "!!" for w in t.split()) for t in docs[:40]]
    docs += docs[40:50] + [t.replace(t.split()[7], "swapped", 1) for t in docs[50:60]]
    docs += [f"{text(40)} {items[k % 6][1]} {text(40)}" for k in range(12)] + [None, "", "one"]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(docs)]
    labels = [(i, int(not 80 <= i < 120), 0) for i in range(len(docs)) if i % 2]
    out = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out, rows, items


def test_whole_run(spark, folder):
    out, rows, items = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "byte_bpe"]
    good = [r for r in rows if not 80 <= r[0] < 120]
    first = {c for _, _, c in linked([(r[0], r[1]) for r in good])}
    hit = {k for k, _, n, _, _ in contaminated([(r[0], r[1]) for r in good if r[0] in first], items, 10) if n}
    want = {r[0]: r[1] or "" for r in good if r[0] in first and r[0] not in hit}
    assert 60 < len(want) < len(good) and len(hit) == 12
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, out).collect()}
    assert got.keys() == want.keys()
    for key, text in want.items():
        assert bytes(got[key].decoded).decode() == text and np.frombuffer(got[key].ids, "<u4").tolist() == library.encode_ordinary(text)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns
        assert stage(spark, docs.limit(0), folder[0]).collect() == []


def test_rows_that_clash_repeat_or_lack_ids(spark):
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (None, "a b c d e f", "y", 2), (None, "q r s t u v", "z", 3), (None, None, "n", 4), (2, "", "m", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _row int")
    left = sorted(map(tuple, ngram_join.drop_near_copies(docs).collect()), key=repr)
    assert left == sorted([rows[0], *rows[3:]], key=repr)
    items = spark.createDataFrame([(1, "q r s")], "item_id long, text string")
    left = sorted(map(tuple, decontamination.drop_contaminated(docs, items, window=3).collect()), key=repr)
    assert left == sorted([r for r in rows if r[1] is None or "q r s" not in r[1]], key=repr)
