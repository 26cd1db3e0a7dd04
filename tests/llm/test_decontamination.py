"""FM-index search against plain comparison of words."""

import hashlib
import random
import re

import numpy as np
import pytest

from palimpsest.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window):
    """(id, n_words, n_hit, items, spans in code points) by looking at every place."""
    phrases = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - window + 1)) if words else ():
            phrases.setdefault(tuple(words[i : i + window]), set()).add(item)
    out = []
    for key, text in docs:
        matches = list(WORD.finditer(lower(text)))
        words, hit, found = [m.group() for m in matches], set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(words) - size + 1):
                if of := phrases.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= of
        spans = []
        for i in sorted(hit):
            if spans and spans[-1][2] == i:
                spans[-1] = (spans[-1][0], matches[i].end(), i + 1)
            else:
                spans.append((matches[i].start(), matches[i].end(), i + 1))
        out.append((key, len(words), len(hit), sorted(x for x in found if x is not None), [s[:2] for s in spans]))
    return out


def rows(df):
    return [(r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in df.collect()]


def order(found):
    return sorted(found, key=repr)


DOCS = [
    (1, "The quick brown Fox, jumps over the lazy dog; and again the QUICK brown fox."),
    (2, None),
    (3, ""),
    (4, "été über naïve 日本語 the quick brown"),
    (4, "été über naïve 日本語 the quick brown"),
    (None, "brown fox jumps"),
    (6, "a " * 3000 + "quick brown fox " + "a " * 500),
    (7, "...!!! ---"),
    (8, "quick"),
]
ITEMS = [(10, "quick brown fox jumps over"), (11, "naïve-日本語"), (12, None), (12, "!!"), (None, "lazy dog and"), (9, "a a a a"), (10, "quick brown fox jumps over"), (100, "dog and again")]


@pytest.mark.parametrize("window,shard,block", [(3, 1 << 20, 1000), (3, 5, 2), (10, 4, 1), (1, 100, 1000)])
def test_small_cases(spark, window, shard, block):
    docs = spark.createDataFrame([(a, b, "x") for a, b in DOCS], "doc_id long, text string, n_words string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.find_contamination(docs, items, window=window, shard_words=shard, block_phrases=block)
    assert order(rows(got)) == order(brute(DOCS, ITEMS, window))


def test_random_words(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("ab cd e fg h".split()) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(200)]
    items = [(i, text(rng.randrange(9))) for i in range(25)]
    got = D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5)
    assert order(rows(got)) == order(brute(docs, items, 5))


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert D.find_contamination(none, spark.createDataFrame(ITEMS, items.schema)).collect() == []
    assert rows(D.find_contamination(docs, items)) == [(1, 2, 0, [], [])]


def test_index_parts():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (40, 1, 7, 40)])
    index = D.FmIndex(text, 4)
    every = np.arange(text.size)
    assert sorted(index.locate(every[index.counts[1] :]).tolist()) == np.flatnonzero(text).tolist()
    for length in (1, 2, 3):
        phrase = rng.integers(1, 4, (1, length))
        low, high = index.search(phrase, np.array([length]))
        want = [i for i in range(text.size - length) if (text[i : i + length] == phrase[0]).all()]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_query(spark):
    from palimpsest.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.001"
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*(("doc_id", "text") if name == "documents" else ("item_id", "text"))).collect()]
    want = {}
    for key, words, hit, items, _ in brute(read("documents"), read("benchmark"), 10):
        names = ",".join(sorted(map(str, items)))
        want[key] = (words, hit, len(items), hashlib.sha256(names.encode()).hexdigest(), hit > 0)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in REGISTRY.queries["op2_decontamination"](spark, folder).collect()}
    assert got == want and any(v[4] for v in got.values())


def test_known_words_without_a_phrase(spark):
    docs, items = [(1, "c b a c b a"), (2, "a")], [(1, "a b c"), (2, "b a b")]
    got = D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=3)
    assert order(rows(got)) == order(brute(docs, items, 3)) and all(r[2] == 0 for r in rows(got))


def test_words_are_held_as_numbers():
    text = ("known other known " * 1000).encode()
    ids = D.numbered(text, {b"known": 1})
    assert ids.tolist() == [1, 0, 1] * 1000 and ids.nbytes == 4 * 3000
    block = D.Phrases()
    block.add(7, [b"known", b"known"], 10)
    spans, items = D.find([D.numbered(b"", {b"known": 1}), ids], block.packed())
    assert len(spans[0]) == 0 and items == [set(), {7}] and spans[1].tolist() == [[i, i + 2] for i in range(2, 2997, 3)]
