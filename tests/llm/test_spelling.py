"""Spelling variants against deletion neighbourhoods in plain Python, and against a double loop."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from palimpsest.llm import spelling
from palimpsest.llm.spelling import count_words, group_variants


def near(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    short, long = sorted((u, v), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def holes(word):
    """Two words are one edit apart only if they share one of these."""
    return {word} | {word[:k] + word[k + 1 :] for k in range(len(word))}


def brute(counts, ratio=10):
    by = defaultdict(set)
    for w in counts:
        for h in holes(w):
            by[h].add(w)
    nears = {w: {v for h in holes(w) for v in by[h] if near(w, v)} for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(nears[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(nears[w]), counts[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def words_of(docs, shortest=7, every=31):
    counts = Counter()
    for doc_id, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    return counts


@pytest.mark.parametrize("tile", [4, 512])
@pytest.mark.parametrize("letters", ["ab", "abÿ", "abcdefgh"])
def test_small_alphabets(spark, letters, tile, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = np.random.default_rng(len(letters))
    words = {"".join(rng.choice(list(letters), int(rng.integers(1, 12)))) for _ in range(400)}
    counts = {w: int(10 ** rng.uniform(0.4, 6)) for w in words}
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, form int")
    assert got(group_variants(df)) == brute(counts)


def test_long_words_chains_and_ties(spark):
    long = "ab" * 700
    counts = {long: 2000, long[:-1]: 20, long + "x": 5, long[:700] + "q" + long[701:]: 2, "a" * 500: 7, "a" * 501: 7, "a" * 502: 70}
    counts |= {"chain" + "x" * k: 2 * 10**k for k in range(8)}
    counts |= {"tiedword": 2, "tiedwordb": 30, "tiedworda": 30, "b" * 9: 3}
    df = spark.createDataFrame(list(counts.items()) + [(None, 4), ("", 5), ("nocount", None)], "word string, n long")
    found = got(group_variants(df))
    assert found == brute(counts)
    assert found["chain"][1] == "chain" + "x" * 7 and found["tiedword"][0] == "tiedworda"


def test_empty_table(spark):
    assert group_variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert count_words(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_counts(spark):
    docs = [(1, "Überlänge ÜBERLÄNGE überlänge Straßenbahn × d÷efghijk"), (2, None), (3, ""), (None, "nothingness"), (4, "x" * 100000), (5, "seven77sevenup Sevenup")]
    docs += [(k, "abcdefgh ABCDEFGH abcdefghi sevenletters") for k in range(10, 200)]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, n int")
    want = words_of([("" if i is None else i, t) for i, t in docs])
    assert {r.word: r.n for r in count_words(df).collect()} == want and len(want) > 15


def test_query(spark):
    from palimpsest.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute({w: n for w, n in words_of(docs).items() if n >= 2})
    assert got(REGISTRY.queries["op11_spelling"](spark, folder)) == want
    assert sum(v[0] is not None for v in want.values()) > 100 and len(want) > 5000
