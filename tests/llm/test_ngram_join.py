"""The partitioned join against all pairs of small sets."""

import random

import numpy as np
import pytest

from palimpsest.llm import ngram_join as J


def sets_of(docs, n):
    out = []
    for _, text in docs:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        words = [w for w in words if w]
        out.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    return out


def brute(docs, n=5, least=80):
    sets = sets_of(docs, n)
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= least * len(a | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, (key, _) in enumerate(docs):
        groups.setdefault(top(i), []).append(key)
    smallest = {r: min((k for k in keys if k is not None), default=None) for r, keys in groups.items()}
    return sorted(((key, len(s), smallest[top(i)]) for i, ((key, _), s) in enumerate(zip(docs, sets))), key=repr)


def check(spark, docs, **args):
    got = J.jaccard_components(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, node int"), **args)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, **args)


def family(rng, size, copies, edits, start):
    words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for k in range(copies):
        own = list(words)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        out.append((start + k, " ".join(own)))
    return out


def test_edge_cases(spark):
    docs = [
        (5, "One two\tthree FOUR five six seven"), (4, "one two three four five six seven"), (9, None), (8, ""), (7, " \n "),
        (3, "a b"), (2, "A  B"), (1, "a b c"), (None, "a b"), (None, "lonely text of six words here"), (6, "x y z x y z x y z x y z"), (6, "x y z x y z x y z x y z"),
        (11, "é\u00a0b c"), (12, "é b c"), (13, "one two three four five six"),
    ]
    check(spark, docs)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(none).collect() == []
    check(spark, [(1, None), (2, "")])


@pytest.mark.parametrize("seed", [1])
def test_families_at_every_size(spark, seed):
    rng = random.Random(seed)
    docs = []
    for size in (4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 26, 33, 45, 60, 90, 140, 220, 400):
        for edits in (1, max(1, size // 60), max(2, size // 25)):
            docs += family(rng, size, 7, edits, len(docs))
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(len(docs) + i, passage + " " + " ".join(f"o{i}x{k}" for k in range(20 + i))) for i in range(25)]
    rng.shuffle(docs)
    check(spark, docs)


def test_other_threshold(spark):
    rng = random.Random(5)
    docs = [d for size in (6, 15, 40, 100) for d in family(rng, size, 8, max(1, size // 12), size * 100)]
    check(spark, docs, n=2, least=60)


def test_large_group_of_near_copies_makes_no_pairs(spark):
    rng = random.Random(3)
    check(spark, family(rng, 150, 250, 3, 0))


def test_no_set_lacks_levels():
    schemes = J.Schemes(80)
    last = (None, 0)
    for n in range(1, 4000):
        scheme, taken = schemes.scheme(schemes.number(n)), schemes.taken(n)
        assert scheme.low <= n <= scheme.high and taken <= scheme.segments
        assert taken + min(taken, scheme.double) > schemes.bound(n)
        assert scheme.double <= scheme.segments
        assert last[0] != scheme.number or taken >= last[1]
        last = (scheme.number, taken)
        for s in range(-(-n * 80 // 100), n):
            shared = {x.number: t for x, t in schemes.plan(n)}
            if schemes.bound(schemes.scheme(schemes.number(s)).high):
                assert shared[schemes.number(s)] >= schemes.taken(s)
            if n > 300:
                break


def test_sets_that_lack_segments_send_their_empty_ones(spark, monkeypatch):
    """With far too few tokens a segment, nearly every set needs its empty segments."""
    monkeypatch.setattr(J, "RARE", 1.0)
    monkeypatch.setattr(J, "SMALL", 0)
    rng = random.Random(9)
    docs = []
    for size in (8, 12, 20, 35, 60):
        for _ in range(6):
            docs += family(rng, size, 4, 2, len(docs))
    check(spark, docs)


def test_shared_rows_in_any_batches():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    for _ in range(200):
        rows = sorted({(int(k), int(n) % 2, int(n)) for k, n in rng.integers(0, 5, (rng.integers(1, 40), 2))})
        table = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[1] for r in rows])], names=["key", "node", "place"])
        cuts = sorted({0, len(rows), *rng.integers(0, len(rows) + 1, 4).tolist()})
        got = [r for b in J._shared(table.slice(a, z - a) for a, z in zip(cuts, cuts[1:])) for r in b.to_pylist()]
        want = []
        for key in {r[0] for r in rows}:
            run = [r for r in rows if r[0] == key]
            if any(r[1] == 0 for r in run) and len({r[2] for r in run}) > 1:
                first = min(run, key=lambda r: r[1:])
                want += [r for r in run if r[2] != first[2] or r == first]
        assert {(r["key"], r["place"], r["node"]) for r in got} == set(want)


def test_word_hashes_follow_the_words(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice(["a", "B", "é", " ", "\t", "\n", "\u00a0", "x y", "word "]) for _ in range(3000))
    whole = J.word_hashes(text.encode(), J._Powers())
    words = text.encode().lower().split()
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
    assert {w: h for w, h in zip(words, whole.tolist())} == {w: J.word_hashes(b"  " + w, J._Powers())[0] for w in words}
    monkeypatch.setattr(J, "PIECE", 7)
    assert (J.word_hashes(text.encode(), J._Powers()) == whole).all()
    assert J.word_hashes(b"", J._Powers()).size == J.word_hashes(b" \n", J._Powers()).size == 0


@pytest.mark.parametrize("block,columns", [(3, 5), (512, 4096)])
def test_blocks_find_all_links(spark, monkeypatch, block, columns):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "COLUMNS", columns)
    rng = random.Random(4)
    docs = [d for k in range(3) for d in family(rng, 80, 30, 6, 100 * k)]
    check(spark, docs)
