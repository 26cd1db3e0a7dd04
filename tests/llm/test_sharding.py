"""The lookup table against its definition, and placement over it."""

import hashlib

import pytest

from palimpsest.llm import sharding as S


def by_definition(names, slots):
    """Permutations written out; shards take turns."""
    orders = []
    for name in names:
        d = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        orders.append([(offset + k * skip) % slots for k in range(slots)])
        assert sorted(orders[-1]) == list(range(slots))
    table, turn = {}, 0
    while len(table) < slots:
        slot = next(s for s in orders[turn % len(names)] if s not in table)
        table[slot] = turn % len(names)
        turn += 1
    return [table[s] for s in range(slots)]


@pytest.mark.parametrize("count,slots", [(1, 7), (3, 7), (7, 7), (5, 101), (8, 251)])
def test_table(count, slots):
    names = [f"s{k}" for k in range(count)]
    table = S.lookup_table(names, slots)
    assert table == by_definition(names, slots)
    shares = [table.count(k) for k in range(count)]
    assert max(shares) - min(shares) <= 1


def test_few_slots_move():
    names = [f"s{k}" for k in range(20)]
    a, b = S.lookup_table(names, 65537), S.lookup_table(names[:-1], 65537)
    moved = sum(x != y for x, y in zip(a, b) if x != 19)
    assert moved < 0.1 * 65537


@pytest.mark.parametrize("names,slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_arguments(names, slots):
    with pytest.raises(ValueError):
        S.lookup_table(names, slots)


def test_placement(spark):
    names = ["x", "y", "z"]
    rows = spark.createDataFrame([(1, "a", 9), (None, "b", 9), (1, "a", 9), (2, None, 9)], "doc_id long, shard string, slot int")
    got = S.assign_shards(rows, "doc_id", names, slots=101).collect()
    table = S.lookup_table(names, 101)
    assert len(got) == 4 and {r.slot for r in got if r.doc_id == 1} == {int(hashlib.md5(b"k1").hexdigest()[:15], 16) % 101}
    assert all(r.shard == names[table[r.slot]] for r in got)
    assert S.assign_shards(rows.limit(0), "doc_id", names).collect() == []
    texts = spark.createDataFrame([("", 1), ("long " * 9999, 2)], "k string, _at int")
    assert sorted(r._at for r in S.assign_shards(texts, "k", names).collect()) == [1, 2]


def test_written_shards(spark, tmp_path):
    rows = spark.range(500).withColumnRenamed("id", "doc_id")
    S.write_shards(rows, f"file://{tmp_path}/out", "doc_id", ["a", "b"], pieces=3)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 500 and {r.shard for r in back.collect()} == {"a", "b"}
    want = {r.doc_id: r.shard for r in S.assign_shards(rows, "doc_id", ["a", "b"]).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want


def test_plan_is_native(spark):
    plan = S.assign_shards(spark.range(10), "id", ["a", "b"])._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "ExistingRDD" not in plan
