"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation that balances and fits binary codes is learnt on a bounded sample (principal axes, then
alternating signs and rotations); every vector is coded. The code is cut into substrings, one table
each; vectors meet in a table when their substrings differ in at most two bits, as both sides look up
their own substring and all with one bit flipped. What meets is reranked with the original vectors, so
no pair below the threshold is linked. A pair is missed if its substrings all differ in more bits, or its
whole codes in more than a limit. How many are missed depends on the vectors (codes are of centred ones,
so a strong common direction parts linked vectors): on a sample of rows the links are counted by brute
force, and bits and limits are widened until at least ``RECALL`` of them are met, in the last step to all
pairs of a label. A sample without any links says nothing, and nothing is widened.

Links are counted without listing the pairs of a dense group. Equal vectors are one node. Nodes within
half the linking angle of a leader are surely linked to one another and count as a cluster; a node
meets other clusters as wholes: by its angle to their leader and their radius it is linked to all of a
cluster, to none, or is compared with its members one by one.

Vectors link only under equal labels that are not null, and with vectors of their own length. Vectors
that are null, empty, zero or hold null or non-finite components link with nothing, as do those
without a label: ``n_links`` 0, their own component. Repeated rows and ids each count as a vector; a
component's id is its smallest id that is not null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.session import written

LEAST = 0.93
#: Vectors that the rotation is learnt on, the lowest by a hash; rounds of learning.
SAMPLE = 10_000
ROUNDS = 40
#: Tables and bits of their substrings (64 bits in all).
TABLES, WIDTH = 4, 16
#: Bits in which codes may differ: of linked nodes, and of a node and the leader of a cluster it meets.
APART, APART_LEADER = 20, 26
#: Steps of widening: tables, bits of their substrings, bits flipped by either side, and bits in which codes
#: may differ as above; none for all pairs.
STEPS = (
    (TABLES, WIDTH, 1, 1, APART, APART_LEADER),
    (4, 16, 1, 1, 28, 32),
    (4, 16, 2, 1, 30, 34),
    (4, 16, 2, 2, 34, 38),
    (5, 12, 2, 1, 36, 40),
    None,
)
#: Share of the links of sampled rows that must be met, and the rows.
RECALL, CHECKED = 0.95, 1000
#: Angles are compared with this much room where rounding could matter.
ROOM = 1e-7


def learn_rotation(vectors: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of unit vectors such that the signs of the projected ones are balanced and
    close to them. Fewer dimensions than bits are rotated more than once."""
    mean = vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])
    centred = vectors - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    flat, parts = centred @ axes, []
    rng = np.random.default_rng(17)
    while sum(p.shape[1] for p in parts) < bits:
        rotation = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))[0]
        for _ in range(rounds if len(vectors) else 0):
            left, _, right = np.linalg.svd(np.where(flat @ rotation >= 0, 1.0, -1.0).T @ flat)
            rotation = (left @ right).T
        parts.append(axes @ rotation)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def codes_of(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The signs of each vector's projection as one 64-bit number."""
    signs = (vectors - mean) @ projection >= 0
    packed = np.zeros((len(vectors), 64), bool)
    packed[:, : signs.shape[1]] = signs
    return np.packbits(packed, axis=1, bitorder="little").view("<i8")[:, 0]


def _units(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of unit length, padded with zeros."""
    lists = column.to_pylist() if column.null_count else None
    sizes = np.diff(column.offsets.to_numpy()) if lists is None else np.array([len(x) for x in lists])
    if lists is None and sizes.size and (sizes == dimensions).all():
        out = column.flatten().to_numpy().astype(float).reshape(-1, dimensions)
    else:
        out = np.zeros((len(column), dimensions))
        for row, values in zip(out, column.to_pylist()):
            row[: len(values)] = values
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def link_near_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = LEAST,
    sample: int = SAMPLE,
) -> DataFrame:
    """Per row of ``vectors``: ``(id, n_links, component_id, kept)``."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = _usable(F.col("vector"), F.col("label"))
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("label", "vector")))
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("_id").alias("least_id"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    nodes = written(nodes.withColumn("length", F.size("vector")).withColumn("norm", F.sqrt(_dot(F.col("vector"), F.col("vector")))), "nodes")
    coded = written(_coded(nodes, sample), "coded")
    points = nodes.select("node", "vector", "norm")

    clusters = written(_clusters(coded, points, least), "clusters")
    coded = coded.join(clusters, "node")
    leaders = coded.groupBy("leader").agg(F.sum("copies").alias("all_copies"), F.count("*").alias("members"), F.max("angle").alias("radius"))
    leaders = written(leaders.join(coded.select(F.col("node").alias("leader"), F.col("code").alias("leader_code")), "leader"), "leaders")
    coded = written(coded.join(leaders, "leader"), "members")

    step = _step(coded, points, least)
    met = written(_angles(_meetings(coded, step), points, "a", "b"), "met")
    limit = math.acos(least)
    met = met.join(coded.select(F.col("node").alias("a"), F.col("copies").alias("copies_a")), "a").join(
        leaders.select(F.col("leader").alias("b"), "all_copies", "members", "radius"), "b"
    )
    single = F.col("members") == 1
    whole = (single & (F.col("cosine") >= least)) | (~single & (F.col("angle") + F.col("radius") <= limit - ROOM))
    part = ~single & ~whole & (F.col("angle") - F.col("radius") <= limit + ROOM)
    met = written(met.withColumn("whole", whole).withColumn("part", part).where("whole or part"), "links")
    members = coded.select(F.col("leader").alias("_leader"), F.col("node").alias("b"), F.col("copies").alias("copies_b"))
    listed = met.where("part").select("a", "copies_a", F.col("b").alias("_leader")).join(members, "_leader").drop("_leader")
    listed = written(_angles(listed, points, "a", "b").where(F.col("cosine") >= least), "pairs")

    added = (
        met.where("whole").select(F.col("a").alias("node"), F.col("all_copies").alias("more"))
        .unionByName(listed.select(F.col("a").alias("node"), F.col("copies_b").alias("more")))
        .unionByName(listed.select(F.col("b").alias("node"), F.col("copies_a").alias("more")))
    )
    added = written(added.groupBy("node").agg(F.sum("more").alias("more")), "added")
    by_leader = written(met.where("whole").groupBy(F.col("b").alias("leader")).agg(F.sum("copies_a").alias("met_by")), "met_by")
    counted = coded.join(by_leader, "leader", "left").join(added, "node", "left")
    links = F.col("all_copies") - 1 + F.coalesce("met_by", F.lit(0)) + F.coalesce("more", F.lit(0))

    edges = coded.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    edges = edges.unionByName(met.where("whole").select("a", "b")).unionByName(listed.select("a", "b"))
    label = written(components(edges), "labels")
    counted = counted.select("node", "least_id", links.alias("n_links")).join(label, "node", "left")
    counted = written(counted.withColumn("root", F.coalesce("root", "node")), "counted")
    least_id = written(counted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    found = written(counted.join(least_id, "root").select("node", "n_links", "component_id"), "found")

    out = rows.select("_id", "node").join(found, "node", "left")
    component = F.coalesce("component_id", "_id")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )


def _coded(nodes: DataFrame, sample: int) -> DataFrame:
    """``(node, label, length, copies, least_id, code)`` by a rotation learnt on a sample."""
    dimensions = nodes.agg(F.max("length")).first()[0] or 1
    bits = TABLES * WIDTH

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_units(b.column("vector"), dimensions) for b in batches if b.num_rows]
        mean, projection = learn_rotation(np.concatenate(got) if got else np.zeros((0, dimensions)), bits)
        yield pa.record_batch([pa.array([mean.tobytes()], pa.binary()), pa.array([projection.tobytes()], pa.binary())], names=["mean", "projection"])

    chosen = nodes.select("vector", F.xxhash64("node").alias("_order")).orderBy("_order").limit(sample)
    learnt = chosen.select("vector").repartition(1).mapInArrow(learn, "mean binary, projection binary").first()
    mean = np.frombuffer(learnt.mean).copy()
    projection = np.frombuffer(learnt.projection).reshape(dimensions, bits).copy()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = codes_of(_units(batch.column("vector"), dimensions), mean, projection)
                rest = batch.drop_columns(["vector"])
                yield pa.record_batch([*rest.columns, pa.array(found)], names=[*rest.schema.names, "code"])

    kept = nodes.select("node", "label", "length", "copies", "least_id", "vector")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "vector")
    return kept.mapInArrow(code, f"{fields}, code long")


def _substrings(flips: int, tables: int = TABLES, width: int = WIDTH) -> Column:
    """``table`` and ``mask`` of each substring of ``code``, as it is and with up to ``flips`` bits flipped."""
    masks = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(width), n)]
    return F.array(*[F.struct(F.lit(t).alias("table"), F.lit(m).alias("mask")) for t in range(tables) for m in masks])


def _keyed(rows: DataFrame, flips: int, tables: int = TABLES, width: int = WIDTH) -> DataFrame:
    """``rows`` once for each ``table`` and ``key`` that their code looks up."""
    keyed = rows.withColumn("_s", F.explode(_substrings(flips, tables, width)))
    own = F.expr(f"shiftright(code, _s.table * {width})").bitwiseAND((1 << width) - 1)
    return keyed.select(*rows.columns, F.col("_s.table").alias("table"), own.bitwiseXOR(F.col("_s.mask")).cast("int").alias("key"))


def _angles(pairs: DataFrame, points: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` of nodes with their cosine, in double precision, and angle."""
    left = points.select(F.col("node").alias(a), F.col("vector").alias("_v"), F.col("norm").alias("_n"))
    right = points.select(F.col("node").alias(b), F.col("vector").alias("_w"), F.col("norm").alias("_m"))
    both = pairs.join(left, a).join(right, b).withColumn("cosine", _dot(F.col("_v"), F.col("_w")) / (F.col("_n") * F.col("_m")))
    return both.drop("_v", "_w", "_n", "_m").withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine"))))


def _clusters(coded: DataFrame, points: DataFrame, least: float) -> DataFrame:
    """``(node, leader, angle)``: a leader leads itself; all others lie within half the linking angle of
    a leader with a smaller node number that shares a substring with them."""
    half = math.acos(least) / 2 - ROOM
    keyed = written(_keyed(coded.select("node", "code", "label", "length"), 0), "keyed")
    bucket = ["label", "length", "table", "key"]

    def near_pivots(of: DataFrame, pivots_from: DataFrame) -> DataFrame:
        pivots = pivots_from.groupBy(*bucket).agg(F.min(F.struct(F.col("node").alias("leader"), F.col("code").alias("_code"))).alias("p"))
        pairs = of.join(written(pivots.select(*bucket, "p.*"), "pivots"), bucket)
        pairs = pairs.where((F.col("leader") < F.col("node")) & (F.bit_count(F.col("code").bitwiseXOR(F.col("_code"))) <= APART))
        return _angles(pairs.select("node", "leader").distinct(), points, "node", "leader").where(F.col("angle") <= half)

    first = written(near_pivots(keyed, keyed), "first")
    follows = written(first.select("node").distinct(), "follows")
    leads = keyed.join(follows, "node", "left_anti")
    sure = first.join(follows.withColumnRenamed("node", "leader"), "leader", "left_anti")
    sure = written(sure.groupBy("node").agg(F.min_by(F.struct("leader", "angle"), "angle").alias("_l")).select("node", "_l.*"), "sure")
    left = keyed.join(follows, "node", "left_semi").join(sure, "node", "left_anti")
    late = near_pivots(left, leads).groupBy("node").agg(F.min_by(F.struct("leader", "angle"), "angle").alias("_l")).select("node", "_l.*")
    led = written(sure.unionByName(late), "led")
    alone = coded.join(led, "node", "left_anti").select("node", F.col("node").alias("leader"), F.lit(0.0).alias("angle"))
    return led.unionByName(alone)


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _are_met(step: tuple | None, a: np.ndarray, b: np.ndarray, member: np.ndarray, leader: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Whether a step lets pairs of codes meet: ``a`` and ``b`` by a substring, ``member`` and ``leader`` as a whole."""
    if step is None:
        return np.ones(a.shape, bool)
    tables, width, own, other, apart, apart_leader = step
    differ, near = (a ^ b).view(np.uint64), np.zeros(a.shape, bool)
    for t in range(tables):
        part = (differ >> np.uint64(t * width)) & np.uint64((1 << width) - 1)
        near |= np.bitwise_count(part) <= own + other
    return near & (_bits(member, leader) <= np.where(alone, apart, apart_leader))


def _step(coded: DataFrame, points: DataFrame, least: float) -> tuple | None:
    """The first step that meets enough of the links that sampled rows have by brute force."""
    group = F.xxhash64("label", "length")
    columns = ["node", "code", "leader", "leader_code", "members"]
    rows = coded.select(*columns, group.alias("group")).join(points.select("node", "vector"), "node")
    order = F.xxhash64(F.col("node"), F.lit(5))
    chosen = coded.select("node").orderBy(order).limit(CHECKED)
    sample = rows.join(F.broadcast(chosen), "node").toArrow()
    if not sample.num_rows:
        return STEPS[0]
    lists = sample.column("vector").combine_chunks()
    dimensions = max(len(v) for v in lists)
    vectors = _units(lists, dimensions)
    names = ("node", "code", "leader", "leader_code", "members", "group")
    node, code, leader, leader_code, members, groups = (sample.column(n).to_numpy() for n in names)
    known = set(groups.tolist())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((1 + len(STEPS), len(node)), np.int64)
        for batch in batches:
            batch = batch.filter(pa.array([g in known for g in batch.column("group").to_pylist()], pa.bool_()))
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                theirs = [part.column(n).to_numpy() for n in names]
                same = (theirs[5][:, None] == groups) & (theirs[0][:, None] != node)
                i, j = np.nonzero(same & (_units(part.column("vector"), dimensions) @ vectors.T >= least))
                # the one with the greater leader meets the other's leader; a cluster's own are met anyway
                first = theirs[2][i] > leader[j]
                member = np.where(first, theirs[1][i], code[j])
                head = np.where(first, leader_code[j], theirs[3][i])
                alone = np.where(first, members[j], theirs[4][i]) == 1
                own = theirs[2][i] == leader[j]
                totals[0] += np.bincount(j, minlength=len(node))
                for k, step in enumerate(STEPS):
                    met = own | _are_met(step, theirs[1][i], code[j], member, head, alone)
                    totals[k + 1] += np.bincount(j[met], minlength=len(node))
        yield pa.record_batch([pa.array(np.arange(len(node))), *map(pa.array, totals)], names=["j", "n", *(f"n{k}" for k in range(len(STEPS)))])

    fields = ", ".join(["j long", "n long", *(f"n{k} long" for k in range(len(STEPS)))])
    sums = rows.mapInArrow(count, fields).where("n > 0").groupBy("j").agg(F.sum("n").alias("n"), *(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(STEPS))))
    # by rows as well as by links, so that one large group does not speak for all
    shares = [F.least(F.avg(F.col(f"n{k}") / F.col("n")), F.sum(f"n{k}") / F.sum("n")) for k in range(len(STEPS))]
    recall = sums.agg(*shares).first()  # null where the sample has no links
    return next((step for step, share in zip(STEPS, recall) if share is None or share >= RECALL), None)


def _meetings(coded: DataFrame, step: tuple | None) -> DataFrame:
    """Distinct pairs ``(a, b)`` of a node and the leader, smaller than its own, of a cluster it meets."""
    names = ["node", "leader", "leader_code", "members", "code", "label", "length"]
    if step is None:
        heads = coded.where("node = leader").select("label", "length", F.col("leader").alias("b"))
        return coded.select("node", "leader", "label", "length").join(heads, ["label", "length"]).where("leader > b").select(F.col("node").alias("a"), "b")
    tables, width, own, other, most, most_leader = step
    keyed = _keyed(coded.select(*names), own, tables, width)
    theirs = keyed if own == other else _keyed(coded.select(*names), other, tables, width)
    bucket = ["label", "length", "table", "key"]
    present = theirs.groupBy(*bucket, F.col("leader").alias("b")).agg(F.first("leader_code").alias("_code"), F.first("members").alias("_members"))
    apart = F.bit_count(F.col("code").bitwiseXOR(F.col("_code")))
    near = apart <= F.when(F.col("_members") == 1, most).otherwise(most_leader)
    return keyed.join(present, bucket).where((F.col("leader") > F.col("b")) & near).select(F.col("node").alias("a"), "b").distinct()
