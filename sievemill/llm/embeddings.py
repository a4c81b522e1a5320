"""Embedding near-duplicates by sorted projection passes.

In each pass every vector gets a word of random hyperplane signs; vectors are ordered by these words and each is compared
with a bounded number of its successors.  Vectors at a small angle agree on the first signs more often than not, so a few
passes bring almost every such pair together once.  Their number grows with the rows.  What they find is held against
all links of some vectors; while too many are missed, as in a crowd that the planes leave together, passes double, and
their planes go through the vectors that miss links.  That is so at every size; only where the next doubling would cost more
than all pairs, and links are still missed, all pairs are compared.
Verified pairs are united over all passes.  Within the components, links are then counted exactly, by blocked products,
so that windows set no bound on a vector's links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import components, stored
from sievemill.session import cut

LIMIT = 0.95
#: sorted passes at least, signs per pass, successors that a vector is compared with, vectors per block
PASSES, SIGNS, WINDOW, BLOCK = 12, 62, 64, 512
#: members of a component that one product holds on either side
MEMBERS = 1024
#: chance that a pair at LIMIT is met in evenly spread vectors; vectors whose links are all looked up, share of these to be found
MET, PROBES, FOUND = 0.999, 2048, 0.999


def _unit(rows: pa.Array) -> np.ndarray:
    """Unit vectors in double precision; all rows have the same dimension."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # no overflow of the squares
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _by_dimension(rows: pa.Array) -> Iterator[np.ndarray]:
    """Positions of the rows of each dimension."""
    sizes = np.asarray(pc.list_value_length(rows))
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def passes_for(rows: int, limit: float, window: int, least: int) -> int:
    """Passes that bring a pair at ``limit`` together with chance MET: in one its signs agree until a window holds what is left."""
    together = (1 - math.acos(limit) / math.pi) ** max(math.log2(max(rows, 1) / window), 0)
    return least if together >= 1 else max(least, math.ceil(math.log(1 - MET) / math.log(1 - together)))


def sign_words(unit: np.ndarray, one_pass: int, signs: int, points: np.ndarray | None = None) -> np.ndarray:
    """A pass's word of random hyperplane signs for each vector; the first sign is the highest bit.

    Planes go through the origin, or each through one of ``points``.
    """
    rng = np.random.default_rng([17, one_pass, unit.shape[1]])
    planes = rng.standard_normal((unit.shape[1], signs))
    at = 0 if points is None or not len(points) else (points[rng.integers(0, len(points), signs)] * planes.T).sum(axis=1)
    return ((unit @ planes > at).astype(np.int64) << np.arange(signs - 1, -1, -1)).sum(axis=1)


def _local_roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """Smallest position that each of n positions reaches by pairs."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _candidates(classes: DataFrame, limit: float, passes: range, signs: int, window: int, points: dict[int, np.ndarray]) -> DataFrame:
    """Verified edges (a, b) that span what the windows of all passes have found; ``points`` of each dimension for the planes."""
    spark = classes.sparkSession
    through = spark.sparkContext.broadcast(points)
    kind = classes.schema["embedding"].dataType.simpleString()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_dimension(batch.column("embedding")):
                part = batch.take(pa.array(rows))
                unit = _unit(part.column("embedding"))
                for p in passes:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), p, np.int32)), pa.array(sign_words(unit, p, signs, through.value.get(unit.shape[1]))), part.column("rep"), part.column("embedding")],
                        names=["pass", "word", "rep", "embedding"],
                    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["part", "n"])

    keyed = classes.select("rep", "embedding").mapInArrow(words, f"pass int, word bigint, rep bigint, embedding {kind}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a checkpoint keeps the partitions and the order in them
    ordered = cut(keyed.repartitionByRange(parts, "pass", "word", "rep").sortWithinPartitions("pass", "word", "rep"))
    sizes = {r["part"]: r["n"] for r in ordered.mapInArrow(count, "part int, n bigint").collect()}  # one row per partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = before[TaskContext.get().partitionId()]
        for batch in batches:
            place = np.arange(at, at + batch.num_rows, dtype=np.int64)
            at += batch.num_rows
            names = ["block", "place", *batch.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(place // BLOCK), pa.array(place), *batch.columns], names=names)
            shared = np.flatnonzero((place % BLOCK < window) & (place >= BLOCK))  # also the successors of the block before
            if len(shared):
                again = batch.take(pa.array(shared))
                yield pa.RecordBatch.from_arrays([pa.array(place[shared] // BLOCK - 1), pa.array(place[shared]), *again.columns], names=names)

    placed = ordered.mapInArrow(place, f"block bigint, place bigint, pass int, word bigint, rep bigint, embedding {kind}")

    def compare(block: pa.Table) -> pa.Table:
        block = block.sort_by("place").combine_chunks()
        vectors, reps = block.column("embedding").combine_chunks(), block.column("rep").to_numpy()
        place, which = block.column("place").to_numpy(), block.column("pass").to_numpy()
        a, b = [], []
        for rows in _by_dimension(vectors):
            unit = _unit(vectors.take(pa.array(rows)))
            apart = place[rows][None, :] - place[rows][:, None]
            near = (unit @ unit.T >= limit) & (apart > 0) & (apart <= window) & (which[rows][None, :] == which[rows][:, None])
            roots = _local_roots(np.argwhere(near), len(rows))
            moved = np.flatnonzero(roots != np.arange(len(rows)))
            a.append(reps[rows[moved]])
            b.append(reps[rows[roots[moved]]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return placed.groupBy("block").applyInArrow(compare, "a bigint, b bigint").where("a <> b").distinct()


def _dealt(members: DataFrame) -> DataFrame:
    """Rows (rep, copies, embedding, root), dealt so that any two of a root meet in one group of root, one, two."""
    sizes = stored(members.groupBy("root").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).alias("parts")))
    members = stored(members).join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    return dealt.select("root", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "rep", "copies", "embedding")


def _all_pairs(classes: DataFrame, limit: float) -> DataFrame:
    """Edges (a, b) that span all links."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        reps, vectors = group.column("rep").to_numpy(), group.column("embedding").combine_chunks()
        a, b = [], []
        for rows in _by_dimension(vectors):
            unit = _unit(vectors.take(pa.array(rows)))
            roots = _local_roots(np.argwhere(unit @ unit.T >= limit), len(rows))
            moved = np.flatnonzero(roots != np.arange(len(rows)))
            a.append(reps[rows[moved]])
            b.append(reps[rows[roots[moved]]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    dealt = _dealt(classes.withColumn("root", F.lit(0).cast("bigint")))
    return dealt.groupBy("root", "one", "two").applyInArrow(compare, "a bigint, b bigint").distinct()


def _probe(classes: DataFrame, limit: float) -> tuple[dict[int, np.ndarray], DataFrame]:
    """The probed vectors by rep, and links (a, b) of theirs: one for each probe and Arrow batch that holds any."""
    taken = classes.orderBy(F.xxhash64("rep", F.lit(5)), "rep").limit(PROBES).select("rep", "embedding").toArrow().combine_chunks()
    vectors, reps, groups = taken.column("embedding").combine_chunks(), taken.column("rep").to_numpy(), {}
    for rows in _by_dimension(vectors):
        unit = _unit(vectors.take(pa.array(rows)))
        groups[unit.shape[1]] = (reps[rows], unit)
    probes = classes.sparkSession.sparkContext.broadcast(groups)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_dimension(batch.column("embedding")):
                part = batch.take(pa.array(rows))
                unit, reps = _unit(part.column("embedding")), part.column("rep").to_numpy()
                own, probed = probes.value.get(unit.shape[1], (reps[:0], unit[:0]))
                near = (probed @ unit.T >= limit) & (own[:, None] != reps[None, :])
                # any of the batch, by a number that hangs on nothing else
                pick = (near * np.random.default_rng(len(rows)).random(len(rows))).argmax(axis=1) if len(own) else own
                hit = np.flatnonzero(near.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(own[hit]), pa.array(reps[pick[hit]])], names=["a", "b"])

    links = stored(classes.select("rep", "embedding").mapInArrow(look, "a bigint, b bigint"))
    return {int(r): v for own, unit in groups.values() for r, v in zip(own, unit)}, links


def _roots(classes: DataFrame, limit: float, passes: int, signs: int, window: int) -> DataFrame:
    """Components (id, root) of the links: by passes, more of them while probes miss links; the rest by all pairs once these cost less."""
    rows = classes.count()
    due, done, edges, probed, points = passes_for(rows, limit, window, passes), 0, None, None, {}
    while True:
        new = stored(_candidates(classes, limit, range(done, due), signs, window, points))
        edges = new if edges is None else edges.union(new)
        roots = stored(components(edges))
        probed = probed or _probe(classes, limit)
        left, right = (roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        held = probed[1].join(left, "a", "left").join(right, "b", "left")
        total, found = held.agg(F.count("*"), F.coalesce(F.sum((F.col("root_a") == F.col("root_b")).cast("int")), F.lit(0))).first()
        if found >= FOUND * total:
            return roots
        lost = held.where(F.coalesce(F.col("root_a") != F.col("root_b"), F.lit(True))).select("a").distinct().collect()  # PROBES at most
        points = {}
        for r in sorted(r["a"] for r in lost):
            points.setdefault(len(probed[0][r]), []).append(probed[0][r])
        points = {size: np.array(group) for size, group in points.items()}
        done, due = due, 2 * due
        if rows <= 2 * due * BLOCK:
            return stored(components(_all_pairs(classes, limit)))


def _exact_links(classes: DataFrame, roots: DataFrame, limit: float) -> DataFrame:
    """Number of rows that each class of a component links with, its own copies left out: (rep, links)."""
    dealt = _dealt(classes.join(roots, classes["rep"] == roots["id"]).select("rep", "copies", "embedding", "root"))

    def count(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        reps, copies, part = (group.column(c).to_numpy() for c in ("rep", "copies", "part"))
        vectors = group.column("embedding").combine_chunks()
        one = group.column("one")[0].as_py()
        same = group.column("two")[0].as_py() == one
        links = np.zeros(len(reps), dtype=np.int64)
        for rows in _by_dimension(vectors):
            unit = _unit(vectors.take(pa.array(rows)))
            left = np.flatnonzero(part[rows] == one)
            right = left if same else np.flatnonzero(part[rows] != one)
            near = unit[left] @ unit[right].T >= limit
            if same:
                np.fill_diagonal(near, False)
            links[rows[left]] += near @ copies[rows[right]]
            if not same:
                links[rows[right]] += near.T @ copies[rows[left]]
        return pa.table({"rep": reps, "links": links})

    return dealt.groupBy("root", "one", "two").applyInArrow(count, "rep bigint, links bigint").groupBy("rep").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, limit: float = LIMIT, passes: int = PASSES, signs: int = SIGNS, window: int = WINDOW,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of ``limit`` or more, in double precision.  Ids are taken as unique.  Rows whose vector or id is
    null, and vectors that are empty, zero or hold null or non-finite numbers, link with nothing and stay; so do vectors of
    different dimensions with each other.  Equal vectors are compared once and count as often as they occur.  An empty
    table gives no rows; further columns are left out.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("double")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(sound)
    classes = stored(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    roots = _roots(classes, limit, passes, signs, window)
    links = stored(_exact_links(classes, roots, limit))
    known = classes.join(roots, classes["rep"] == roots["id"], "left").join(links, "rep", "left")
    known = stored(known.select("embedding", F.coalesce("root", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    linked = good.join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
