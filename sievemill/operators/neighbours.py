"""Exact k-nearest-neighbour prediction in few dimensions.

Train points are combined when equal and cut into leaves by medians, level by level, so no leaf grows
with a crowded spot.  A test row first meets the leaf it falls in; the distance of the k-th point there is
a radius that surely holds k points.  It then goes down the tree once more, past boxes beyond that radius,
and meets the few leaves that are left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.session import cut, stored

#: points that are searched together, and test rows that meet them in one task
_BLOCK, _PART = 20_000, 100_000


def _descend(tree: list[tuple], points: np.ndarray) -> np.ndarray:
    """Leaf number of every point; nodes are (dimension, threshold, left, right) or None."""
    inner = np.array([t is not None for t in tree])
    dim = np.array([t[0] if t else 0 for t in tree], dtype=np.int64)
    threshold = np.array([t[1] if t else 0.0 for t in tree])
    left = np.array([t[2] if t else 0 for t in tree], dtype=np.int64)
    right = np.array([t[3] if t else 0 for t in tree], dtype=np.int64)
    at, rows = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
    while inner[at].any():
        step = np.where(points[rows, dim[at]] <= threshold[at], left[at], right[at])
        at = np.where(inner[at], step, at)
    return at


def _with_leaf(df: DataFrame, cols: Sequence[str], tree: list) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("bigint")
    def leaf(*values: pd.Series) -> pd.Series:
        return pd.Series(_descend(shared.value, np.column_stack([v.to_numpy(dtype=float) for v in values])))

    return df.withColumn("_leaf", leaf(*[F.col(c).cast("double") for c in cols]))


_SAMPLE = 50_000


def _first_tree(points: DataFrame, cols: Sequence[str], size: int, n: int) -> list:
    """Tree cut by the medians of a hash sample of some 50,000 points."""
    share = min(1.0, _SAMPLE / max(n, 1))
    picked = points.where(F.pmod(F.xxhash64(*cols, "_label"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(*cols)
    sample = picked.toPandas().to_numpy(dtype=float)
    tree: list = [None]
    todo = [(0, sample)]
    while todo:
        node, mine = todo.pop()
        if len(mine) <= max(size * share, 1):
            continue
        spans = mine.max(axis=0) - mine.min(axis=0)
        dim = int(np.argmax(spans))
        if spans[dim] <= 0:
            continue
        threshold = float(np.median(mine[:, dim]))
        if threshold >= mine[:, dim].max():
            threshold = float(mine[mine[:, dim] < threshold, dim].max())
        tree[node] = (dim, threshold, len(tree), len(tree) + 1)
        left = mine[:, dim] <= threshold
        todo += [(len(tree), mine[left]), (len(tree) + 1, mine[~left])]
        tree += [None, None]
    return tree


def _grow(points: DataFrame, cols: Sequence[str], size: int, n: int) -> tuple[list, pd.DataFrame]:
    """(tree, leaf boxes).  The sample's tree is measured on all points, and leaves that still hold too
    many are cut further, one aggregate of what was cut per level."""
    tree = _first_tree(points, cols, size, n)
    done, start = [], 0
    while True:
        stats = _with_leaf(points, cols, tree).where(F.col("_leaf") >= start).groupBy("_leaf").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_weight").alias("w"),
            *[f(c).alias(f"{tag}_{i}") for i, c in enumerate(cols) for tag, f in (("lo", F.min), ("hi", F.max))],
            *[F.percentile_approx(c, 0.5, 1000).alias(f"mid_{i}") for i, c in enumerate(cols)],
        ).toPandas()
        crowded = stats[stats["n"] > size]
        split, start = [], len(tree)
        for row in crowded.to_dict("records"):
            spans = [row[f"hi_{i}"] - row[f"lo_{i}"] for i in range(len(cols))]
            dim = int(np.argmax(spans))
            if spans[dim] <= 0:  # only equal points that differ in their label
                continue
            threshold = row[f"mid_{dim}"]
            if threshold >= row[f"hi_{dim}"]:
                threshold = row[f"lo_{dim}"]
            tree[row["_leaf"]] = (dim, float(threshold), len(tree), len(tree) + 1)
            tree += [None, None]
            split.append(row["_leaf"])
        done.append(stats[~stats["_leaf"].isin(split)])
        if not split:
            return tree, pd.concat(done, ignore_index=True)


class _Index:
    """The tree as arrays: boxes and weights of all nodes, the block of every leaf."""

    def __init__(self, tree: list, boxes: pd.DataFrame, dims: int):
        size = len(tree)
        self.inner = np.array([t is not None for t in tree])
        self.dim = np.array([t[0] if t else 0 for t in tree], dtype=np.int64)
        self.threshold = np.array([t[1] if t else 0.0 for t in tree])
        self.left = np.array([t[2] if t else 0 for t in tree], dtype=np.int64)
        self.right = np.array([t[3] if t else 0 for t in tree], dtype=np.int64)
        self.lo, self.hi = np.full((size, dims), np.inf), np.full((size, dims), -np.inf)
        self.weight, count = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        leaves = boxes["_leaf"].to_numpy(dtype=np.int64)
        self.lo[leaves] = boxes[[f"lo_{i}" for i in range(dims)]].to_numpy(dtype=float)
        self.hi[leaves] = boxes[[f"hi_{i}" for i in range(dims)]].to_numpy(dtype=float)
        self.weight[leaves], count[leaves] = boxes["w"].to_numpy(dtype=np.int64), boxes["n"].to_numpy(dtype=np.int64)
        # children come after their parent
        for i in np.flatnonzero(self.inner)[::-1]:
            a, b = self.left[i], self.right[i]
            self.lo[i], self.hi[i] = np.minimum(self.lo[a], self.lo[b]), np.maximum(self.hi[a], self.hi[b])
            self.weight[i] = self.weight[a] + self.weight[b]
        # leaves side by side make a block
        self.block, todo, number, held = np.zeros(size, dtype=np.int64), [0], 0, 0
        while todo:
            i = todo.pop()
            if self.inner[i]:
                todo += [self.right[i], self.left[i]]
                continue
            if held and held + count[i] > _BLOCK:
                number, held = number + 1, 0
            self.block[i], held = number, held + count[i]

    def home(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of every row, and the far side of the smallest box on its way that holds k points."""
        at, rows, held = np.zeros(len(x), dtype=np.int64), np.arange(len(x)), np.full(len(x), -1, dtype=np.int64)
        while True:
            held = np.where(self.weight[at] >= k, at, held)
            if not self.inner[at].any():
                break
            step = np.where(x[rows, self.dim[at]] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(self.inner[at], step, at)
        far = (np.maximum(np.abs(x - self.lo[held]), np.abs(x - self.hi[held])) ** 2).sum(axis=1)
        return at, np.where(held >= 0, far, np.inf)

    def reach(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves within the radius of a row."""
        rows, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        radius = radius * (1 + 1e-12)
        while len(rows):
            near = (np.maximum(np.maximum(self.lo[at] - x[rows], x[rows] - self.hi[at]), 0.0) ** 2).sum(axis=1)
            stay = ~(near > radius[rows]) & (self.weight[at] > 0)
            rows, at = rows[stay], at[stay]
            inner = self.inner[at]
            found.append((rows[~inner], at[~inner]))
            rows, at = rows[inner], at[inner]
            rows, at = np.concatenate([rows, rows]), np.concatenate([self.left[at], self.right[at]])
        return np.concatenate([f[0] for f in found] or [rows]), np.concatenate([f[1] for f in found] or [at])


def _matrix(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([table[c].to_numpy() for c in names]).astype(float)


def _nearest(probes: pa.Table, points: pa.Table, d: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(probe, point, distance, weight) of the points of a probe's leaf that may be among its k nearest, by probe and distance."""
    order = pc.sort_indices(points, sort_keys=[("_leaf", "ascending"), ("_first", "ascending")], null_placement="at_start").to_numpy()
    p, leaf = _matrix(points, [f"_p{i}" for i in range(d)])[order], points["_leaf"].to_numpy()[order]
    weight = points["_weight"].to_numpy()[order]
    x, radius, asked = _matrix(probes, [f"_x{i}" for i in range(d)]), probes["_radius"].to_numpy(), probes["_leaf"].to_numpy()
    turn = np.argsort(asked, kind="stable")
    for mine in np.split(turn, np.flatnonzero(np.diff(asked[turn])) + 1):
        a, b = np.searchsorted(leaf, asked[mine[0]]), np.searchsorted(leaf, asked[mine[0]], "right")
        if a == b:
            continue
        step = max(1, 1_000_000 // int(b - a))
        for start in range(0, len(mine), step):
            part = mine[start:start + step]
            away = sum(((x[part, i][:, None] - p[a:b, i]) ** 2 for i in range(1, d)), (x[part, 0][:, None] - p[a:b, 0]) ** 2)
            most = radius[part] * (1 + 1e-12)
            if b - a > k:
                most = np.minimum(most, np.partition(away, k - 1, axis=1)[:, k - 1])
            rows, at = np.nonzero(~(away > most[:, None]))
            far = away[rows, at]
            # points lie in the order of their first key, which decides between equal distances
            by = np.lexsort((at, far, rows))
            rows, at, far = rows[by], at[by], far[by]
            w = weight[a + at]
            sums = np.concatenate([[0], np.cumsum(w)])
            before = sums[:-1] - sums[np.searchsorted(rows, rows)]
            keep = before < k
            yield part[rows[keep]], order[a + at[keep]], far[keep], w[keep]


def _met(probes: DataFrame, points: DataFrame, run, schema: str) -> DataFrame:
    """``run(probes, points)`` per block; a block asked for by very many test rows is dealt over several tasks."""
    spark = probes.sparkSession
    sizes = probes.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / F.lit(_PART)).alias("_parts"))
    sizes = F.broadcast(stored(sizes))
    # the rows are written down, so their numbers stay
    left = probes.join(sizes, "_block").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts"))).drop("_parts")
    right = points.join(sizes, "_block").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    # few bytes but long work: adaptive execution keeps a partition count that is asked for
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["_block", "_part"]
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInArrow(run, schema)


def knn(
    train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, train_key: str, test_key: str, k: int = 5,
    task: str = "classification", leaf: int = 2000, most_leaves: int = 50_000,
) -> DataFrame:
    """(test_key, prediction) by the k nearest train rows (Euclidean; the smaller train key on ties).

    Classification takes the most frequent label, the smaller on ties; regression the mean.  Train rows with a
    null or NaN feature are left out; test rows with one are near nothing and get a null prediction.
    """
    cols = list(cols)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])
    unknown = test.where(~known).select(test_key)
    train, test = train.where(known), test.where(known)
    merged = train.groupBy(*[F.col(c).cast("double").alias(c) for c in cols], F.col(label).alias("_label")).agg(
        F.count(F.lit(1)).alias("_weight"), F.min(train_key).alias("_first")
    )
    points = cut(merged)
    n = points.count()
    size = max(leaf, 4 * k, n // most_leaves)
    tree, boxes = _grow(points, cols, size, n)
    d = len(cols)
    shared = train.sparkSession.sparkContext.broadcast(_Index(tree, boxes, d))
    xs, ps = [f"_x{i}" for i in range(d)], [f"_p{i}" for i in range(d)]
    block = F.pandas_udf(lambda leaf: pd.Series(shared.value.block[leaf.to_numpy()]), "bigint")
    placed = cut(_with_leaf(points, cols, tree).select("_leaf", block("_leaf").alias("_block"), *[F.col(c).alias(p) for c, p in zip(cols, ps)], "_label", "_weight", "_first"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaf, radius = shared.value.home(pdf[xs].to_numpy(dtype=float), k)
            yield pdf.assign(_radius=radius, _leaf=leaf, _block=shared.value.block[leaf])

    def tighten(probes: pa.Table, points: pa.Table) -> pa.Table:
        radius = probes["_radius"].to_numpy().copy()
        if len(probes) and len(points):
            for rows, _, far, w in _nearest(probes, points, d, k):
                full = np.bincount(rows, w, len(radius)) >= k
                last = np.full(len(radius), np.inf)
                last[rows] = far  # the farthest comes last
                radius = np.where(full, np.minimum(radius, last), radius)
        return probes.select(["_test", *xs]).append_column("_radius", pa.array(radius))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, leaves = shared.value.reach(pdf[xs].to_numpy(dtype=float), pdf["_radius"].to_numpy(dtype=float))
            for start in range(0, len(rows), 100_000):
                leaf = leaves[start:start + 100_000]
                out = pdf.iloc[rows[start:start + 100_000]].reset_index(drop=True)
                yield out.assign(_leaf=leaf, _block=shared.value.block[leaf])

    def pick(probes: pa.Table, points: pa.Table) -> pa.Table:
        got = list(_nearest(probes, points, d, k)) if len(probes) and len(points) else []
        rows, at, far = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, dtype=t) for i, t in enumerate(("int64", "int64", "float64")))
        taken = points.select(["_label", "_weight", "_first"]).take(pa.array(at))
        return pa.table([probes["_test"].take(pa.array(rows)), *taken.columns, pa.array(far)], names=["_test", *taken.column_names, "_away"])

    kinds = dict(placed.dtypes) | {"_test": dict(test.dtypes)[test_key]}
    row = f"_test {kinds['_test']}, " + ", ".join(f"{x} double" for x in xs) + ", _radius double"
    asked = test.select(F.col(test_key).alias("_test"), *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs)])
    asked = cut(asked.mapInPandas(settle, f"{row}, _leaf bigint, _block bigint"))
    probes = cut(_met(asked, placed, tighten, row).mapInPandas(meet, f"{row}, _leaf bigint, _block bigint"))
    near = _met(probes, placed, pick, f"_test {kinds['_test']}, _label {kinds['_label']}, _weight bigint, _first {kinds['_first']}, _away double")
    # a test row meets a bounded number of leaves, each of which gives its k nearest
    w = Window.partitionBy("_test").orderBy("_away", "_first")
    near = near.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    before = F.sum("_weight").over(w.rowsBetween(Window.unboundedPreceding, -1))
    used = near.withColumn("_used", F.least(F.col("_weight"), F.lit(k) - F.coalesce(before, F.lit(0)))).where(F.col("_used") > 0)
    if task == "regression":
        value = F.sum(F.col("_label") * F.col("_used")) / F.sum("_used")
        found = used.groupBy(F.col("_test").alias(test_key)).agg(value.alias("prediction"))
        return found.unionByName(unknown.withColumn("prediction", F.lit(None).cast(found.schema["prediction"].dataType)))
    votes = used.groupBy("_test", "_label").agg(F.sum("_used").alias("_votes"))
    best = Window.partitionBy("_test").orderBy(F.desc("_votes"), F.asc("_label"))
    found = votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(F.col("_test").alias(test_key), F.col("_label").alias("prediction"))
    return found.unionByName(unknown.withColumn("prediction", F.lit(None).cast(found.schema["prediction"].dataType)))
