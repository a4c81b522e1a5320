"""Isolation forest: trees grown on small hash samples, every row scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.functions import rng
from sievemill.operators.quantiles import exact_quantiles
from sievemill.session import cut, spread


def _average_path(n):
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    full = 2.0 * (np.log(safe - 1.0) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


def _grow(points: np.ndarray, gen: np.random.Generator, height: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, threshold, left, right, path length); feature -1 marks a leaf."""
    nodes: list = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(points.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= height or len(rows) <= 1 or len(usable) == 0:
            nodes[at] = (-1, 0.0, -1, -1, depth + float(_average_path(len(rows))))
            return at
        feature = int(gen.choice(usable))
        low, high = rows[:, feature].min(), rows[:, feature].max()
        threshold = float(gen.uniform(low, high))
        goes_left = rows[:, feature] <= threshold
        left = build(rows[goes_left], depth + 1)
        right = build(rows[~goes_left], depth + 1)
        nodes[at] = (feature, threshold, left, right, 0.0)
        return at

    build(points, 0)
    return nodes


def isolation_forest(
    df: DataFrame, cols: Sequence[str], key: str, trees: int = 100, sample: int = 256,
    contamination: float = 0.1, seed: int = 42,
) -> DataFrame:
    """Add ``_score`` (higher = stranger) and ``_anomaly_score`` (-1 for the strangest share, else 1).

    ``key`` identifies a row and drives the sampling.  Nulls count as 0.
    """
    cols = list(cols)
    spark = df.sparkSession
    data = df.select(F.col(key).alias("_key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    n = df.count()
    per_tree = min(1.0, sample / max(1, n))
    # each tree takes each row with the same chance, independently.  One draw per row gives the first tree that takes it
    # (no tree for most rows of a large table); only the trees after that are drawn one by one
    rows = spread(data.withColumn("_u", rng.uniform(seed, "pool", "_key")))
    if per_tree < 1:
        first = F.floor(F.log1p(-F.col("_u")) / F.lit(math.log1p(-per_tree))).cast("int")
        rows = rows.where(F.col("_u") < F.lit(-math.expm1(trees * math.log1p(-per_tree)))).withColumn("_first", F.least(first, F.lit(trees - 1)))
    else:
        rows = rows.withColumn("_first", F.lit(0))
    offered = rows.withColumn("tree", F.explode(F.sequence(F.col("_first"), F.lit(trees - 1))))
    # a 64-bit hash is enough here and far cheaper than a digest
    draw = F.xxhash64(F.lit(seed), F.col("tree"), F.col("_key").cast("string"))
    span = 1 << 53
    taken = (F.col("tree") == F.col("_first")) | (F.pmod("_draw", F.lit(span)) < F.lit(int(per_tree * span)))
    picked = offered.withColumn("_draw", draw).where(taken)
    height = math.ceil(math.log2(max(sample, 2)))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_draw", "_key"])
        tree = int(pdf["tree"].iloc[0])
        points = pdf[cols].to_numpy(dtype=float)
        nodes = _grow(points, np.random.default_rng([seed, tree]), height)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "lo", "hi", "path"])
        out["tree"], out["node"], out["size"] = tree, np.arange(len(nodes)), len(points)
        return out

    schema = "feature int, threshold double, lo int, hi int, path double, tree int, node int, size int"
    # trees x (2 x sample - 1) small rows
    grown = picked.groupBy("tree").applyInPandas(train, schema).toPandas()
    forest = []
    for _, t in grown.sort_values(["tree", "node"]).groupby("tree"):
        forest.append(tuple(t[c].to_numpy() for c in ("feature", "threshold", "lo", "hi", "path")) + (int(t["size"].iloc[0]),))
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        points = np.column_stack([v.to_numpy(dtype=float) for v in values])
        total, norm, rows = np.zeros(len(points)), 0.0, np.arange(len(points))
        for feature, threshold, lo, hi, path, size in shared.value:
            at = np.zeros(len(points), dtype=int)
            for _ in range(height):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                value = points[rows, np.maximum(feature[at], 0)]
                step = np.where(value <= threshold[at], lo[at], hi[at])
                at = np.where(inner, step, at)
            total += path[at]
            norm += float(_average_path(size))
        return pd.Series(np.power(2.0, -total / max(norm, 1e-12)))

    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    scored = cut(df.withColumn("_score", score(*filled)))
    edge = exact_quantiles(scored, ["_score"], [1.0 - contamination])["_score"][0]
    return scored.withColumn("_anomaly_score", F.when(F.col("_score") > F.lit(edge), -1).otherwise(1))
