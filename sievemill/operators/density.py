"""Density clustering on a grid.

Cells are so small that all points of one cell are neighbours.  A cell with ``min_pts`` points therefore needs no distance to
know that all of them are core points, and what is compared with distances grows with the points times ``min_pts``: only points of
sparse cells look at the cells around them.  Core points of a cell are one cluster; two cells are tied by any one close pair, which
is searched by halving their boxes, so two crowded cells never meet with all their points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.operators.dedup import connected_components
from sievemill.session import stored

#: points of a cell that one task compares with those around it; larger cells are dealt over several
_PART = 10_000
#: pairs of points of two boxes that are compared directly; larger ones are halved
_PAIRS = 10_000


def _squared(xs: Sequence[Column], ys: Sequence[Column]) -> Column:
    total = (xs[0] - ys[0]) * (xs[0] - ys[0])
    for x, y in zip(xs[1:], ys[1:]):
        total = total + (x - y) * (x - y)
    return total


def _offsets(dims: int) -> list[tuple[int, ...]]:
    """Steps to all cells that may hold a neighbour."""
    reach = int(math.sqrt(dims) * (1 + 1e-6)) + 1
    return [o for o in product(range(-reach, reach + 1), repeat=dims) if sum(max(abs(k) - 1, 0) ** 2 for k in o) <= dims * (1 + 1e-6)]


def dbscan(df: DataFrame, key: str, cols: Sequence[str], eps: float, min_pts: int) -> DataFrame:
    """(key, core, cluster) of every row, by Euclidean distance over a few columns.

    A core point has at least ``min_pts`` points within ``eps``, itself included.  Core points within ``eps`` of each other are of
    one cluster, named by its smallest core key.  Any other point within ``eps`` of core points joins the smallest cluster among
    theirs; the rest, and rows with a null or non-finite coordinate, have none.  ``key`` is unique.
    """
    dims, side, near = len(cols), eps / math.sqrt(len(cols)) * (1 - 1e-9), eps * eps
    axes, cells = [f"x{i}" for i in range(dims)], [f"c{i}" for i in range(dims)]
    place = [(F.col(c).cast("double") / side).alias(f"y{i}") for i, c in enumerate(cols)]
    raw = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(a) for c, a in zip(cols, axes)], *place)
    fine = F.lit(True)
    for a in axes:
        fine = fine & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < 1e300)
    points = stored(raw.where(fine).select("key", *axes, *[F.floor(f"y{i}").alias(c) for i, c in enumerate(cells)]))
    sizes = points.groupBy(*cells).agg(F.count("*").alias("n"))
    sizes = stored(sizes.withColumn("parts", F.ceil(F.col("n") / F.lit(_PART))))
    dealt = stored(points.join(sizes, cells).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))))
    lonely = dealt.where(F.col("n") < min_pts)

    around = F.explode(F.array(*[F.struct(*[F.lit(k).alias(f"o{i}") for i, k in enumerate(o)]) for o in _offsets(dims)])).alias("o")
    asked = lonely.select(F.col("key").alias("asking"), *[F.col(a).alias(f"q{i}") for i, a in enumerate(axes)], *cells, around)
    asked = asked.select("asking", *[f"q{i}" for i in range(dims)], *[(F.col(c) + F.col(f"o.o{i}")).alias(c) for i, c in enumerate(cells)])
    # a crowded cell is asked in each of its parts
    asked = asked.join(sizes, cells).select("asking", *[f"q{i}" for i in range(dims)], *cells, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    close = _squared([F.col(f"q{i}") for i in range(dims)], [F.col(a) for a in axes]) <= near
    counted = asked.join(dealt.select(*axes, *cells, "part"), [*cells, "part"]).where(close).groupBy("asking").count()
    core_lonely = counted.where(F.col("count") >= min_pts).select(F.col("asking").alias("key"))
    core = stored(dealt.where(F.col("n") >= min_pts).unionByName(lonely.join(core_lonely, "key", "left_semi").select(*dealt.columns)))

    heads = stored(core.groupBy(*cells).agg(F.min("key").alias("head")))
    tied = connected_components(_ties(core, heads, axes, cells, side, near)).toDF("head", "found")
    named = stored(heads.join(tied, "head", "left").select(*cells, F.coalesce("found", "head").alias("cluster")))
    labelled = stored(core.join(named, cells).select("key", *axes, *cells, "part", "cluster"))
    border = asked.join(labelled.drop("key"), [*cells, "part"]).where(close).groupBy(F.col("asking").alias("key")).agg(F.min("cluster").alias("beside"))
    rows = df.select(F.col(key).alias("key")).join(labelled.select("key", "cluster"), "key", "left").join(border, "key", "left")
    return rows.select(F.col("key").alias(key), F.col("cluster").isNotNull().alias("core"), F.coalesce("cluster", "beside").alias("cluster"))


def _ties(core: DataFrame, heads: DataFrame, axes: list[str], cells: list[str], side: float, near: float) -> DataFrame:
    """(u, v): heads of neighbouring cells that have core points within reach of each other."""
    dims = len(axes)
    # equal points are one; y is the place in units of a cell, so that doubling it halves the boxes exactly
    places = stored(core.select(*axes, *cells).distinct().join(heads, cells).select("head", *cells, *axes, *[(F.col(a) / side).alias(f"y{i}") for i, a in enumerate(axes)]))

    def boxes(level: int) -> DataFrame:
        subs = [F.floor(F.col(f"y{i}") * (1 << level)).alias(f"s{i}") for i in range(dims)]
        bounds = [g(a).alias(f"{n}{i}") for i, a in enumerate(axes) for g, n in ((F.min, "lo"), (F.max, "hi"))]
        return places.groupBy("head", *subs).agg(F.count("*").alias("n"), *bounds)

    def renamed(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{mark}_{c}") for c in df.columns])

    level, met = 0, None
    forward = [o for o in _offsets(dims) if o > (0,) * dims]
    here = stored(boxes(0))
    step = F.explode(F.array(*[F.struct(*[F.lit(k).alias(f"o{i}") for i, k in enumerate(o)]) for o in forward])).alias("o")
    left = renamed(here, "a").select("*", step)
    pairs = left.join(renamed(here, "b"), [F.col(f"b_s{i}") == F.col(f"a_s{i}") + F.col(f"o.o{i}") for i in range(dims)]).drop("o")
    while True:
        apart, across = F.lit(0.0), F.lit(0.0)
        for i in range(dims):
            gap = F.greatest(F.lit(0.0), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"))
            reach = F.greatest(F.col(f"b_hi{i}") - F.col(f"a_lo{i}"), F.col(f"a_hi{i}") - F.col(f"b_lo{i}"))
            apart, across = apart + gap * gap, across + reach * reach
        seen = stored(pairs.where(apart <= near * (1 + 1e-12)).withColumn("sure", across <= near * (1 - 1e-12)).withColumn("few", F.col("a_n") * F.col("b_n") <= _PAIRS))
        found = seen.where("sure").select("a_head", "b_head").distinct()
        subs = [F.floor(F.col(f"y{i}") * (1 << level)).alias(f"s{i}") for i in range(dims)]
        placed = places.select("head", *axes, *subs)
        unsure = seen.join(found, ["a_head", "b_head"], "left_anti")
        few = unsure.where("few").select("a_head", "b_head", *[f"{m}_s{i}" for m in "ab" for i in range(dims)])
        both = few.join(renamed(placed, "a"), ["a_head", *[f"a_s{i}" for i in range(dims)]]).join(renamed(placed, "b"), ["b_head", *[f"b_s{i}" for i in range(dims)]])
        compared = both.where(_squared([F.col(f"a_{a}") for a in axes], [F.col(f"b_{a}") for a in axes]) <= near).select("a_head", "b_head")
        found = stored(found.unionByName(compared).distinct())
        met = found if met is None else stored(met.unionByName(found))
        open_pairs = stored(unsure.where(~F.col("few")).join(found, ["a_head", "b_head"], "left_anti"))
        if open_pairs.isEmpty():
            return met.toDF("u", "v")
        level += 1
        here = stored(boxes(level))
        up = [F.floor(F.col(f"s{i}") / 2) for i in range(dims)]
        inner = here.select("*", *[u.alias(f"p{i}") for i, u in enumerate(up)])
        parents = open_pairs.select("a_head", "b_head", *[F.col(f"{m}_s{i}").alias(f"{m}_p{i}") for m in "ab" for i in range(dims)])
        pairs = parents.join(renamed(inner, "a"), ["a_head", *[f"a_p{i}" for i in range(dims)]]).join(renamed(inner, "b"), ["b_head", *[f"b_p{i}" for i in range(dims)]])
        pairs = pairs.drop(*[f"{m}_p{i}" for m in "ab" for i in range(dims)])
