import random

import pytest

from sievemill.operators import density


def brute(rows, eps, min_pts):
    fine = [r for r in rows if all(x is not None and abs(x) < 1e300 for x in r[1:])]
    beside = {a[0]: [b[0] for b in fine if sum((x - y) * (x - y) for x, y in zip(a[1:], b[1:])) <= eps * eps] for a in fine}
    core = {k for k, v in beside.items() if len(v) >= min_pts}
    cluster = {}
    for k in sorted(core):
        stack = [k] if k not in cluster else []
        while stack:
            at = stack.pop()
            if at not in cluster:
                cluster[at] = k
                stack.extend(b for b in beside[at] if b in core)
    out = {}
    for r in rows:
        k = r[0]
        names = [cluster[b] for b in beside.get(k, ()) if b in core]
        out[k] = (k in core, cluster[k] if k in core else min(names, default=None))
    return out


def clouds(seed, n, dims, spread):
    gen = random.Random(seed)
    middles = [[gen.uniform(0, 10) for _ in range(dims)] for _ in range(6)]
    rows = [(i, *[gen.gauss(m, spread) for m in gen.choice(middles)]) for i in range(n)]
    rows += [(n + i, *[gen.uniform(0, 10) for _ in range(dims)]) for i in range(n // 4)]
    rows += [(2 * n + i, *[1.5] * dims) for i in range(30)]  # equal points
    return rows


@pytest.mark.parametrize("dims, eps, min_pts, small", [(1, 0.1, 4, False), (2, 0.35, 5, False), (2, 0.35, 5, True), (2, 1.2, 12, True), (3, 0.8, 6, True)])
def test_equals_brute_force(spark, monkeypatch, dims, eps, min_pts, small):
    if small:  # cells are dealt over parts, and boxes are halved
        monkeypatch.setattr(density, "_PART", 3)
        monkeypatch.setattr(density, "_PAIRS", 4)
    rows = clouds(dims, 220, dims, 0.4)
    rows += [(9000, None, *[1.0] * (dims - 1)), (9001, float("nan"), *[1.0] * (dims - 1)), (9002, float("inf"), *[1.0] * (dims - 1))]
    df = spark.createDataFrame(rows, ", ".join(["id long", *[f"v{i} double" for i in range(dims)]]))
    got = {r["id"]: (r["core"], r["cluster"]) for r in density.dbscan(df, "id", [f"v{i}" for i in range(dims)], eps, min_pts).collect()}
    want = brute(rows, eps, min_pts)
    assert got == want
    assert len({c for _, c in want.values()}) > 2


def test_two_crowded_cells_are_not_compared_point_by_point(spark, monkeypatch):
    gen = random.Random(2)
    rows = [(i, gen.uniform(0, 0.69), gen.uniform(0, 0.69)) for i in range(3000)] + [(5000 + i, gen.uniform(0.72, 1.4), gen.uniform(0, 0.69)) for i in range(3000)]
    rows += [(9000 + i, 2.41 + gen.uniform(0, 0.5), 0.3) for i in range(500)]  # over 1 away from the second
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = density.dbscan(df, "id", ["x", "y"], 1.0, 10).groupBy("cluster").count().collect()
    assert {(r["cluster"], r["count"]) for r in got} == {(0, 6000), (9000, 500)}


def test_nothing(spark):
    df = spark.createDataFrame([], "id long, x double")
    assert density.dbscan(df, "id", ["x"], 1.0, 3).collect() == []
