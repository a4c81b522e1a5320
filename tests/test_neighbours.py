import random

import numpy as np
import pytest

from sievemill.operators import neighbours as N
from sievemill.operators.neighbours import knn


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_equals_brute_force_with_a_crowded_spot(spark, task):
    gen = random.Random(3)
    train = []
    for i in range(400):
        x, y = (1.0, 1.0) if i % 3 == 0 else (gen.uniform(0, 10), gen.uniform(0, 10))
        train.append((i, x, y, gen.randint(0, 2)))
    test = [(i, gen.uniform(-2, 12), gen.uniform(-2, 12)) for i in range(60)] + [(99, 1.0, 1.0)]
    df = spark.createDataFrame(train, "id long, x double, y double, c int")
    out = knn(df, spark.createDataFrame(test, "tid long, x double, y double"), ["x", "y"], "c", "id", "tid", 5, task, leaf=25)
    got = {r["tid"]: r["prediction"] for r in out.collect()}
    # equal points with one label act together, in the order of their first row
    first = {}
    for i, x, y, c in train:
        first.setdefault((x, y, c), i)
    for tid, x, y in test:
        near = sorted(train, key=lambda r: ((r[1] - x) ** 2 + (r[2] - y) ** 2, first[r[1:]]))[:5]
        labels = [r[3] for r in near]
        if task == "regression":
            assert abs(got[tid] - sum(labels) / 5) < 1e-9
        else:
            assert got[tid] == min(set(labels), key=lambda c: (-labels.count(c), c))


def test_many_blocks_and_parts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "_BLOCK", 60)
    monkeypatch.setattr(N, "_PART", 7)
    gen = random.Random(5)
    train = [(i, gen.gauss(0, 1), gen.gauss(0, 1), gen.choice("abc")) for i in range(900)]
    test = [(i, gen.gauss(0, 1), gen.gauss(0, 1)) for i in range(80)] + [(100 + i, 0.1, 0.1) for i in range(30)] + [(200, 50.0, 50.0)]
    out = knn(spark.createDataFrame(train, "id long, x double, y double, c string"), spark.createDataFrame(test, "tid long, x double, y double"),
              ["x", "y"], "c", "id", "tid", 5, leaf=20)
    want = {}
    for tid, x, y in test:
        labels = [r[3] for r in sorted(train, key=lambda r: ((r[1] - x) ** 2 + (r[2] - y) ** 2, r[0]))[:5]]
        want[tid] = min(set(labels), key=lambda c: (-labels.count(c), c))
    assert {r["tid"]: r["prediction"] for r in out.collect()} == want


def test_a_row_meets_few_of_many_leaves(spark):
    points = spark.range(20_000).selectExpr("rand(3) as x", "rand(4) as y", "0 as _label", "1L as _weight").cache()
    tree, boxes = N._grow(points, ["x", "y"], 20, 20_000)
    assert len(boxes) >= 1000 and boxes["n"].sum() == 20_000
    index = N._Index(tree, boxes, 2)
    x = np.random.default_rng(1).random((500, 2))
    _, radius = index.home(x, 5)
    rows, _ = index.reach(x, radius)
    assert len(rows) / 500 < 60
    # at the distance of the fifth point, as after the search of the own leaf
    rows, _ = index.reach(x, np.full(500, 5 / 20_000))
    assert 1 <= len(rows) / 500 < 8
