import math
import random

import numpy as np
import pytest

from sievemill.operators.quantiles import exact_quantiles, grouped_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def sample(kind, n=400):
    gen = random.Random(kind)
    if kind == "skewed":  # a third of all rows hold one value
        return [7.0 if gen.random() < 0.34 else gen.lognormvariate(0, 4) for _ in range(n)]
    if kind == "wide":
        return [gen.choice([-1, 1]) * 10 ** gen.uniform(-300, 300) for _ in range(n)]
    if kind == "constant":
        return [3.5] * n
    return [gen.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("kind", ["normal", "skewed", "wide", "constant"])
@pytest.mark.parametrize("split", [False, True])
def test_exact(spark, request, kind, split):
    if split:
        request.getfixturevalue("small_limits")
    values = sample(kind)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = exact_quantiles(df, ["v"], PROBS)["v"]
    want = np.quantile(np.array(values), PROBS)
    assert np.allclose(got, want, rtol=1e-9)


def test_all_null(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "v double"), ["v"], [0.5]) == {"v": [None]}


@pytest.mark.parametrize("split", [False, True])
def test_grouped(spark, request, split):
    if split:
        request.getfixturevalue("small_limits")
    gen = random.Random(5)
    rows = [("hot" if gen.random() < 0.6 else gen.choice(["a", "b", None]), float(gen.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["m"], r["p95"]) for r in grouped_quantiles(df, ["g"], "v", {"m": 0.5, "p95": 0.95}).collect()}
    for g in {r[0] for r in rows}:
        mine = [v for k, v in rows if k == g]
        assert np.allclose(got[g], np.quantile(mine, [0.5, 0.95]))


def columns_of(n, rows=600):
    gen = random.Random(n)
    special = [float("inf"), float("-inf"), float("nan"), None]
    return [[gen.choice(special) if gen.random() < 0.02 else gen.gauss(i, 10.0**i) for _ in range(rows)] for i in range(n)]


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_wide_columns_share_their_passes(spark, small_limits):
    found = {}
    for n in (1, 6):
        data = columns_of(n)
        names = [f"c{i}" for i in range(n)]
        df = spark.createDataFrame(list(zip(*data)), ", ".join(f"{c} double" for c in names))
        got, found[n] = jobs_of(spark, f"quantiles-{n}", lambda: exact_quantiles(df, names, PROBS))
        for c, values in zip(names, data):
            # Spark's order: NaN is the largest
            ordered = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
            for p, q in zip(PROBS, got[c]):
                at = p * (len(ordered) - 1)
                a, b, share = ordered[math.floor(at)], ordered[math.ceil(at)], at - math.floor(at)
                want = a if a == b or share == 0 else a + (b - a) * share
                assert (math.isnan(q) and math.isnan(want)) or q == pytest.approx(want, rel=1e-9)
    assert found[6] <= found[1] + 6  # a level more, not a run per column
