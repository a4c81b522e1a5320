import random

import pytest

from sievemill.operators.closeness import ordered_distances, t_close_ordered


def plain(rows):
    """Ordered distance of each class by its definition."""
    known = [(q, v + 0.0) for q, v in rows if v is not None and v == v]
    values = sorted({v for _, v in known})
    out = {}
    for q in {q for q, _ in rows}:
        own = [v for p, v in known if p == q]
        if not own:
            out[q] = None
            continue
        gaps = [abs(sum(v <= x for v in own) / len(own) - sum(v <= x for _, v in known) / len(known)) for x in values]
        out[q] = sum(gaps) / (len(values) - 1) if len(values) > 1 else 0.0
    return out


def told(spark, rows):
    df = spark.createDataFrame(rows, "q string, v double")
    return {r["_q_q"]: r["_t"] for r in ordered_distances(df, ["q"], "v").collect()}


def rows_of(seed, n=160):
    draw = random.Random(seed)
    made = [(draw.choice(["hot", "hot", "a", "b", None]), draw.choice([None, float("nan"), -0.0, 0.0, *map(float, range(-12, 12))])) for _ in range(n)]
    return [*made, ("low", -50.0), ("high", 50.0), ("none", None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_distance_equals_its_definition(spark, seed):
    rows = rows_of(seed)
    assert told(spark, rows) == pytest.approx(plain(rows), abs=1e-12)


def test_distance_with_split_scans(spark, small_limits):
    rows = rows_of(4)
    assert told(spark, rows) == pytest.approx(plain(rows), abs=1e-12)


@pytest.mark.parametrize("rows", [[], [("a", None)], [("a", 3.0), ("b", 3.0), ("c", None)], [("a", 1.0), ("b", 2.0)]])
def test_few_values(spark, rows):
    assert told(spark, rows) == plain(rows)


def test_rows_of_near_classes_stay(spark):
    rows = [("near", float(i)) for i in range(10)] * 3 + [("far", 0.0)] * 3 + [("none", None)]
    df = spark.createDataFrame(rows, "q string, v double")
    assert {r["q"] for r in t_close_ordered(df, ["q"], "v", 0.2).collect()} == {"near"}
