"""Results do not hang on sizes: what used to be cut, capped or switched."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievemill.operators import clean as K
from sievemill.operators import dedup as D
from sievemill.operators import patterns as A
from sievemill.operators.forest import isolation_forest
from sievemill.operators.neighbours import knn
from sievemill.operators.ordered import ema
from sievemill.operators.quantiles import exact_quantiles
from sievemill.plans import workflow as W
from sievemill.synthesis import generate as G
from sievemill.synthesis import templates as T
from sievemill.synthesis.draw import Draw


@pytest.mark.parametrize("part", [10_000, 16])
def test_noisy_copies_leave_one(spark, monkeypatch, part):
    monkeypatch.setattr(D, "_PART", part)
    gen = random.Random(2)
    base = "".join(gen.choice("abcdefghijklmnop ") for _ in range(400))
    rows = []
    for i in range(200):
        text = list(base)
        for _ in range(4):
            text[gen.randrange(400)] = gen.choice("abcdefghijklmnop ")
        rows.append((i, "".join(text)))
    df = spark.createDataFrame(rows, "id long, t string")
    assert [r["id"] for r in D.fuzzy_dedup(df, "id", ["t"]).collect()] == [0]


def test_all_categories_come_back(spark):
    df = spark.range(4000).select(F.concat(F.lit("c"), F.col("id") % 40).alias("kind"), (F.col("id") % 7 * 1.5).alias("x"))
    learned = A.learn(df)
    assert learned["patterns"]["kind"]["type"] == "categorical" and set(learned["frequencies"]) == {"kind"}
    made = G.generate(spark.range(4000), "id", learned)
    assert made.select("kind").distinct().count() == 40


def test_dependent_categories_come_back(spark):
    df = spark.range(4000).select((F.col("id") % 200).cast("int").alias("a"), F.concat(F.lit("c"), F.col("id") % 40).alias("kind"))
    learned = A.learn(df)
    assert ("a", "kind") in learned["dependencies"]
    made = G.generate(spark.range(6000), "id", learned)
    assert made.select("kind").distinct().count() > 10
    assert made.groupBy("a").agg(F.count_distinct("kind").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("limit", ["5", "200000"])
@pytest.mark.parametrize("extra", [[float("nan")], [float("inf"), float("-inf")], [float("nan")] * 30 + [float("inf")] * 30 + [float("-inf")] * 30])
def test_quantiles_with_odd_numbers(spark, limit, extra):
    values = [float(i % 50) + 0.25 for i in range(120)] + extra
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    spark.conf.set("sievemill.percentileValues", limit)
    try:
        got = exact_quantiles(df, ["v"], probs)["v"]
    finally:
        spark.conf.unset("sievemill.percentileValues")
    order = sorted(values, key=lambda v: (math.isnan(v), v))
    for p, g in zip(probs, got):
        at = p * (len(order) - 1)
        a, b, share = order[math.floor(at)], order[math.ceil(at)], at - math.floor(at)
        want = a if a == b or share == 0 else (1 - share) * a + share * b
        assert (math.isnan(g) and math.isnan(want)) or g == want or abs(g - want) < 1e-9


def test_every_row_may_be_in_a_tree(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 97).cast("double").alias("x"))
    out = isolation_forest(df.union(spark.createDataFrame([(99_999, 5000.0)], "id long, x double")), ["x"], "id", trees=30, sample=200, contamination=0.001)
    assert out.orderBy(F.desc("_score")).first()["id"] == 99_999


def test_saturdays_stay_three_times_in_ten(spark):
    days = spark.range(20_000).select(F.weekday(T.business_moment(Draw(1, F.col("id")), "m", "2024-12-31")).alias("d"))
    n = {r["d"]: r["count"] for r in days.groupBy("d").count().collect()}
    whole = 20_000 / 7
    assert abs(n[5] - (0.3 * whole + 0.7 * 0.5 * 0.3 * whole)) < 0.15 * whole and abs(n[6] - 0.3 * whole) < 0.06 * whole


def test_ema_of_the_value_alone(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0)], "t long, v double")
    assert [r["ema"] for r in ema(df, "v", 1.0, ["t"]).orderBy("t").collect()] == [2.0, 5.0]


def test_no_clock(spark):
    with pytest.raises(ValueError):
        K.fill_missing(spark.createDataFrame([(1, None)], "k int, d date"), "current_date", ["d"])


def test_rows_that_differ_in_the_key_are_no_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a")], "id long, t string")
    assert W.clean(df, W.CleaningConfig(key="id", validate_types=False), quality=False)[0].count() == 2
    assert W.clean(df, W.CleaningConfig(key="id", validate_types=False, duplicate_columns=("t",)), quality=False)[0].count() == 1


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_every_test_row_is_answered(spark, task):
    train = spark.createDataFrame([(1, 0.0, 1), (2, 1.0, 2), (3, None, 2)], "id long, x double, c int")
    test = spark.createDataFrame([(7, 0.1), (8, None), (9, float("nan"))], "tid long, x double")
    got = {r["tid"]: r["prediction"] for r in knn(train, test, ["x"], "c", "id", "tid", 1, task).collect()}
    assert got == {7: 1, 8: None, 9: None}
