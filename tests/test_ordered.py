import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemill.operators import ordered as O


@pytest.fixture(params=["plain", "split"])
def form(request):
    if request.param == "split":
        request.getfixturevalue("small_limits")
    return request.param


def frame(spark, n=150, hot=0.6, seed=1):
    gen = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if gen.random() < hot else gen.choice(["a", "b", None])
        v = gen.choice([None, float(gen.randint(0, 9)), None])
        rows.append((i, g, gen.randint(0, 40), v))
    return spark.createDataFrame(rows, "id long, g string, t int, v double"), pd.DataFrame(rows, columns=["id", "g", "t", "v"])


def test_scan_matches_pandas(spark, form):
    df, pdf = frame(spark)
    out = O.ordered_scan(
        df, ["t", "id"], ["g"], sums={"s": F.coalesce(F.col("v"), F.lit(0.0))}, last={"l": "v"}, following={"f": "v"}, lag={"p": "v"}, number="n",
    ).toPandas().set_index("id")
    pdf = pdf.assign(k=pdf["g"].fillna("~")).sort_values(["k", "t", "id"])
    grouped = pdf.groupby("k")["v"]
    want = pd.DataFrame({
        "id": pdf["id"], "s": pdf["v"].fillna(0).groupby(pdf["k"]).cumsum(), "l": grouped.ffill(), "f": grouped.bfill(), "p": grouped.shift(),
        "n": pdf.groupby("k").cumcount() + 1,
    }).set_index("id")
    for c in ["s", "l", "f", "p", "n"]:
        pd.testing.assert_series_equal(out[c].sort_index().astype(float), want[c].sort_index().astype(float), check_names=False)


def test_scan_without_groups(spark, form):
    df, pdf = frame(spark, 60)
    out = O.ordered_scan(df, ["t", "id"], number="n").toPandas().sort_values("n")
    assert list(out["id"]) == list(pdf.sort_values(["t", "id"])["id"])


def test_lag_keeps_nulls_across_chunks(spark, small_limits):
    df = spark.createDataFrame([(i, None if i % 2 else i) for i in range(40)], "id int, v int")
    out = {r["id"]: r["p"] for r in O.ordered_scan(df, ["id"], lag={"p": "v"}).collect()}
    assert out[0] is None and all(out[i] == (None if (i - 1) % 2 else i - 1) for i in range(1, 40))


def test_fill_all_null_group(spark, form):
    df = spark.createDataFrame([(i, None) for i in range(30)], "id int, v double")
    assert {r["v"] for r in O.ffill(df, ["v"], ["id"]).collect()} == {None}


def test_interpolate_matches_pandas(spark, form):
    values = [None, 2.0, None, None, 8.0, None, 1.0, None, None] * 4
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = [r["v"] for r in O.interpolate(df, ["v"], ["id"]).orderBy("id").collect()]
    want = pd.Series(values, dtype=float).interpolate("linear", limit_direction="both")
    assert np.allclose(got, want)


def test_ema_is_the_recurrence(spark, form):
    gen = random.Random(3)
    rows = [(i, gen.choice("ab"), gen.random() * 100) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    got = {r["id"]: r["ema"] for r in O.ema(df, "v", 0.1, ["id"], ["g"]).collect()}
    state = {}
    for i, g, v in rows:
        state[g] = v if g not in state else 0.9 * state[g] + 0.1 * v
        assert math.isclose(got[i], state[g], rel_tol=1e-9)


@pytest.mark.parametrize("seconds,name", [(1, "second"), (60, "minute"), (3600, "hour"), (86400, "daily"), (7 * 86400, "weekly"), (31 * 86400, "monthly"), (400 * 86400, "yearly")])
def test_frequency_ladder(spark, seconds, name):
    df = spark.range(5).select(F.timestamp_seconds(F.col("id") * seconds).alias("ts"))
    row = O.temporal_frequency(df, "ts").first()
    assert row["frequency"] == name and row["interval"] == seconds
    assert O.regular_series(df, "ts").first()["is_regular"]


def test_latest_keeps_one_row_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "k int, t int, v string")
    assert {(r["k"], r["v"]) for r in O.latest(df, ["k"], ["t"]).collect()} == {(1, "b"), (2, "c")}


def test_heavy_rows_split_a_group_of_few_rows(spark):
    df, pdf = frame(spark, 80)
    wide = df.withColumn("text", F.repeat(F.lit("x"), 500)).withColumn("many", F.sequence(F.lit(1), F.lit(50)))
    assert 80 * 600 < O.group_weights(wide, [])[2] < 80 * 1200
    spark.conf.set("sievemill.groupBytes", "20000")
    spark.conf.set("sievemill.chunkBytes", "9000")
    try:
        out = O.ordered_scan(wide, ["t", "id"], number="n")
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
        got = [r["id"] for r in out.orderBy("n").collect()]
    finally:
        spark.conf.unset("sievemill.groupBytes")
        spark.conf.unset("sievemill.chunkBytes")
    # what one task still holds is a row per chunk
    assert all("HashAggregate" in below for line, below in zip(plan, plan[1:]) if "SinglePartition" in line)
    assert out.columns == [*wide.columns, "n"]
    assert got == list(pdf.sort_values(["t", "id"])["id"])


def test_weights_of_an_empty_table(spark):
    df, _ = frame(spark, 5)
    assert O.group_weights(df.where("false"), ["g"]) == (0, 0, 0, 0) == O.group_weights(df.where("false"), [])
