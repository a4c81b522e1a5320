import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.functions.similarity import lcs_length, ratio
from sievemill.operators import clean as K
from sievemill.operators import relational as R
from sievemill.operators.forest import isolation_forest


def test_first_duplicate_stays(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", "x"), (2, "b", None), (4, "b", None)], "id int, k string, v string")
    assert {(r["id"], r["v"]) for r in K.drop_duplicates(df, ["k"], ["id"]).collect()} == {(1, "x"), (2, None)}


def test_types_are_converted_only_when_all_parse(spark):
    df = spark.createDataFrame([("1", "1.5", "2024-01-05", "12", "2024-01-01"), ("2", None, "2024-02-29", "abc", "2024-02-30")], "a string, b string, c string, d string, e string")
    out = K.convert_types(df)
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "timestamp", "d": "string", "e": "string"}


def test_missing_strategies(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, None, "a"), (3, 4.0, "a"), (4, 10.0, None), (5, None, "b")], "id int, v double, s string")
    pick = lambda out, c: [r[c] for r in out.orderBy("id").collect()]
    assert pick(K.fill_missing(df, "remove"), "id") == [1, 3]
    assert pick(K.fill_missing(df, "mean", ["v"]), "v") == [1, 5, 4, 10, 5]
    assert pick(K.fill_missing(df, "median", ["v"]), "v") == [1, 4, 4, 10, 4]
    assert pick(K.fill_missing(df, "mode"), "s") == ["b", "a", "a", "a", "b"]  # the smaller of two equally frequent
    assert pick(K.fill_missing(df, "forward", order=["id"]), "v") == [1, 1, 4, 10, 10]
    assert pick(K.fill_missing(df, "backward", order=["id"]), "v") == [1, 4, 4, 10, None]
    assert pick(K.fill_missing(df, "interpolate", ["v"], order=["id"]), "v") == [1, 2.5, 4, 10, 10]
    assert pick(K.fill_missing(df, "custom", ["v"], value=7), "v") == [1, 7, 4, 10, 7]
    drawn = pick(K.fill_missing(df, "random_existing", ["v"], key="id"), "v")
    assert set(drawn) <= {1.0, 4.0, 10.0} and drawn[0] == 1
    ranged = pick(K.fill_missing(df, "random_range", ["v"], key="id", low=100, high=101), "v")
    assert 100 <= ranged[1] <= 101 and ranged[2] == 4


def test_numbering_and_dates(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, "2020-01-01"), (3, None, None)], "k int, id int, d string").withColumn("d", F.col("d").cast("date"))
    assert [r["id"] for r in K.fill_missing(df, "sequence", ["id"], key="k").orderBy("k").collect()] == [5, 6, 7]
    assert str(K.fill_missing(df, "current_date", ["d"], as_of="2024-05-05").orderBy("k").first()["d"]) == "2024-05-05"


def test_standardize_touches_only_matching_columns(spark):
    rows = [(" A@X.COM ", "(555) 123-4567", "12 Main St", "1,234.50"), ("b@y.org", "+1 555-000-1111", "3 Oak Ave", "7"), ("not mail", "n/a", " 9 Elm St ", "x")]
    df = spark.createDataFrame(rows, "mail string, phone string, addr string, amt string")
    got = K.standardize(df, numbers=["amt"]).collect()
    assert [r["mail"] for r in got] == ["a@x.com", "b@y.org", "not mail"]
    assert [r["phone"] for r in got] == ["5551234567", "+15550001111", "n/a"]
    assert [r["addr"] for r in got] == ["12 Main St", "3 Oak Ave", "9 Elm St"]
    assert [r["amt"] for r in got] == ["1234.50", "7", "x"]


def test_winsorising_needs_an_outlier(spark):
    calm = spark.createDataFrame([(float(i % 10),) for i in range(100)], "v double")
    out, counts = K.cap_outliers(calm)
    assert counts == {"v": 0} and out.agg(F.max("v")).first()[0] == 9
    wild = calm.unionByName(spark.createDataFrame([(1e6,)], "v double"))
    out, counts = K.cap_outliers(wild)
    assert counts == {"v": 1} and out.agg(F.max("v")).first()[0] == 9


def test_quartile_edges_collapse(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 60 + list(range(1, 21))], "v double")
    got = {r["v_quartile"] for r in K.enrich_quartiles(df).collect()}
    assert got == {"Q1", "Q2"}  # 0, 0, 0, .. and the maximum are the only edges
    few = spark.createDataFrame([(float(i % 5),) for i in range(50)], "v double")
    assert K.enrich_quartiles(few).columns == ["v"]


def test_scaling_without_spread_changes_nothing(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    for how in ("zscore", "minmax", "robust"):
        assert [r["v"] for r in K.scale(df, ["v"], how).collect()] == [3.0, 3.0]
    logs = K.scale(spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (None,)], "v double"), ["v"], "log")
    assert [r["v"] for r in logs.collect()] == [0.0, 0.0, float(np.log(2)), None]


def test_labels_follow_sorted_values(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "s string")
    assert [r["s"] for r in K.transform_columns(df).collect()] == [1, 0, 2, None]


def test_column_names():
    from types import SimpleNamespace
    seen = {}
    df = SimpleNamespace(columns=["FName", "E-Mail ", "fname", "Zip  Code!"], toDF=lambda *n: seen.setdefault("n", n))
    R.map_columns(df)
    assert seen["n"] == ("first_name", "email", "first_name_2", "zip_code")


@pytest.mark.parametrize("split", [False, True])
def test_rolling_flags_match_pandas(spark, request, split):
    if split:
        request.getfixturevalue("small_limits")
    import pandas as pd
    values = [float((i * 37) % 11) for i in range(1300)]
    values[700] = 500.0
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = {r["id"] for r in K.flag_anomalies(df, "v", "rolling", order=["id"]).where("_anomaly").collect()}
    s = pd.Series(values)
    past = s.shift().rolling(20)
    want = set(np.flatnonzero(((s - past.mean()).abs() / past.std() > 3).to_numpy()))
    assert got == want and 700 in got


def test_forest_finds_planted_outliers(spark):
    rows = [(i, float(i % 10), float((i * 7) % 10)) for i in range(400)] + [(1000 + i, 500.0 + i * 50, -400.0) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    out = isolation_forest(df, ["x", "y"], "id", trees=40, contamination=0.05)
    top = {r["id"] for r in out.orderBy(F.desc("_score")).limit(8).collect()}
    assert top == set(range(1000, 1008))
    flagged = out.where("_anomaly_score = -1").count()
    assert 8 <= flagged <= 0.05 * 408 + 1
    again = isolation_forest(df.repartition(7), ["x", "y"], "id", trees=40, contamination=0.05)
    assert {(r["id"], round(r["_score"], 12)) for r in out.collect()} == {(r["id"], round(r["_score"], 12)) for r in again.collect()}


def test_lcs_against_table():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    import random
    gen = random.Random(1)
    for _ in range(200):
        a, b = ("".join(gen.choice("abcé") for _ in range(gen.randint(0, 90))) for _ in range(2))
        assert lcs_length(a, b) == slow(a, b)
    assert ratio("", "") == 100 and ratio("abc", "") == 0 and ratio(None, None) == 100


def test_band_decides_like_the_full_table():
    import random

    from sievemill.functions.similarity import lcs_reaches, over_threshold
    gen = random.Random(7)
    for i in range(600):
        n = gen.choice([0, 1, 5, 60, 400, 1500])
        a = "".join(gen.choice("abcdé") for _ in range(n))
        b = list(a)
        for _ in range(gen.randint(0, max(1, n // 4))):
            at = gen.randrange(len(b) + 1)
            gen.choice([lambda: b.insert(at, gen.choice("abcdx")), lambda: b and b.pop(min(at, len(b) - 1)), lambda: b and b.__setitem__(min(at, len(b) - 1), "z")])()
        b = "".join(b) if i % 5 else "".join(gen.choice("abcd") for _ in range(gen.randint(0, n + 3)))
        best = lcs_length(a, b)
        for need in {0, best - 1, best, best + 1, best + 7}:
            assert lcs_reaches(a, b, need) == (best >= need)
        for percent in (50, 80, 90, 95):
            assert over_threshold(a, b, percent) == (ratio(a, b) > percent)
