import math

import pytest
from pyspark.sql import functions as F

from sievemill.operators import privacy as V


def test_names():
    assert V.pii_columns(["Email", "id", "dob", "City"]) == ["Email", "dob"]
    assert V.phi_columns(["patient_no", "x", "Medical"]) == ["patient_no", "Medical"]


@pytest.mark.parametrize("pan,want", [
    ("4111111111111111", "4111********1111"), ("4111-1111-1111-1111", "4111***********1111"), ("4111 1111 1111 1111", "4111***********1111"),
    ("123456789012", "123456789012"), ("1" * 20, "1" * 20), ("text", "text"), (None, None), ("1" * 13, "1111*****1111"),
])
def test_card_mask(spark, pan, want):
    assert V.mask_cards(spark.createDataFrame([(pan,)], "pan string")).first()["pan"] == want


def test_card_mask_with_check_digit(spark):
    df = spark.createDataFrame([("4111111111111111",), ("4111111111111112",)], "pan string")
    assert [r["pan"] for r in V.mask_cards(df, luhn=True).collect()] == ["4111********1111", "4111111111111112"]


def test_pseudonyms_keep_nulls(spark):
    import hashlib
    df = spark.createDataFrame([("Ann",), (None,)], "name string")
    assert [r["name"] for r in V.pseudonymize(df).collect()] == [hashlib.sha256(b"Ann").hexdigest()[:8], None]


def qi(spark, n=300):
    return spark.range(n).select(F.col("id"), (F.col("id") * 7919 % 90).cast("int").alias("age"), F.concat(F.lit("z"), F.col("id") % 11).alias("zipcode"),
                                 F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 40)).alias("disease"))


@pytest.mark.parametrize("k", [2, 5, 20])
def test_every_class_has_k_rows(spark, k):
    out = V.k_anonymize(qi(spark).drop("id"), k)
    smallest = out.groupBy("age", "zipcode").count().agg(F.min("count")).first()[0]
    assert smallest is None or smallest >= k


def test_null_identifiers_are_a_class(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4), ("b", 5)], "gender string, v int")
    out = V.suppress(df, ["gender"], F.count(F.lit(1)) >= 2)
    assert {r["v"] for r in out.collect()} == {1, 2, 4, 5}


def test_generalised_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in range(0, 101)], "x double")
    bins = {r["x"]: r["n"] for r in V.generalize(df, 10, ["x"]).groupBy("x").count().withColumnRenamed("count", "n").collect()}
    assert bins[0] == 11 and all(bins[i] == 10 for i in range(1, 10))


def test_diversity_and_closeness(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 1), ("c", 2)], "q string, s int")
    assert {r["q"] for r in V.l_diversify(df, ["q"], "s", 2).collect()} == {"a", "c"}
    # the table holds 2/3 ones; a and c hold 1/2: distance 1/6, b holds all: 1/3
    assert {r["q"] for r in V.t_close(df, ["q"], "s", 0.2).collect()} == {"a", "c"}
    assert V.t_close(df, ["q"], "s", 0.34).count() == 6


def test_laplace_noise_has_its_scale(spark):
    df = spark.range(20000).select("id", F.lit(50.0).alias("v"))
    out = V.laplace_noise(df, ["v"], 2.0, "id", bounds={"v": (0.0, 100.0)})
    row = out.select((F.col("v") - 50).alias("e")).agg(F.avg("e").alias("m"), F.avg(F.abs("e")).alias("a")).first()
    assert abs(row["m"]) < 3 and math.isclose(row["a"], 50, rel_tol=0.05)
    clipped = V.laplace_noise(df, ["v"], 0.1, "id", bounds={"v": (0.0, 100.0)}, clip=True).agg(F.min("v"), F.max("v")).first()
    assert clipped[0] == 0 and clipped[1] == 100


@pytest.mark.parametrize("split", [False, True])
def test_randomised_response_rate(spark, request, split):
    if split:
        request.getfixturevalue("small_limits")
    n = 2000 if split else 20000
    df = spark.range(n).select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), (F.col("id") % 4 + 1).cast("int")).alias("s"))
    out = V.randomized_response(df, ["s"], 1.0, "id").join(df.withColumnRenamed("s", "o"), "id")
    kept = out.where("s = o").count() / n
    p = math.e / (math.e + 3)
    assert abs(kept - (p + (1 - p) / 4)) < 4 * math.sqrt(0.25 / n)


def test_noise_does_not_depend_on_partitions(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("v"))
    a = V.laplace_noise(df, ["v"], 1.0, "id").orderBy("id").collect()
    assert a == V.laplace_noise(df.repartition(9), ["v"], 1.0, "id").orderBy("id").collect()


def test_presets(spark):
    df = spark.createDataFrame([(i, f"n{i}", "4111111111111111", i % 2, f"s{i % 4}") for i in range(40)], "id long, name string, card string, age int, diagnosis string")
    out = V.apply_compliance(df, ["hipaa"], qi=["age"], sensitive="diagnosis", key="id")
    assert len(out.first()["name"]) == 8 and out.first()["card"] == "4111********1111"
    fin = V.apply_compliance(df, ["finance"], qi=["age"])
    assert fin.first()["card"] == "4111********1111" and fin.first()["name"] == "n0"
