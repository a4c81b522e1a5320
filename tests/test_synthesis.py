import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.operators.patterns import learn
from sievemill.operators.profile import validate_formats
from sievemill.synthesis import generate as G
from sievemill.synthesis import templates as T
from sievemill.synthesis.draw import Draw, normal_cdf, rows

N = 20000


def close(got, want, std, n=N):
    assert abs(got - want) < 4.5 * std / math.sqrt(n)


def test_moments(spark):
    d = Draw(42, F.col("_id"))
    df = rows(spark, N).select(d.normal("n", 5, 2).alias("n"), d.real("u", 0, 10).alias("u"), d.exponential("e", 3).alias("e"), d.beta("b", 2, 5).alias("b"),
                               d.geometric("g", 0.6).alias("g"), d.lognormal("l", 0, 0.5).alias("l"), d.integer("i", 1, 6).alias("i"))
    m = df.agg(*[F.avg(c).alias(c) for c in df.columns]).first()
    s = df.agg(*[F.stddev(c).alias(c) for c in df.columns]).first()
    for c, mean, std in (("n", 5, 2), ("u", 5, 10 / 12**0.5), ("e", 3, 3), ("b", 2 / 7, (10 / (49 * 8)) ** 0.5), ("g", 1 / 0.6, 0.4**0.5 / 0.6), ("l", math.exp(0.125), 0.6), ("i", 3.5, 1.71)):
        close(m[c], mean, std)
    assert math.isclose(s["n"], 2, rel_tol=0.05) and df.agg(F.min("i"), F.max("i")).first()[:] == (1, 6)


def test_frequencies(spark):
    d = Draw(1, F.col("_id"))
    df = rows(spark, N).select(G.gen_categorical(d, "c", {"categories": {"a": 40, "b": 30, "c": 20, "d": 10}}).alias("c"))
    for r in df.groupBy("c").count().collect():
        close(r["count"] / N, {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}[r["c"]], 0.5)


def test_partitions_do_not_matter(spark):
    base = rows(spark, 500)
    a = T.generate_domain(base, "_id", "ecommerce", 500).orderBy("order_id").collect()
    b = T.generate_domain(base.repartition(13), "_id", "ecommerce", 500).orderBy("order_id").collect()
    assert a == b
    assert T.generate_domain(base, "_id", "ecommerce", 500, seed=7).orderBy("order_id").collect() != a


def test_normal_cdf(spark):
    df = spark.range(-40, 41).select((F.col("id") / 10).alias("z")).select("z", normal_cdf(F.col("z")).alias("p"))
    for r in df.collect():
        assert math.isclose(r["p"], 0.5 * (1 + math.erf(r["z"] / 2**0.5)), abs_tol=1e-6)


def test_copula_keeps_correlation_and_margins(spark):
    df = G.gen_correlated(rows(spark, N), "_id", [[1, 0.7, 0], [0.7, 1, 0.2], [0, 0.2, 1]],
                          {"a": {"mean": 0, "std": 1}, "u": {"distribution": "uniform", "min": 10, "max": 20}, "e": {"distribution": "exponential", "scale": 2}})
    r = df.agg(F.corr("a", "u").alias("au"), F.avg("u").alias("u"), F.avg("e").alias("e")).first()
    assert abs(r["au"] - 0.69) < 0.03
    close(r["u"], 15, 2.9)
    close(r["e"], 2, 2)


def test_dependent_value_is_a_function(spark):
    df = rows(spark, 1000).select((F.col("_id") % 20).alias("a")).withColumn("b", G.gen_dependent("a", "b", {"type": "integer", "min": 1, "max": 10**6, "distribution": "uniform"}))
    assert df.groupBy("a").agg(F.count_distinct("b").alias("n")).where("n > 1").count() == 0


def test_referential_integrity_and_order(spark):
    tables = [{"name": "items", "rows": 900, "columns": [{"name": "item_id", "type": "id"}, {"name": "order_id", "type": "foreign_key"}, {"name": "customer_id", "type": "foreign_key"}]},
              {"name": "orders", "rows": 300, "columns": [{"name": "order_id", "type": "id"}, {"name": "customer_id", "type": "foreign_key"}, {"name": "amount", "type": "float"}]},
              {"name": "customers", "rows": 50, "columns": [{"name": "customer_id", "type": "id"}, {"name": "email", "type": "email"}]}]
    rel = [{"from": "orders", "to": "customers"}, {"from": "items", "column": "order_id", "to": "orders"}, {"from": "items", "column": "customer_id", "to": "customers"}]
    assert G.table_order(tables, rel) == ["customers", "orders", "items"]
    made = G.generate_tables(spark, tables, rel)
    for child, parent, key in (("orders", "customers", "customer_id"), ("items", "orders", "order_id"), ("items", "customers", "customer_id")):
        assert made[child].join(made[parent], key, "left_anti").count() == 0
    assert made["orders"].select("order_id").distinct().count() == 300
    with pytest.raises(ValueError, match="circle"):
        G.table_order(tables, rel + [{"from": "customers", "to": "items"}])


def test_missing_and_outliers(spark):
    df = rows(spark, N).withColumn("v", F.lit(5.0))
    holed = G.inject_missing(df, {"v": 0.3}, "_id")
    close(holed.where("v is null").count() / N, 0.3, 0.46)
    wild = G.inject_outliers(df, {"v": {"type": "float", "min": 0, "max": 10}}, 0.1, "_id")
    far = wild.where("v < 0 or v > 10")
    close(far.count() / N, 0.1, 0.3)
    low, high = far.agg(F.min("v"), F.max("v")).first()
    assert -5 <= low <= -1 and 11 <= high <= 15


def test_sorted_dates_need_no_sort(spark):
    d = Draw(3, F.col("_id"))
    df = rows(spark, 1000).select("_id", G.gen_datetime(d, "t", {"min_date": "2024-01-01", "max_date": "2024-02-01"}, 1000).alias("t"))
    ts = [r["t"] for r in df.orderBy("_id").collect()]
    assert ts == sorted(ts) and str(ts[0])[:7] == "2024-01"
    assert "Exchange" not in df._jdf.queryExecution().toString()


def test_false_spelling(spark):
    d = Draw(3, F.col("_id"))
    df = rows(spark, 200).select(G.gen_boolean(d, "b", {"true_count": 1, "false_count": 1, "representation": "YES"}).alias("b"))
    assert {r["b"] for r in df.collect()} == {"YES", "NO"}


@pytest.mark.parametrize("industry", ["healthcare", "finance", "retail", "manufacturing", "insurance"])
def test_templates_meet_their_formats(spark, industry):
    df = T.generate_template(rows(spark, 400), "_id", industry, 400)
    checks = {"finance": {"account_number": "account", "transaction_id": "transaction_id"}, "retail": {"product_id": "sku", "order_id": "order_id"},
              "manufacturing": {"part_number": "part_number"}, "insurance": {"policy_number": "policy_number"}, "healthcare": {"diagnosis_code": "icd10"}}[industry]
    assert df.count() == 400 and all(r["failed"] == 0 for r in validate_formats(df, checks).collect())
    if industry == "healthcare":
        assert df.where("datediff(discharge_date, admission_date) not between 1 and 14").count() == 0
    if industry == "retail":
        assert df.where("abs(total - price * quantity) > 0.006").count() == 0
        assert df.groupBy("product_id").agg(F.count_distinct("product_name").alias("n")).where("n > 1").count() == 0


def test_levels_grow(spark):
    widths = [len(T.generate_complexity(rows(spark, 50), "_id", level, 50).columns) for level in T.LEVELS]
    assert widths == sorted(widths) and len(set(widths)) == 4
    df = T.generate_complexity(rows(spark, 300), "_id", "very_complex", 300)
    assert df.where("manager_id >= id").count() == 0 and df.where("age > 60 and email is not null").count() == 0
    vec = np.array([r["image_embedding"] for r in df.select("image_embedding").collect()])
    assert vec.shape == (300, 128) and abs(vec.mean()) < 0.05 and abs(vec.std() - 1) < 0.05


def test_levels_use_all_cores(spark):
    made = T.generate_complexity(rows(spark, 400).coalesce(1), "_id", "very_complex", 400)
    assert made.groupBy(F.spark_partition_id()).count().count() == 8
    whole = T.generate_complexity(rows(spark, 400), "_id", "very_complex", 400)
    assert sorted(made.select("id", "name", "salary").collect()) == sorted(whole.select("id", "name", "salary").collect())


def test_draw_from_a_frequency_table(spark):
    table = spark.createDataFrame([("a", 600), ("b", 300), ("c", 100)], "value string, n long")
    df = G.draw_from_table(rows(spark, 5000).withColumn("c", F.lit(None).cast("string")), "c", table, "_id", 5)
    got = {r["c"]: r["count"] / 5000 for r in df.groupBy("c").count().collect()}
    close(got["a"], 0.6, 0.5, 5000)
    close(got["c"], 0.1, 0.3, 5000)


def test_learned_table_looks_like_the_sample(spark):
    sample = spark.range(3000).select(F.when(F.crc32(F.col("id").cast("string")) % 10 < 7, "x").otherwise("y").alias("kind"), (F.col("id") % 100).cast("double").alias("v"), (F.col("id") % 100 * 2.0).alias("w"))
    made = G.generate(rows(spark, 3000), "_id", learn(sample))
    assert abs(made.where("kind = 'x'").count() - sample.where("kind = 'x'").count()) / 3000 < 0.04
    assert made.agg(F.corr("v", "w")).first()[0] > 0.9
