"""Distinct values of all columns from one shuffle of digests."""

import pytest
from pyspark.sql import functions as F

from sievemill.operators import profile as P
from sievemill.operators.privacy import _distinct_counts
from tests.conftest import DATA


def test_counts_equal_plain_ones(spark):
    for name in ("customer", "events", "labels"):
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        want = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in df.columns]).first().asDict()
        groups = {c: [c] for c in df.columns} | {"_all": df.columns}
        assert P.distinct_counts(df, groups).first().asDict() == want | {"_all": df.distinct().count()}


def test_nulls_zeros_nans_and_nested_values(spark):
    df = spark.createDataFrame(
        [(0.0, None, [1, None], "a"), (-0.0, 1, [None, 1], None), (float("nan"), None, [1], None), (float("nan"), 1, None, "a"), (None, None, None, None)],
        "x double, y int, z array<int>, w string")
    got = P.distinct_counts(df, {"x": ["x"], "y": ["y"], "z": ["z"], "yw": ["y", "w"], "all": ["x", "y", "z", "w"]}).first()
    assert got.asDict() == {"x": 2, "y": 1, "z": 3, "yw": 4, "all": 5}


def test_empty_table_and_one_column(spark):
    empty = spark.createDataFrame([], "x double, y string")
    assert P.distinct_counts(empty, {"x": ["x"], "y": ["y"], "all": ["x", "y"]}).first().asDict() == {"x": 0, "y": 0, "all": 0}
    one = spark.createDataFrame([(None,), (None,), (1,)], "_one int")
    assert P.quality_score(one).first()["duplicates"] == P.duplicate_count(one).first()["duplicates"] == 1


@pytest.mark.parametrize("make", [P.profile, P.quality_score])
def test_no_expand(spark, make):
    df = spark.read.parquet(f"{DATA}/part.parquet")
    # top values still unpivot their text columns, which is one Expand over texts alone
    text = make(df.select("p_partkey", "p_size", "p_retailprice"))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text
    assert _distinct_counts(df)[0] == df.count()
