"""What the plans must look like at scale."""

import pytest
from pyspark.sql import functions as F

from sievemill.operators import clean as K
from sievemill.operators import privacy as V
from sievemill.operators import profile as P
from sievemill.operators import relational as R
from sievemill.plans.rules import apply_rules
from sievemill.queries.rules import RULES
from sievemill.streaming import logs as L
from sievemill.synthesis import templates as T
from sievemill.synthesis.draw import rows
from tests.conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def orders(spark):
    return spark.read.parquet(f"{DATA}/orders.parquet")


def test_rules_move_no_data(spark, events):
    out = apply_rules(events.withColumn("v", F.col("value")), RULES, ["event_id"])
    text = plan(out)
    assert "Exchange" not in text and "PythonUDF" not in text and "ArrowEval" not in text


def test_stateless_steps_are_narrow_and_native(spark, events):
    parsed = L.parse_logs(events.select(F.col("props").alias("value")))
    masked = V.mask_cards(V.pseudonymize(events.withColumnRenamed("props", "name")))
    made = T.generate_template(rows(spark, 1000), "_id", "finance", 1000)
    for df in (parsed, masked, made, K.trim_text(events), K.enrich_dates(events)):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text and "Window" not in text


def test_time_filter_reaches_the_scan(orders):
    text = plan(R.since(orders, "o_orderdate", 30, "1999-01-01").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_statistics_read_their_columns_only(orders):
    assert "ReadSchema: struct<o_totalprice:double>" in plan(P.numeric_stats(orders, ["o_totalprice"]))


def test_top_values_rank_before_the_shuffle(orders):
    assert "WindowGroupLimit" in plan(P.top_values(orders, ["o_orderpriority"], 3))


def test_suppression_counts_before_the_shuffle(orders):
    text = plan(V.l_diversify(orders, ["o_custkey"], "o_orderstatus", 2))
    assert "Window" not in text and "LeftSemi" in text  # classes are counted and stored before


@pytest.mark.parametrize("make", [
    lambda o: P.privacy_metrics(o, ["o_custkey"], "o_orderstatus"), lambda o: P.quality_score(o), lambda o: V.t_close(o, ["o_custkey"], "o_orderstatus", 0.5),
    lambda o: V.generalize(o, 5, ["o_orderpriority"]), lambda o: K.drop_duplicates(o, ["o_custkey"], ["o_orderkey"]),
])
def test_no_cross_products(orders, make):
    text = plan(make(orders))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
