import pytest
from pyspark.sql import functions as F

from sievemill.streaming.late import split_late
from sievemill.streaming.run import stream_table

SCHEMA = "id long, ts timestamp"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "id long, at long").select("id", F.timestamp_seconds("at").alias("ts")).write.mode("append").parquet(f"{folder}/in")
    return split_late(stream_table(spark, f"{folder}/in", "*.parquet", spark.createDataFrame([], SCHEMA).schema), "ts", "10 seconds", f"{folder}/out")


def test_rows_behind_the_mark_come_out_apart(spark, tmp_path):
    arrive(spark, tmp_path, [(1, 100), (2, 5), (3, None)])  # no mark yet
    arrive(spark, tmp_path, [(4, 90), (5, 89), (6, 300)])  # mark 90, which is not behind itself
    good, late, counts = arrive(spark, tmp_path, [(7, 289), (8, 290), (9, None)])  # mark 290
    assert {(r["id"], r["epoch"]) for r in good.collect()} == {(1, 0), (2, 0), (3, 0), (4, 1), (6, 1), (8, 2), (9, 2)}
    assert {(r["id"], r["epoch"]) for r in late.collect()} == {(5, 1), (7, 2)}
    assert sorted((r["epoch"], r["on_time"], r["late"]) for r in counts.collect()) == [(0, 3, 0), (1, 2, 1), (2, 2, 1)]


def test_nothing_to_read(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    parts = split_late(stream_table(spark, f"{tmp_path}/in", "*.none", spark.createDataFrame([], SCHEMA).schema), "ts", "10 seconds", f"{tmp_path}/out")
    assert [p.count() for p in parts] == [0, 0, 0]


def test_clashing_names(spark, tmp_path):
    stream = stream_table(spark, str(tmp_path), "*", spark.createDataFrame([], "ts timestamp, epoch long").schema)
    with pytest.raises(ValueError):
        split_late(stream, "ts", "1 day")
