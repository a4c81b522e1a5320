from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sievemill.streaming import sketches


def points(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=7 * i), f"u{i % 50}", float(i % 97), "ab"[i % 2]) for i in range(1000)] + [(None, "x", 1.0, "a"), (start, None, None, "a")]
    return spark.createDataFrame(rows, "ts timestamp, who string, v double, kind string")


def test_small_sets_are_exact_and_windows_are_whole(spark):
    df = points(spark)
    got = {r["window_end"]: r for r in sketches.trailing(sketches.cells(df, "1 hour", user="who"), "3 hours", "1 hour").collect()}
    rows = [r for r in df.collect() if r["ts"] is not None]
    assert len(got) == 119
    for end, r in got.items():
        inside = [x for x in rows if end - timedelta(hours=3) <= x["ts"] < end]
        assert r["n"] == len(inside) and r["users"] == len({x["who"] for x in inside} - {None})


def test_values_of_cells_merge(spark):
    df = points(spark)
    fine = sketches.cells(df, "10 minutes", ["kind"], value="v")
    direct = sketches.trailing(sketches.cells(df, "1 hour", ["kind"], value="v"), "6 hours", "1 hour", ["kind"])
    merged = sketches.trailing_sizes(fine, {"6 hours": "1 hour"}, ["kind"]).drop("size")
    cols = ["window_end", "kind", "n", "total", "mean", "least", "greatest", "last"]
    assert sorted(map(tuple, direct.select(cols).collect())) == sorted(map(tuple, merged.select(cols).collect()))
    for r in merged.collect():
        assert r["least"] <= r["p50"] <= r["p95"] <= r["p99"] <= r["greatest"]


def test_what_is_kept_hangs_on_cells(spark):
    df = spark.range(200_000).select(F.lit("2024-01-01 00:30:00").cast("timestamp").alias("ts"), F.col("id").cast("string").alias("who"), F.rand(1).alias("v"))
    (row,) = sketches.cells(df, "1 hour", user="who", value="v").collect()
    assert row["n"] == 200_000 and len(row["users"]) < 20_000 and len(row["values"]) < 20_000
    (out,) = sketches.trailing(sketches.cells(df, "1 hour", user="who", value="v"), "1 hour", "1 hour").collect()
    assert abs(out["users"] - 200_000) <= sketches.DISTINCT_ERROR * 200_000 and abs(out["p95"] - 0.95) <= sketches.RANK_ERROR


def test_nothing(spark):
    assert sketches.trailing(sketches.cells(points(spark).limit(0), "1 hour", user="who", value="v"), "3 hours", "1 hour").collect() == []
