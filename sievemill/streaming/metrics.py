"""Metric points: ingestion, roll-ups, threshold alerts, export."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.operators.ordered import latest, ordered_scan
from sievemill.operators.quantiles import grouped_quantiles
from sievemill.operators.relational import _moment

# --- fixed values: built-in metrics (name, type, unit, description, thresholds, direction) ---------
DEFINITIONS = [
    ("system.cpu.usage", "gauge", "percent", "CPU usage percentage", {"warning": 80.0, "critical": 95.0}, "above"),
    ("system.memory.usage", "gauge", "percent", "Memory usage percentage", {"warning": 85.0, "critical": 95.0}, "above"),
    ("system.disk.usage", "gauge", "percent", "Disk usage percentage", {"warning": 80.0, "critical": 90.0}, "above"),
    ("system.network.throughput", "rate", "bytes/sec", "Network throughput", {}, "above"),
    ("app.requests.total", "counter", "count", "Total API requests", {}, "above"),
    ("app.requests.duration", "histogram", "milliseconds", "Request duration", {}, "above"),
    ("app.errors.total", "counter", "count", "Total application errors", {}, "above"),
    ("model.training.duration", "histogram", "seconds", "Model training duration", {}, "above"),
    ("model.inference.latency", "histogram", "milliseconds", "Model inference latency", {}, "above"),
    ("model.accuracy", "gauge", "ratio", "Model accuracy score", {"warning": 0.8, "critical": 0.7}, "below"),
    ("jobs.queue.size", "gauge", "count", "Job queue size", {"warning": 100.0, "critical": 500.0}, "above"),
    ("jobs.execution.time", "histogram", "seconds", "Job execution time", {}, "above"),
    ("database.connections.active", "gauge", "count", "Active database connections", {"warning": 80.0, "critical": 95.0}, "above"),
    ("database.query.duration", "histogram", "milliseconds", "Database query duration", {}, "above"),
]
WINDOWS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "24h": 86400}
# -----------------------------------------------------------------------------------------------

_DEFINITION = "name string, type string, unit string, description string, thresholds map<string,double>, direction string, aggregation string"


def definitions(spark: SparkSession, extra: Sequence[tuple] = (), builtin: bool = True) -> DataFrame:
    """Metric definitions as a table; ``extra`` rows are (name, type, unit, description, thresholds,
    direction, aggregation)."""
    rows = [(*d, "avg") for d in DEFINITIONS] if builtin else []
    return spark.createDataFrame([*rows, *extra], _DEFINITION)


def metric_stream(raw: DataFrame, defs: DataFrame, watermark: str | None = None) -> DataFrame:
    """Points of registered metrics; the others drop out in the join."""
    points = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark and raw.isStreaming:
        points = points.withWatermark("ts", watermark)
    return points.join(defs.select("name"), "name", "inner")


def dropped_points(raw: DataFrame, defs: DataFrame) -> DataFrame:
    """Points per unregistered metric name."""
    return raw.join(defs, "name", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("dropped"))


def _statistics(exact: bool) -> dict[str, Column]:
    out = {
        "count": F.count(F.lit(1)), "avg": F.avg("value"), "sum": F.sum("value"), "min": F.min("value"), "max": F.max("value"),
        "last": F.max_by("value", F.struct("ts", "value")),
    }
    if not exact:
        out |= {n: F.percentile_approx("value", p, 10000) for n, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))}
    return out


def _by_definition() -> Column:
    out = None
    for how in ("sum", "min", "max", "last"):
        test = F.col("aggregation") == how
        out = F.when(test, F.col(how)) if out is None else out.when(test, F.col(how))
    return out.otherwise(F.col("avg"))


def rollup_at(points: DataFrame, defs: DataFrame, as_of, windows: Mapping[str, int] = WINDOWS) -> DataFrame:
    """Every metric over the trailing windows that end at ``as_of``: count, value by the definition's
    aggregation and, for histograms, mean, median, p95, p99, min, max."""
    end = _moment(as_of)
    known = points.withColumn("ts", F.col("ts").cast("timestamp"))
    recent = known.where(F.col("ts").between(end - F.expr(f"INTERVAL {max(windows.values())} SECONDS"), end))
    age = F.unix_micros(end) - F.unix_micros("ts")
    names = F.filter(F.array(*[F.when(age <= s * 1_000_000, F.lit(n)) for n, s in windows.items()]), lambda x: x.isNotNull())
    spread = recent.join(defs.select("name", "type", "aggregation"), "name").withColumn("window", F.explode(names))
    base = spread.groupBy("name", "window", "type", "aggregation").agg(*[e.alias(n) for n, e in _statistics(True).items()])
    quant = grouped_quantiles(spread.where("type = 'histogram'"), ["name", "window"], "value", {"median": 0.5, "p95": 0.95, "p99": 0.99})
    hist = F.col("type") == "histogram"
    return base.join(quant, ["name", "window"], "left").select(
        "name", "window", "count", F.when(~hist, _by_definition()).alias("value"), F.when(hist, F.col("avg")).alias("mean"),
        "median", "p95", "p99", F.when(hist, F.col("min")).alias("min"), F.when(hist, F.col("max")).alias("max"),
    )


def rollup_metrics(points: DataFrame, defs: DataFrame, size: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Event-time windows of one size, for streams (approximate quantiles) and batches."""
    timed = metric_stream(points, defs, watermark)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy("name", window.alias("w")).agg(*[e.alias(n) for n, e in _statistics(False).items()]).select(
        "name", F.col("w.start").alias("window_start"), *_statistics(False)
    )


def trailing_rollup(points: DataFrame, seconds: int, step: int = 60) -> DataFrame:
    """count, avg, min, max over the trailing ``seconds``, at every ``step`` that has points.

    Points are first combined into buckets of ``step``; the trailing window then runs over buckets,
    of which a metric has a bounded number per day, instead of copying each point into every window.
    """
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / step)
    buckets = points.groupBy("name", bucket.alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    w = Window.partitionBy("name").orderBy("b").rangeBetween(-(seconds // step) + 1, 0)
    return buckets.select(
        "name", F.timestamp_seconds((F.col("b") + 1) * step).alias("window_end"), F.sum("n").over(w).alias("count"),
        (F.sum("s").over(w) / F.sum("n").over(w)).alias("avg"), F.min("lo").over(w).alias("min"), F.max("hi").over(w).alias("max"),
    )


def _thresholds(points: DataFrame, defs: DataFrame) -> DataFrame:
    """Points of gauges and counters against each of their thresholds, with the triggered flag."""
    levels = defs.where(F.col("type").isin("gauge", "counter")).select("name", "direction", F.explode("thresholds").alias("level", "threshold"))
    joined = points.withColumn("ts", F.col("ts").cast("timestamp")).join(levels, "name")
    hit = F.when(F.col("direction") == "below", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return joined.withColumn("hit", F.coalesce(hit, F.lit(False)))


def alert_episodes(points: DataFrame, defs: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Alerts with the moment they opened and, when over, closed: runs of points past a threshold."""
    flagged = _thresholds(points, defs)
    part = ["name", "level"]
    scanned = ordered_scan(flagged, ["ts", *tie], part, lag={"_before": "hit"})
    change = scanned.where(F.col("hit") != F.coalesce("_before", F.lit(False)))
    closing = change.withColumn("_closed", F.when(~F.col("hit"), F.col("ts")))
    paired = ordered_scan(closing, ["ts", *tie], part, following={"resolved_at": "_closed"})
    return paired.where("hit").select("name", "level", "threshold", F.col("ts").alias("triggered_at"), "value", "resolved_at")


_ALERT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("level", T.StringType()), T.StructField("event", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType()),
])
_OPEN = T.StructType([T.StructField("open", T.BooleanType())])


def alerts(points: DataFrame, defs: DataFrame) -> DataFrame:
    """Alert stream: an ``open`` or ``resolve`` row whenever a metric crosses a threshold.

    State is one flag per metric and level.  Feed it one-minute roll-ups where raw points of a single
    metric would be too many for one key.
    """
    flagged = _thresholds(points, defs).select("name", "level", "ts", F.col("value").cast("double").alias("value"), "hit")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        is_open = state.get[0] if state.exists else False
        # one trigger's rows of one metric and level, put in time order
        rows = pd.concat(list(batches)).sort_values(["ts", "value"], kind="stable")
        hits = rows["hit"].to_numpy()
        before = [is_open, *hits[:-1]]
        moved = rows[hits != before]
        state.update((bool(hits[-1]),))
        yield pd.DataFrame({
            "name": key[0], "level": key[1], "event": ["open" if h else "resolve" for h in moved["hit"]],
            "ts": moved["ts"].to_numpy(), "value": moved["value"].to_numpy(),
        })

    return flagged.groupBy("name", "level").applyInPandasWithState(step, _ALERT, _OPEN, "append", "NoTimeout")


def latest_metrics(points: DataFrame) -> DataFrame:
    """Last value per metric and label set (labels as sorted JSON)."""
    entries = F.array_sort(F.map_entries("labels"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return latest(points.select("name", F.coalesce(text, F.lit("")).alias("label_text"), "ts", "value"), ["name", "label_text"], ["ts", "value"])


def to_prometheus(points: DataFrame, defs: DataFrame) -> DataFrame:
    """Exposition lines in order: HELP, TYPE, then the last value of each label set."""
    last = latest_metrics(points)
    body = last.join(defs.select("name"), "name").select(
        "name", F.lit(2).alias("part"),
        F.concat("name", F.when(F.col("label_text") != "", F.concat(F.lit("{"), "label_text", F.lit("}"))).otherwise(F.lit("")),
                 F.lit(" "), F.col("value").cast("string")).alias("line"),
    )
    head = defs.select("name", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("# HELP "), "name", F.lit(" "), "description").alias("line")),
        F.struct(F.lit(1).alias("part"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "type").alias("line")),
    )).alias("x")).select("name", "x.*")
    return head.unionByName(body).orderBy("name", "part", "line")


def retention(points: DataFrame, defs: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Points young enough to keep."""
    return points.where(F.col("ts") >= (_moment(as_of) - F.expr(f"INTERVAL {days} DAYS")).cast(dict(points.dtypes)["ts"]))
