"""Keyed streams run batch by batch, for keys too large for one task.

The state-store forms in :mod:`metrics` and :mod:`rules` put one trigger's rows of a key in order in a
single task.  Here every trigger runs the batch operator, which splits large keys, and the state (one
row per key) is a small table written beside each trigger's output.  A repeated trigger overwrites its
own folders and starts from the state before it, so results do not change.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.operators.ordered import ordered_scan
from sievemill.plans.rules import Rule
from sievemill.session import cut, shared_dir
from sievemill.streaming.logs import TRIGGERS, trailing_sums
from sievemill.streaming.metrics import _thresholds
from sievemill.streaming.rules import cooled, matches

Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def run_with_state(stream: DataFrame, step: Step, home: str | None = None) -> DataFrame:
    """Run ``step(batch, state before) -> (output, state after)`` over everything available; returns all
    output.  Output, state and checkpoint lie in ``home``, a folder that all executors share (none given: a new one
    in the shared folder).  A later run with the same ``home`` goes on where the one before ended."""
    spark = stream.sparkSession
    home = home or f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}"

    def each(batch: DataFrame, epoch: int) -> None:
        before = batch.sparkSession.read.parquet(f"{home}/state/{epoch - 1}") if epoch > 0 else None
        out, after = step(batch, before)
        after.write.mode("overwrite").parquet(f"{home}/state/{epoch}")
        out.write.mode("overwrite").parquet(f"{home}/out/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(each).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{home}/checkpoint").start().awaitTermination()
    return spark.read.parquet(f"{home}/out").drop("epoch")


def alerts_by_batch(points: DataFrame, defs: DataFrame, tie: Sequence[str] = (), home: str | None = None) -> DataFrame:
    """Open and resolve events of a stream of metric points; state is one flag per metric and level."""

    def step(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        # written down first: the batch is read for the sizes, the scan and the state
        flagged = cut(_thresholds(batch, defs).select("name", "level", "ts", *tie, F.col("value").cast("double").alias("value"), "hit"))
        scanned = ordered_scan(flagged, ["ts", *tie], ["name", "level"], lag={"_before": "hit"})
        last = flagged.groupBy("name", "level").agg(F.max_by("hit", F.struct("ts", *tie)).alias("open"))
        if before is None:
            was = F.lit(False)
        else:
            known = before.select("name", "level", F.col("open").alias("_open"))
            scanned = scanned.join(known, ["name", "level"], "left")
            untouched = before.join(last, ["name", "level"], "left_anti")
            last = last.unionByName(untouched)
            was = F.coalesce("_open", F.lit(False))
        moved = scanned.where(F.col("hit") != F.coalesce("_before", was))
        event = F.when(F.col("hit"), "open").otherwise("resolve").alias("event")
        return moved.select("name", "level", event, "ts", "value"), last

    return run_with_state(points, step, home)


def rules_by_batch(events: DataFrame, rules: Sequence[Rule], key: str, ts: str = "ts", home: str | None = None) -> DataFrame:
    """Firings of a rule set with cooldown; state is the time each rule last fired."""

    def step(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        hits = matches(batch, rules, key, ts)
        if before is not None:
            # what the last firing still silences is out before the new chain starts
            known = before.select("rule_id", F.col("last").alias("_last"))
            hits = hits.join(known, "rule_id", "left").where(
                F.col("_last").isNull() | (F.col("wait") == 0) | (F.unix_micros("ts") >= F.col("_last") + F.col("wait"))
            ).drop("_last")
        fired = cut(cooled(cut(hits)))
        last = fired.groupBy("rule_id").agg(F.max(F.unix_micros("ts")).alias("last"))
        if before is not None:
            last = last.unionByName(before.join(last, "rule_id", "left_anti"))
        return fired, last

    return run_with_state(events, step, home)


def trailing_by_batch(events: DataFrame, ts: str, seconds: int, part: Sequence[str] = (), least: int = 0, late: int = 0,
                      mark: Column | None = None, home: str | None = None) -> DataFrame:
    """``trailing_counts`` of a stream: moments with more than ``least`` events in the trailing ``seconds``.

    State is the number of events per key and moment of the last ``seconds + late``.  Events up to ``late`` seconds
    behind the newest of earlier triggers still count, and correct the moments after them; older ones, and events
    without a time, are left out.  With ``mark``, only moments with an event for which it holds are returned.
    """
    second = 1_000_000
    marks = F.count_if(mark) if mark is not None else F.count(F.lit(1))

    def step(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        at = F.unix_micros(F.col(ts).cast("timestamp")).alias("at")
        new = batch.where(F.col(ts).isNotNull()).groupBy(*part, at).agg(F.count(F.lit(1)).alias("n"), marks.alias("marks"))
        newest = before.agg(F.max("at")).first()[0] if before is not None else None
        if newest is not None:
            new = new.where(F.col("at") >= newest - late * second)
        new = cut(new)
        first, last = new.agg(F.min("at"), F.max("at")).first()
        known = new
        if before is not None:
            known = cut(before.unionByName(new).groupBy(*part, "at").agg(F.sum("n").alias("n"), F.sum("marks").alias("marks")))
        moved = trailing_sums(known.select(*part, "at", "n"), seconds, part).where((F.col("recent") > least) & (F.col("at") >= F.lit(first)))
        moved = moved.join(known.where("marks > 0").select(*part, "at"), [*part, "at"], "left_semi")
        ends = [x for x in (newest, last) if x is not None]
        after = known.where(F.col("at") >= max(ends) - (seconds + late) * second) if ends else known
        return moved, after

    out = run_with_state(events, step, home)
    # a moment that was corrected came out again; counts only grow
    return out.groupBy(*part, F.timestamp_micros("at").alias(ts)).agg(F.max("events").alias("events"), F.max("recent").alias("recent"))


def surges_by_batch(logs: DataFrame, n: int = 10, seconds: int = 60, late: int = 0, home: str | None = None) -> DataFrame:
    """``error_surge`` of a stream."""
    return trailing_by_batch(logs.where(F.col("level").isin("ERROR", "CRITICAL")), "ts", seconds, (), n, late, None, home)


def brute_force_by_batch(logs: DataFrame, n: int = 5, seconds: int = 300, late: int = 0, home: str | None = None) -> DataFrame:
    """``brute_force`` of a stream."""
    events = logs.where((F.col("source") == "security") & F.col("ip_address").isNotNull())
    return trailing_by_batch(events, "ts", seconds, ["ip_address"], n, late, F.col("event_type").isin(*TRIGGERS), home)
