"""Rules over streams, with cooldown."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.operators.ordered import group_sizes
from sievemill.plans.rules import Rule, apply_rules
from sievemill.session import cut, limit, stored

_FIRED = T.StructType([
    T.StructField("rule_id", T.StringType()), T.StructField("key", T.LongType()), T.StructField("ts", T.TimestampType()),
])
_LAST = T.StructType([T.StructField("last", T.LongType())])


def _fire(micros: np.ndarray, cooldown: int, last: int | None) -> tuple[list[int], int | None]:
    """Positions that fire, in time order, when each firing silences the next ``cooldown`` micros."""
    out = []
    at = 0 if last is None else int(np.searchsorted(micros, last + cooldown))
    while at < len(micros):
        out.append(at)
        last = int(micros[at])
        # with no cooldown every match fires, also several of one moment
        at = at + 1 if cooldown == 0 else int(np.searchsorted(micros, last + cooldown))
    return out, last


def matches(events: DataFrame, rules: Sequence[Rule], key: str, ts: str) -> DataFrame:
    """Match rows (rule_id, key, ts, wait), the wait being the rule's cooldown in microseconds."""
    hits = apply_rules(events, rules, [key, ts]).select("rule_id", F.col(key).cast("bigint").alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    wait = F.lit(0).cast("bigint")
    for r in rules:
        if r.cooldown_seconds:
            wait = F.when(F.col("rule_id") == r.rule_id, F.lit(r.cooldown_seconds * 1_000_000)).otherwise(wait)
    return hits.withColumn("wait", wait)


def rule_stream(events: DataFrame, rules: Sequence[Rule], key: str, ts: str = "ts") -> DataFrame:
    """Firings of a rule set on a stream.  Matching is stateless; the state per rule is the time it
    last fired."""
    hits = matches(events, rules, key, ts)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "key"], kind="stable")
        micros = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        fired, last = _fire(micros, int(rows["wait"].iloc[0]), last)
        state.update((last,))
        yield rows.iloc[fired][["rule_id", "key", "ts"]]

    return hits.groupBy("rule_id").applyInPandasWithState(step, _FIRED, _LAST, "append", "NoTimeout")


def with_cooldown(events: DataFrame, rules: Sequence[Rule], key: str, ts: str = "ts") -> DataFrame:
    """Batch form of :func:`rule_stream`.

    A rule's matches are walked in one task while they fit the group limit.  Beyond it they are dealt over chunks in
    order, and the chain is followed from chunk to chunk (``_follow``).
    """
    return cooled(matches(events, rules, key, ts))


def cooled(hits: DataFrame) -> DataFrame:
    """Match rows that fire, as (rule_id, key, ts)."""
    hits = hits.withColumn("_us", F.unix_micros("ts"))
    free = hits.where(F.col("wait") == 0).select("rule_id", "key", "ts")
    # among matches of one moment the smallest key stands for all: the others are silenced
    timed = hits.where(F.col("wait") > 0).groupBy("rule_id", "wait", "_us").agg(F.min("key").alias("key"))
    _, biggest = group_sizes(timed, ["rule_id"])
    if biggest <= limit(hits.sparkSession, "sievemill.groupRows"):

        def walk(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_us")
            fired, _ = _fire(rows["_us"].to_numpy(), int(rows["wait"].iloc[0]), None)
            return rows.iloc[fired][["rule_id", "key", "_us"]]

        kept = timed.groupBy("rule_id").applyInPandas(walk, "rule_id string, key long, _us long")
    else:
        kept = _follow(timed)
    return free.unionByName(kept.select("rule_id", "key", F.timestamp_micros("_us").alias("ts")))


def _by_rule(rules: np.ndarray) -> Iterator[tuple[str, slice]]:
    """Each rule of a chunk, whose rows are sorted by rule, with its rows."""
    edges = np.flatnonzero(rules[1:] != rules[:-1]) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(rules)]):
        if low < high:
            yield rules[low], slice(low, high)


def _gates(micros: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions at which a chain may enter a chunk, moment of its last firing there if it does).

    A firing before the chunk silences less than one ``wait`` of it, so a chain enters at a match of that time or at the
    first one behind it.
    """
    after = np.searchsorted(micros, micros + wait)
    to = np.where(after < len(micros), after, np.arange(len(micros)))
    while not np.array_equal(further := to[to], to):
        to = further
    gates = np.arange(min(len(micros), int(np.searchsorted(micros, micros[0] + wait)) + 1))
    return gates, micros[to[gates]]


def _follow(timed: DataFrame) -> DataFrame:
    """Firings of rules too large for one task.

    Matches in order are dealt over chunks.  For every match at which a chain may enter a chunk, the chunk's task tells where the
    chain leaves it, so the chain is followed from chunk to chunk, one row each, all rules at once.  Then each chunk
    is walked from where the chain enters it.  Two passes over the matches, and a step per chunk.
    """
    spark = timed.sparkSession
    timed = timed.where(F.col("_us").isNotNull())  # a match without a time is never reached
    n = max(2, math.ceil(timed.count() / limit(spark, "sievemill.chunkRows")))
    dealt = timed.repartitionByRange(n, "rule_id", "_us").sortWithinPartitions("rule_id", "_us")
    # a null key would turn whole numbers into floats in pandas
    key = [F.coalesce("key", F.lit(0)).alias("key"), F.col("key").isNull().alias("none")]
    chunks = cut(dealt.select("rule_id", "wait", "_us", *key, F.spark_partition_id().alias("chunk")))

    def whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
        held = [b for b in batches if len(b)]
        return pd.concat(held, ignore_index=True) if held else None

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = whole(batches)
        if rows is None:
            return
        us, chunk = rows["_us"].to_numpy(), rows["chunk"].iloc[0]
        for rule, at in _by_rule(rows["rule_id"].to_numpy()):
            gates, last = _gates(us[at], int(rows["wait"].iloc[at.start]))
            yield pd.DataFrame({"rule_id": rule, "chunk": chunk, "us": us[at][gates], "last": last})

    gates = stored(chunks.mapInPandas(leave, "rule_id string, chunk int, us long, last long"))
    spans: dict[str, list[tuple]] = {}
    # a row per chunk, and one more per rule that shares one
    for r in chunks.groupBy("rule_id", "chunk").agg(F.min("_us").alias("low"), F.max("_us").alias("high"), F.first("wait").alias("wait")).collect():
        spans.setdefault(r["rule_id"], []).append((r["chunk"], r["low"], r["high"], r["wait"]))
    entries: dict[tuple[str, int], int] = {}
    todo = {rule: min(s[1] for s in spans[rule]) for rule in spans}
    while todo:
        now = {}
        for rule, ready in todo.items():
            reach = [s[0] for s in spans[rule] if s[2] >= ready]
            if reach:
                now[rule] = min(reach)
                entries[rule, now[rule]] = ready
        if not now:
            break
        asked = spark.createDataFrame([(r, c, todo[r]) for r, c in now.items()], "rule_id string, chunk int, ready long")
        met = gates.where(F.col("chunk").isin(sorted(set(now.values())))).join(F.broadcast(asked), ["rule_id", "chunk"]).where("us >= ready")
        left = {r["rule_id"]: r["last"] for r in met.groupBy("rule_id").agg(F.min_by("last", "us").alias("last")).collect()}
        todo = {rule: left[rule] + spans[rule][0][3] for rule in now}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = whole(batches)
        if rows is None:
            return
        us, chunk = rows["_us"].to_numpy(), int(rows["chunk"].iloc[0])
        for rule, at in _by_rule(rows["rule_id"].to_numpy()):
            if (rule, chunk) in entries:
                wait = int(rows["wait"].iloc[at.start])
                fired, _ = _fire(us[at], wait, entries[rule, chunk] - wait)
                yield rows.iloc[at].iloc[fired][["rule_id", "key", "none", "_us"]]

    fired = chunks.mapInPandas(walk, "rule_id string, key long, none boolean, _us long")
    return fired.select("rule_id", F.when(~F.col("none"), F.col("key")).alias("key"), "_us")
