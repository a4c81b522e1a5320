import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemill.plans.rules import parse_rule
from sievemill.queries import telemetry as Q
from sievemill.streaming import batches as B
from sievemill.streaming import logs as L
from sievemill.streaming import metrics as M
from sievemill.streaming import rules as RS
from sievemill.streaming import run as S


@pytest.fixture(scope="module")
def pieces(spark):
    """The events in time order as several files, so that a stream takes several triggers."""
    home = tempfile.mkdtemp(prefix="run-")
    pdf = spark.read.parquet("/root/testdata/sf0.001/events.parquet").toPandas().sort_values(["ts", "event_id"])
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    for i in range(5):
        part = pdf.iloc[i * len(pdf) // 5:(i + 1) * len(pdf) // 5]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(home)
    return home, schema


def stream(spark, pieces):
    home, schema = pieces
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(home)


def test_alerts_equal_batch_over_triggers(spark, pieces, events):
    defs = M.definitions(spark)
    got = S.run_to_end(M.alerts(Q.points(stream(spark, pieces)), defs)).toPandas()
    episodes = M.alert_episodes(Q.points(events), defs, ["event_id"]).toPandas()
    opened = got[got["event"] == "open"][["name", "level", "ts", "value"]]
    key = lambda df, c: sorted(map(tuple, df[c].astype(str).values))
    assert key(opened, ["name", "level", "ts"]) == key(episodes, ["name", "level", "triggered_at"])
    assert len(got[got["event"] == "resolve"]) == episodes["resolved_at"].notna().sum()


def test_cooldown_equals_batch_over_triggers(spark, pieces, events):
    got = S.run_to_end(RS.rule_stream(stream(spark, pieces), Q.COOL, "event_id"))
    want = RS.with_cooldown(events, Q.COOL, "event_id")
    assert sorted((r["rule_id"], r["key"]) for r in got.collect()) == sorted((r["rule_id"], r["key"]) for r in want.collect())


@pytest.mark.parametrize("split", [False, True])
def test_batchwise_forms_equal_batch(spark, request, pieces, events, split):
    defs = M.definitions(spark)
    fired = sorted((r["rule_id"], r["key"]) for r in RS.with_cooldown(events, Q.COOL, "event_id").collect())
    episodes = M.alert_episodes(Q.points(events), defs, ["event_id"]).collect()
    if split:
        for k, v in (("sievemill.groupRows", "60"), ("sievemill.chunkRows", "50")):
            spark.conf.set(k, v)
            request.addfinalizer(lambda k=k: spark.conf.unset(k))
    got = B.alerts_by_batch(Q.points(stream(spark, pieces)), defs, ["event_id"]).collect()
    assert sorted((r["name"], r["level"], r["ts"]) for r in got if r["event"] == "open") == sorted((r["name"], r["level"], r["triggered_at"]) for r in episodes)
    assert sorted((r["name"], r["level"], r["ts"]) for r in got if r["event"] == "resolve") == sorted((r["name"], r["level"], r["resolved_at"]) for r in episodes if r["resolved_at"])
    if not split:  # the pointer form is tested on its own
        assert sorted((r["rule_id"], r["key"]) for r in B.rules_by_batch(stream(spark, pieces), Q.COOL, "event_id").collect()) == fired


def test_cooldown_of_a_hot_rule_by_pointers(spark, small_limits, events):
    rule = parse_rule({"rule_id": "all", "name": "all", "cooldown_seconds": 40000, "conditions": {"field": "event_id", "operator": "greater_or_equal", "value": 0}, "actions": []})
    got = sorted(r["ts"] for r in RS.with_cooldown(events, [rule], "event_id").collect())
    want, last = [], None
    for r in events.select(F.col("ts").cast("timestamp").alias("ts")).orderBy("ts").collect():
        if last is None or (r["ts"] - last).total_seconds() >= 40000:
            want.append(r["ts"])
            last = r["ts"]
    assert got == want


def test_chains_of_hot_rules_cross_chunks(spark, small_limits, monkeypatch):
    """Chunks shorter and longer than the cooldown, gaps, repeated moments, null times and keys; writes don't grow with the chain."""
    writes = []
    for name in ("cut", "stored"):
        monkeypatch.setattr(RS, name, lambda df, write=getattr(RS, name): writes.append(1) or write(df))
    gen = random.Random(3)
    rows = [("long", 100, t) for t in gen.sample(range(300), 120)] + [("short", 3, t) for t in gen.sample(range(1000), 60)]
    rows += [("gaps", 10, 1000 * i + t) for i in range(5) for t in gen.sample(range(25), 8)] + [("few", 10, 5), ("few", 10, 14), ("few", 10, 15)]
    rows = [(r, w, t, None if i % 9 == 0 else (1 << 60) + i) for i, (r, w, t) in enumerate(rows)]
    rows += [(r, w, t, 1 << 61) for r, w, t, _ in rows[::5]] + [("few", 10, None, 4)]
    gen.shuffle(rows)
    want = []
    for rule in {r[0] for r in rows}:
        keys, last = {}, None
        for _, w, t, k in (r for r in rows if r[0] == rule and r[2] is not None):
            keys.setdefault(t, []).append(k)
        for t in sorted(keys):
            if last is None or t >= last + w:
                want.append((rule, min((k for k in keys[t] if k is not None), default=None), last := t))
    hits = spark.createDataFrame(rows, "rule_id string, wait long, t long, key long").withColumn("wait", F.col("wait") * 1_000_000)
    got = RS.cooled(hits.select("rule_id", "key", F.timestamp_seconds("t").alias("ts"), "wait"))
    got = sorted((r["rule_id"], r["t"], r["key"]) for r in got.select("rule_id", F.unix_seconds("ts").alias("t"), "key").collect())
    assert got == sorted((r, t, k) for r, k, t in want)
    assert len(writes) <= 2


def test_same_moment_matches(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([0, 0, 5, 10, 10, 30])], "id long, t long").select("id", F.timestamp_seconds("t").alias("ts"))
    rules = [parse_rule({"rule_id": r, "name": r, "cooldown_seconds": c, "conditions": {"field": "id", "operator": "is_not_null"}, "actions": []}) for r, c in (("cool", 10), ("free", None))]
    got = sorted((r["rule_id"], r["key"]) for r in RS.with_cooldown(df, rules, "id").collect())
    assert got == [("cool", 0), ("cool", 3), ("cool", 5)] + [("free", i) for i in range(6)]


def test_rollup_stream_equals_batch(spark, pieces, events):
    defs = M.definitions(spark)
    cols = ["name", "window_start", "count", "min", "max", "last"]
    got = S.run_to_end(M.rollup_metrics(Q.points(stream(spark, pieces)), defs, "6 hours"), "complete").select(*cols).collect()
    assert sorted(got) == sorted(M.rollup_metrics(Q.points(events), defs, "6 hours").select(*cols).collect())


def test_dedup_within_watermark(spark, pieces):
    logs = stream(spark, pieces).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("log_id"))
    assert S.run_to_end(L.dedup_stream(logs, "60 days")).count() == 5


def test_late_points_are_dropped_after_the_watermark(spark):
    home = tempfile.mkdtemp(prefix="run-")
    # late rows are judged by the watermark of the trigger before, so one trigger lies between
    for batch in ([("a", 0), ("b", 100000)], [("c", 100001)], [("late", 10), ("d", 200000)], [("e", 500000)]):
        df = spark.createDataFrame(batch, "level string, s long").select("level", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(home)
    src = spark.readStream.schema("level string, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(home)
    out = S.run_to_end(L.windowed_counts(src, "1 minute", watermark="1 minute"))
    assert {r["level"] for r in out.collect()} == {"a", "b", "c", "d"}


LINES = {
    "2024-01-05 10:00:00,123 - ERROR - [svc] - boom user_id=7": ("application", "ERROR", "svc"),
    '10.0.0.1 - - [05/Jan/2024:10:00:00 +0000] "GET /a HTTP/1.1" 500 12 "-" "ua"': ("nginx_access", "ERROR", "nginx"),
    '10.0.0.1 - - [05/Jan/2024:10:00:00 +0200] "GET /a HTTP/1.1" 404 12 "-" "ua"': ("nginx_access", "WARNING", "nginx"),
    "2024-01-05T10:00:00.000Z [WARNING] failed_login: bad password | user=bob ip=10.0.0.9": ("security_audit", "WARNING", "security"),
    "# Time: 240105 10:00:00\n# Query_time: 2.5 Lock: 0\n# Rows_examined: 9\nselect 1\nfrom t\n# next": ("slow_query", "WARNING", "mysql"),
    '{"level": "debug", "source": "audit", "service": "s", "message": "m", "duration_ms": 12.5}': ("json_structured", "DEBUG", "s"),
    "free text": ("raw", "INFO", "unknown"),
}


def test_every_line_format(spark):
    df = spark.createDataFrame([(k,) for k in LINES], "value string")
    got = {r["value"]: r for r in L.parse_logs(df, keep=["value"]).collect()}
    assert {k: (v["format"], v["level"], v["service"]) for k, v in got.items()} == LINES
    rows = list(got.values())
    assert rows[0]["metadata"] == {"user_id": "7"} and str(rows[0]["ts"]) == "2024-01-05 10:00:00.123000"
    assert rows[2]["ts"].hour == 8 and rows[1]["metadata"]["path"] == "/a"
    assert rows[3]["tags"] == ["security", "failed_login"] and rows[3]["ip_address"] == "10.0.0.9"
    assert rows[4]["duration_ms"] == 2500 and rows[4]["metadata"]["query"] == "select 1\nfrom t"
    assert len({r["log_id"] for r in rows}) == len(rows)


def test_unusable_lines_are_dropped(spark):
    bad = ["", "   ", '{"level": broken}', '{"level": "shout", "message": "x"}', '{"source": "moon"}', "2024-01-05 10:00:00,123 - LOUD - [svc] - x"]
    assert L.parse_logs(spark.createDataFrame([(b,) for b in bad], "value string")).count() == 0


def test_own_log_format(spark):
    L.register_log_pattern("kv", r"^kv (\w+)=(\w+)$", "system", lambda line: {"level": F.lit("DEBUG"), "source": F.lit("system"), "service": F.regexp_extract(line, r"^kv (\w+)=", 1), "message": line})
    try:
        row = L.parse_logs(spark.createDataFrame([("kv a=b",)], "value string")).first()
        assert (row["format"], row["level"], row["service"]) == ("kv", "DEBUG", "a")
    finally:
        L.PATTERNS.pop()


@pytest.mark.parametrize("split", [False, True])
def test_trailing_counts(spark, request, split):
    if split:
        request.getfixturevalue("small_limits")
    times = [0, 1, 1, 30, 59, 60, 61, 61, 121, 400, 400, 400, 459, 460]
    df = spark.createDataFrame([("h", t) for t in times] + [("c", 5)], "g string, t long").select("g", F.timestamp_seconds("t").alias("ts"))
    got = {(r["g"], int(r["ts"].timestamp())): r["recent"] for r in L.trailing_counts(df, "ts", 60, ["g"]).collect()}
    for t in times:
        assert got[("h", t)] == sum(1 for x in times if t - 60 < x <= t)


def test_alert_edges(spark):
    defs = M.definitions(spark, builtin=False, extra=[("g", "gauge", "", "", {"warning": 10.0}, "above", "avg"), ("h", "histogram", "", "", {"warning": 1.0}, "above", "avg")])
    pts = spark.createDataFrame([("g", 0, 10.0), ("g", 1, 11.0), ("g", 2, 12.0), ("g", 3, 10.0), ("g", 4, 20.0), ("h", 0, 99.0)], "name string, t long, value double").select("name", F.timestamp_seconds("t").alias("ts"), "value")
    rows = [(int(r["triggered_at"].timestamp()), r["resolved_at"] and int(r["resolved_at"].timestamp())) for r in M.alert_episodes(pts, defs).orderBy("triggered_at").collect()]
    assert rows == [(1, 3), (4, None)]  # equal to the threshold is no alert; histograms never alert


def test_accuracy_alerts_when_low(spark):
    pts = spark.createDataFrame([("model.accuracy", 0, 0.9), ("model.accuracy", 1, 0.75)], "name string, t long, value double").select("name", F.timestamp_seconds("t").alias("ts"), "value")
    assert [r["level"] for r in M.alert_episodes(pts, M.definitions(spark)).collect()] == ["warning"]


def test_prometheus_lines(spark):
    pts = spark.createDataFrame([("system.cpu.usage", 1, 5.0, {"b": "2", "a": "1"}), ("system.cpu.usage", 2, 6.0, {"a": "1", "b": "2"}), ("app.errors.total", 1, 1.0, None)],
                                "name string, t long, value double, labels map<string,string>").select("name", F.timestamp_seconds("t").alias("ts"), "value", "labels")
    lines = [r["line"] for r in M.to_prometheus(pts, M.definitions(spark)).collect()]
    at = lines.index("# TYPE system.cpu.usage gauge")
    assert lines[at - 1] == "# HELP system.cpu.usage CPU usage percentage" and lines[at + 1] == 'system.cpu.usage{a="1",b="2"} 6.0'
    assert "app.errors.total 1.0" in lines


def test_stream_lines_reads_new_files(spark):
    home = tempfile.mkdtemp(prefix="run-")
    with open(f"{home}/a.log", "w") as f:
        f.write("one\ntwo\n")
    assert sorted(r["value"] for r in S.run_to_end(S.stream_lines(spark, home, "*.log")).collect()) == ["one", "two"]


def test_active_users_are_close(spark, pieces, events):
    got = S.run_to_end(L.active_users(stream(spark, pieces), 24, exact=False), "complete").toPandas().set_index("window_start")["active_users"]
    want = L.active_users(events, 24).toPandas().set_index("window_start")["active_users"]
    assert (pd.Series(got).sort_index() - want.sort_index()).abs().max() <= 2


def _moments(df):
    return sorted(tuple(r) for r in df.collect())


def test_watches_by_batch_equal_batch(spark, pieces, events):
    logs, flow = Q.entries_of(events), Q.entries_of(stream(spark, pieces))
    want = L.error_surge(logs, 1, 7200).select("ts", "events", "recent")
    assert _moments(B.surges_by_batch(flow, 1, 7200).select("ts", "events", "recent")) == _moments(want) != []
    cols = ["ip_address", "ts", "events", "recent"]
    assert _moments(B.brute_force_by_batch(flow, 3, 86400).select(cols)) == _moments(L.brute_force(logs, 3, 86400).select(cols)) != []


def _entry_file(spark, home, seconds):
    df = spark.createDataFrame([("ERROR", s) for s in seconds], "level string, s long").select("level", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.mode("append").parquet(home)


def test_surges_after_a_restart_and_with_late_events(spark):
    src, home = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")
    flow = lambda: spark.readStream.schema("level string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    run = lambda: {int(r["ts"].timestamp()): (r["events"], r["recent"]) for r in B.surges_by_batch(flow(), 0, 60, 20, home).collect()}
    _entry_file(spark, src, [0, 100, 130])
    assert run() == {0: (1, 1), 100: (1, 1), 130: (1, 2)}
    # 120 is late but counts, and corrects 130; 50 is too late
    _entry_file(spark, src, [120, 50, 150])
    assert run() == {0: (1, 1), 100: (1, 1), 120: (1, 2), 130: (1, 3), 150: (1, 4)}
    assert run()[150] == (1, 4)  # nothing new


def test_stream_goes_on_in_its_folder(spark):
    src, home = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")
    flow = lambda: spark.readStream.schema("level string, ts timestamp").parquet(src)
    count = lambda: S.run_to_end(L.windowed_counts(flow(), "1 minute"), "complete", home=home).agg(F.sum("n")).first()[0]
    _entry_file(spark, src, [0, 1])
    assert count() == 2
    _entry_file(spark, src, [2])
    assert count() == 3


def test_cells_sum_up_to_the_trailing_windows(spark, pieces, events):
    as_of = "2024-01-20 12:00:00"
    logs = Q.entries_of(events).where(F.col("ts") != F.lit(as_of).cast("timestamp_ntz"))
    cells = S.run_to_end(L.log_cells(Q.entries_of(stream(spark, pieces)).where(F.col("ts") != F.lit(as_of).cast("timestamp_ntz"))))
    key = ["window", "total", "errors"]
    assert _moments(L.stats_of_cells(cells, as_of).select(key)) == _moments(L.log_stats(logs, as_of).select(key)) != []
    key = ["window", "dimension", "value", "n"]
    assert _moments(L.counts_of_cells(cells, as_of).select(key)) == _moments(L.log_counts(logs, as_of).select(key)) != []
