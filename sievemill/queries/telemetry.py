"""Telemetry queries: logs, metrics, alerts and rule streams, in batch and as streams."""

import uuid

from pyspark.sql import functions as F

from sievemill.functions.columns import short_hash
from sievemill.operators import clean as K
from sievemill.operators.relational import slow
from sievemill.plans.rules import parse_rule
from sievemill.queries.profiling import rounded
from sievemill.queries.registry import ORACLES, query
from sievemill.session import shared_dir
from sievemill.streaming import batches as B
from sievemill.streaming import logs as L
from sievemill.streaming.late import split_late
from sievemill.streaming import metrics as M
from sievemill.streaming import rules as RS
from sievemill.streaming import run as S
from sievemill.streaming import sketches as SK

AS_OF = "2024-01-30 12:00:00"


def log_lines(events):
    """Text lines of every known format, written from events."""
    e, i = events, F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    user = F.col("user_id").cast("string")
    line = (
        F.when(i % 7 == 0, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(",123 - ERROR - ["), "event_type", F.lit("] - boom user_id="), user))
        .when(i % 7 == 1, F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" - - ["), F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"),
                                   F.lit(' +0000] "GET /'), "event_type", F.lit(' HTTP/1.1" '), (200 + i % 4 * 100).cast("string"), F.lit(' 12 "-" "ua"')))
        .when(i % 7 == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z [WARNING] failed_login: bad password | user=u"), user, F.lit(" ip=10.1.0."), (F.col("user_id") % 9).cast("string")))
        .when(i % 7 == 3, F.concat(F.lit('  {"level": "error", "source": "audit", "service": "pay", "message": "m'), i.cast("string"), F.lit('", "duration_ms": '), F.col("value").cast("string"),
                                   F.lit(', "error_type": "'), "event_type", F.lit('", "timestamp": "'), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"} ')))
        .when(i % 7 == 4, F.lit('{"level": "error", broken}'))
        .when(i % 7 == 5, F.when(i % 2 == 0, "   ").otherwise(F.concat(F.lit("free text "), i.cast("string"))))
        .otherwise(F.concat(F.lit("# Time: "), F.date_format(ts, "yyMMdd HH:mm:ss"), F.lit("\n# Query_time: 2.5 Lock\n# Rows_examined: 10\nselect "), i.cast("string"), F.lit("\n# end")))
    )
    return e.select("event_id", line.alias("value"))


_PARSED = """
    select event_id, 'application' as format, date_trunc('second', ts) + interval 123 milliseconds as ts, 'ERROR' as level, 'application' as source, event_type as service, 'boom user_id=' || user_id as message,
      null::varchar as user_id, null::varchar as ip_address, null::double as duration_ms from events where event_id % 7 = 0
    union all select event_id, 'nginx_access', date_trunc('second', ts), case when event_id % 4 = 3 then 'ERROR' when event_id % 4 = 2 then 'WARNING' else 'INFO' end, 'webserver', 'nginx', 'GET /' || event_type || ' HTTP/1.1', null, '10.0.0.' || (user_id % 250), null from events where event_id % 7 = 1
    union all select event_id, 'security_audit', date_trunc('second', ts), 'WARNING', 'security', 'security', 'bad password', 'u' || user_id, '10.1.0.' || (user_id % 9), null from events where event_id % 7 = 2
    union all select event_id, 'json_structured', date_trunc('second', ts), 'ERROR', 'audit', 'pay', 'm' || event_id, null, null, value from events where event_id % 7 = 3
    union all select event_id, 'raw', null, 'INFO', 'application', 'unknown', 'free text ' || event_id, null, null, null from events where event_id % 7 = 5 and event_id % 2 = 1
    union all select event_id, 'slow_query', date_trunc('second', ts), 'WARNING', 'database', 'mysql', 'Slow query: select ' || event_id || '...', null, null, 2500.0 from events where event_id % 7 = 6"""
_COLUMNS = ["event_id", "format", "ts", "level", "source", "service", "message", "user_id", "ip_address", "duration_ms"]
# nginx status codes run 200, 300, 400, 500 with event_id % 4


@query("parse_logs", _PARSED)
def parse_logs(t):
    out = L.parse_logs(log_lines(t.events), keep=["event_id"]).select(*_COLUMNS)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def entries(t):
    """Events as parsed log entries."""
    return entries_of(t.events)


def entries_of(e):
    return e.select("event_id", F.col("ts"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
                    F.when(F.col("user_id") % 2 == 0, "security").otherwise("application").alias("source"), F.col("event_type").alias("service"),
                    F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (F.col("user_id") % 13).cast("string"))).alias("error_type"),
                    F.col("user_id").cast("string").alias("user_id"), F.col("value").alias("duration_ms"),
                    F.concat(F.lit("ip"), (F.col("user_id") % 4).cast("string")).alias("ip_address"),
                    F.when(F.col("event_type") == "error", "failed_login").otherwise("login").alias("event_type"))


_WINDOWED = f"""with w(win, secs) as (values ('5m', 300), ('1h', 3600), ('24h', 86400)),
    e as (select win as "window", event_id, ts, event_type, user_id, value from events, w where ts <= timestamp '{AS_OF}' and ts >= timestamp '{AS_OF}' - to_seconds(secs))"""


@query("log_stats", _WINDOWED + """
    select "window", count(*) as total, count(*) filter (event_type = 'error') as errors, round(avg(value), 4) as avg_duration_ms,
      round(count(*) filter (event_type = 'error') * 1.0 / count(*), 6) as error_rate from e group by 1""")
def log_stats(t):
    return rounded(rounded(L.log_stats(entries(t), AS_OF), "avg_duration_ms"), "error_rate", n=6)


@query("log_counts", _WINDOWED + """
    , c as (select "window", 'level' as dimension, case event_type when 'error' then 'ERROR' else 'INFO' end as value, count(*) n from e group by all
      union all select "window", 'source', case when user_id % 2 = 0 then 'security' else 'application' end, count(*) from e group by all
      union all select "window", 'service', event_type, count(*) from e group by all
      union all (select * from (select "window", 'error_type', 'E' || (user_id % 13) as v, count(*) n from e where event_type = 'error' group by all) qualify row_number() over (partition by "window" order by n desc, v) <= 5)
      union all (select * from (select "window", 'user_id', user_id::varchar as v, count(*) n from e group by all) qualify row_number() over (partition by "window" order by n desc, v) <= 5))
    select * from c""")
def log_counts(t):
    return L.log_counts(entries(t), AS_OF)


@query("error_surge", """
    with e as (select ts, count(*) over (order by ts range between interval '7199999999 microseconds' preceding and current row) as recent from events where event_type = 'error')
    select ts, count(*) as events, max(recent) as recent from e where recent > 8 group by ts""")
def error_surge(t):
    return L.error_surge(entries(t), 8, 7200).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("brute_force", """
    with e as (select ts, 'ip' || (user_id % 4) as ip_address, event_type, count(*) over (partition by user_id % 4 order by ts range between interval '10799999999 microseconds' preceding and current row) as recent
      from events where user_id % 2 = 0)
    select ip_address, ts, count(*) as events, max(recent) as recent from e group by all having max(recent) > 20 and bool_or(event_type = 'error')""")
def brute_force(t):
    return L.brute_force(entries(t), 20, 10800).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("volume_anomaly", """
    with r as (select time_bucket(interval 30 minutes, ts) as window_start, count(*) / 30.0 as rate from events group by 1)
    select window_start, round(rate, 6) as rate, case when rate > 0.36 then 'high' else 'low' end as anomaly from r where rate > 0.36 or rate < 0.012""")
def volume_anomaly(t):
    out = L.volume_anomaly(entries(t), 0.12, 30)
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "rate", n=6)


@query("error_patterns", "select 'E' || (user_id % 13) as error_type, count(*) as n from events where event_type = 'error' group by 1 order by n desc, 1 limit 10")
def error_patterns(t):
    return L.error_patterns(entries(t))


@query("active_users", "select time_bucket(interval 6 hours, ts) as window_start, count(distinct user_id) as active_users from events group by 1")
def active_users(t):
    return L.active_users(t.events, 6).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("user_sessions", """
    with g as (select user_id, ts, case when ts - lag(ts) over w < interval 5 hours then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
      s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g)
    select user_id, min(ts) as session_start, max(ts) + interval 5 hours as session_end, count(*) as events from s group by user_id, s""")
def user_sessions(t):
    out = L.user_sessions(t.events, "5 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("slow_entries", "select event_id from events where value > 100")
def slow_entries(t):
    return slow(entries(t), 100).select("event_id")


_METRIC = {"error": "system.cpu.usage", "click": "app.requests.duration", "view": "jobs.queue.size", "purchase": "model.accuracy"}


def points(events):
    name = F.lit("unregistered.metric")
    for kind, metric in _METRIC.items():
        name = F.when(F.col("event_type") == kind, metric).otherwise(name)
    value = F.when(F.col("event_type") == "purchase", F.col("value") / 100).otherwise(F.col("value"))
    return events.select("event_id", name.alias("name"), F.col("ts").cast("timestamp").alias("ts"), value.alias("value"),
                         F.create_map(F.lit("zone"), (F.col("user_id") % 3).cast("string")).alias("labels"))


_POINTS = """with p as (select event_id, ts, user_id, case event_type when 'error' then 'system.cpu.usage' when 'click' then 'app.requests.duration' when 'view' then 'jobs.queue.size'
    when 'purchase' then 'model.accuracy' else 'unregistered.metric' end as name, case when event_type = 'purchase' then value / 100 else value end as value from events)"""


@query("metric_rollup", _POINTS + f"""
    , w(win, secs) as (values ('1m', 60), ('5m', 300), ('15m', 900), ('1h', 3600), ('24h', 86400)),
    x as (select name, win as "window", value from p, w where ts <= timestamp '{AS_OF}' and ts >= timestamp '{AS_OF}' - to_seconds(secs) and name <> 'unregistered.metric')
    select name, "window", count(*) as count, case when name not like 'app.%' then round(avg(value), 9) end as value, case when name like 'app.%' then round(avg(value), 9) end as mean,
      case when name like 'app.%' then round(quantile_cont(value, 0.5), 9) end as median, case when name like 'app.%' then round(quantile_cont(value, 0.95), 9) end as p95,
      case when name like 'app.%' then round(quantile_cont(value, 0.99), 9) end as p99, case when name like 'app.%' then min(value) end as min, case when name like 'app.%' then max(value) end as max
    from x group by "window", name""")
def metric_rollup(t):
    return rounded(M.rollup_at(points(t.events), M.definitions(t.spark), AS_OF), "value", "mean", "median", "p95", "p99", n=9)


@query("metric_trailing", _POINTS + """
    , b as (select name, floor(epoch_us(ts) / 3600000000.0)::bigint as b, count(*) n, sum(value) s, min(value) lo, max(value) hi from p group by all)
    select name, to_timestamp((b + 1) * 3600)::timestamp as window_end, sum(n) over w::bigint as count, round(sum(s) over w, 4) as total, min(lo) over w as min, max(hi) over w as max
    from b window w as (partition by name order by b range between 23 preceding and current row)""")
def metric_trailing(t):
    out = M.trailing_rollup(points(t.events), 86400, 3600)
    total = F.round(F.col("avg") * F.col("count"), 4).alias("total")
    return out.select("name", F.col("window_end").cast("timestamp_ntz").alias("window_end"), "count", total, "min", "max")


@query("metric_dropped", "select 'unregistered.metric' as name, count(*) as dropped from events where event_type = 'signup'")
def metric_dropped(t):
    return M.dropped_points(points(t.events), M.definitions(t.spark))


_HITS = _POINTS + """
    , d(name, level, threshold, below) as (values ('system.cpu.usage', 'warning', 80.0, false), ('system.cpu.usage', 'critical', 95.0, false), ('jobs.queue.size', 'warning', 100.0, false),
      ('jobs.queue.size', 'critical', 500.0, false), ('model.accuracy', 'warning', 0.8, true), ('model.accuracy', 'critical', 0.7, true)),
    h as (select p.*, level, threshold, case when below then value < threshold else value > threshold end as hit from p join d using (name)),
    l as (select *, lag(hit) over (partition by name, level order by ts, event_id) as before from h), c as (select * from l where hit <> coalesce(before, false)),
    r as (select *, lead(ts) over (partition by name, level order by ts, event_id) as resolved_at from c)"""


@query("alert_episodes", _HITS + " select name, level, threshold::double as threshold, ts as triggered_at, value, resolved_at from r where hit")
def alert_episodes(t):
    out = M.alert_episodes(points(t.events), M.definitions(t.spark), ["event_id"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("triggered_at", "resolved_at")})


_HEADS = ", ".join(f"('{name}', '{kind}', '{told}')" for name, kind, _, told, _, _ in M.DEFINITIONS)


@query("prometheus_text", _POINTS + f"""
    , last as (select name, user_id % 3 as zone, arg_max(value, (ts, value)) as v from p where name <> 'unregistered.metric' group by all),
    d(name, kind, told) as (values {_HEADS})
    select name, 2 as part, name || '{{zone="' || zone || '"}}' as series, round(v, 6) as value from last
    union all select name, 0, '# HELP ' || name || ' ' || told, null from d union all select name, 1, '# TYPE ' || name || ' ' || kind, null from d""")
def prometheus_text(t):
    lines = M.to_prometheus(points(t.events), M.definitions(t.spark))
    parts, sample = F.split("line", " "), F.col("part") == 2
    value = F.when(sample, F.round(parts[1].try_cast("double"), 6))
    return lines.select("name", "part", F.when(sample, parts[0]).otherwise(F.col("line")).alias("series"), value.alias("value"))


@query("metric_retention", "select event_id from events where ts >= timestamp '2024-01-30' - interval 10 days")
def metric_retention(t):
    return M.retention(t.events, None, "2024-01-30", 10).select("event_id")


COOL = [
    parse_rule({"rule_id": "slow", "name": "slow", "priority": 1, "cooldown_seconds": 3600, "conditions": {"field": "value", "operator": "greater_than", "value": 50}, "actions": [{"action_type": "alert", "parameters": {}}]}),
    parse_rule({"rule_id": "err", "name": "err", "priority": 2, "conditions": {"field": "event_type", "operator": "equals", "value": "error"}, "actions": [{"action_type": "alert", "parameters": {}}]}),
    parse_rule({"rule_id": "day", "name": "day", "priority": 3, "cooldown_seconds": 86400, "conditions": {"field": "user_id", "operator": "less_than", "value": 50}, "actions": [{"action_type": "alert", "parameters": {}}]}),
]
_COOL = """
    with recursive m(rule_id, wait, ts, key) as (select 'slow', 3600, ts, event_id from events where value > 50 union all select 'day', 86400, ts, event_id from events where user_id < 50),
    f(rule_id, wait, ts, key) as (select * from (select rule_id, wait, min(ts), arg_min(key, (ts, key)) from m group by all)
      union all select f.rule_id, f.wait, x.ts, x.key from f, lateral (select min(m.ts) ts, arg_min(m.key, (m.ts, m.key)) as key from m where m.rule_id = f.rule_id and m.ts >= f.ts + to_seconds(f.wait)) x where x.ts is not null)
    select rule_id, key, ts from f union all select 'err', event_id, ts from events where event_type = 'error'"""


@query("rule_cooldown", _COOL)
def rule_cooldown(t):
    return RS.with_cooldown(t.events, COOL, "event_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- streams -----------------------------------------------------------------------------------


def event_stream(t):
    """The events table as a stream."""
    return S.stream_table(t.spark, t.folder, "events.parquet", t.events.schema)


@query("stream_rule_cooldown", _COOL)
def stream_rule_cooldown(t):
    out = S.run_to_end(RS.rule_stream(event_stream(t), COOL, "event_id"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_alerts", _HITS + " select name, level, case when hit then 'open' else 'resolve' end as event, ts, value from c")
def stream_alerts(t):
    out = S.run_to_end(M.alerts(points(event_stream(t)), M.definitions(t.spark)))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_rule_cooldown_by_batch", _COOL)
def stream_rule_cooldown_by_batch(t):
    return B.rules_by_batch(event_stream(t), COOL, "event_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_alerts_by_batch", _HITS + " select name, level, case when hit then 'open' else 'resolve' end as event, ts, value from c")
def stream_alerts_by_batch(t):
    out = B.alerts_by_batch(points(event_stream(t)), M.definitions(t.spark), ["event_id"])
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_metric_rollup", _POINTS + """
    select name, time_bucket(interval 1 hour, ts) as window_start, count(*) as count, round(avg(value), 9) as avg, min(value) as min, max(value) as max
    from p where name <> 'unregistered.metric' group by all""")
def stream_metric_rollup(t):
    out = S.run_to_end(M.rollup_metrics(points(event_stream(t)), M.definitions(t.spark), "1 hour"), "complete")
    out = out.select("name", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "count", "avg", "min", "max")
    return rounded(out, "avg", n=9)


@query("stream_parse_logs", _PARSED)
def stream_parse_logs(t):
    out = S.run_to_end(L.parse_logs(log_lines(event_stream(t)), keep=["event_id"])).select(*_COLUMNS)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_window_counts", "select time_bucket(interval 1 day, ts) as window_start, event_type as level, count(*) as n from events group by all")
def stream_window_counts(t):
    events = event_stream(t).withColumnRenamed("event_type", "level")
    out = S.run_to_end(L.windowed_counts(events, "1 day"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "level", "n")


@query("stream_dedup", "select props, count(*) as n from (select distinct props, user_id % 5 as u from events) group by 1")
def stream_dedup(t):
    logs = event_stream(t).select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "props", (F.col("user_id") % 5).cast("string")).alias("log_id"), "props")
    # the watermark spans the whole month, so every repeat is still remembered
    return S.run_to_end(L.dedup_stream(logs, "60 days")).groupBy("props").agg(F.count(F.lit(1)).alias("n"))


@query("stream_clean", "select event_id, upper(event_type) as event_type, substr(sha256(user_id::varchar), 1, 8) as user_id from events")
def stream_clean(t):
    messy = event_stream(t).select("event_id", F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")).alias("event_type"), "user_id")
    return S.run_to_end(K.trim_text(messy).withColumn("user_id", short_hash(F.col("user_id"))))


_TRAILING_USERS = """
    with h as (select distinct time_bucket(interval 1 hour, ts) + interval 1 hour as cell, user_id from events),
      w as (select cell + to_hours(i) as window_end, user_id from h, range(24) r(i))
    select window_end, count(distinct user_id) as users, true as close from w group by 1"""


def _users_checked(cells, events):
    """Estimated users of the last 24 hours at every hour, beside the true number and whether they are close."""
    found = SK.trailing(cells, "24 hours", "1 hour").select("window_end", F.col("users").alias("estimate"))
    hours = events.select((F.date_trunc("hour", F.col("ts").cast("timestamp")) + F.expr("interval 1 hour")).alias("cell"), "user_id").distinct()
    ends = F.explode(F.sequence("cell", F.col("cell") + F.expr("interval 23 hours"), F.expr("interval 1 hour"))).alias("window_end")
    true = hours.select(ends, "user_id").distinct().groupBy("window_end").agg(F.count("user_id").alias("users"))
    close = F.abs(F.col("estimate") - F.col("users")) <= F.col("users") * SK.DISTINCT_ERROR + 1
    return true.join(found, "window_end", "left").select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "users", F.coalesce(close, F.lit(False)).alias("close"))


@query("active_users_trailing", _TRAILING_USERS)
def active_users_trailing(t):
    return _users_checked(SK.cells(t.events, "1 hour", user="user_id"), t.events)


@query("stream_active_users", _TRAILING_USERS)
def stream_active_users(t):
    """Hourly sketches kept by a stream, merged over the last 24 hours at every hour."""
    return _users_checked(S.run_to_end(SK.cells(event_stream(t), "1 hour", user="user_id"), "complete"), t.events)


_SIZES = {"1 hour": "10 minutes", "6 hours": "1 hour", "24 hours": "1 hour"}
_TRAILING_QUANTILES = " union all ".join(f"""
    select window_end, event_type, '{size}' as size, count(*) as n, round(sum(value), 4) as total, min(value) as least, max(value) as greatest, arg_max(value, ts) as last, true as close
    from (select time_bucket(interval {step}, ts) + interval {step} * (1 + i) as window_end, event_type, value, ts from events, range({steps}) r(i))
    group by 1, 2""" for (size, step), steps in zip(_SIZES.items(), (6, 6, 24)))


def _quantiles_checked(cells, events):
    """Trailing windows of three sizes per event type; ``close`` says whether the ranks of p50, p95 and p99 are within the bound."""
    found = SK.trailing_sizes(cells, _SIZES, ["event_type"])
    parts = []
    for size, step in _SIZES.items():
        cell = F.window(F.col("ts").cast("timestamp"), step)["end"]
        ends = F.explode(F.sequence(cell, cell + F.expr(f"interval {size}") - F.expr(f"interval {step}"), F.expr(f"interval {step}"))).alias("window_end")
        parts.append(events.select("event_type", F.col("value").cast("double").alias("value"), ends).withColumn("size", F.lit(size)))
    points = parts[0].unionByName(parts[1]).unionByName(parts[2])
    keys = ["window_end", "event_type", "size"]
    joined = points.join(found, keys)
    close = F.lit(True)
    for r in (0.5, 0.95, 0.99):
        p = f"p{round(r * 100)}"
        below, upto = F.avg((F.col("value") < F.col(p)).cast("int")), F.avg((F.col("value") <= F.col(p)).cast("int"))
        close = close & (below <= r + SK.RANK_ERROR) & (upto >= r - SK.RANK_ERROR)
    ranked = joined.groupBy(*keys).agg(close.alias("close"))
    out = found.join(ranked, keys, "left").select(*keys, "n", "total", "least", "greatest", "last", F.coalesce("close", F.lit(False)).alias("close"))
    return rounded(out.withColumn("window_end", F.col("window_end").cast("timestamp_ntz")), "total")


@query("metric_trailing_quantiles", _TRAILING_QUANTILES)
def metric_trailing_quantiles(t):
    return _quantiles_checked(SK.cells(t.events, "10 minutes", ["event_type"], value="value"), t.events)


@query("stream_metric_trailing_quantiles", _TRAILING_QUANTILES)
def stream_metric_trailing_quantiles(t):
    return _quantiles_checked(S.run_to_end(SK.cells(event_stream(t), "10 minutes", ["event_type"], value="value"), "complete"), t.events)


# --- watches over a stream of entries --------------------------------------------------------------


@query("stream_error_surge", ORACLES["error_surge"])
def stream_error_surge(t):
    out = B.surges_by_batch(entries_of(event_stream(t)), 8, 7200)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_brute_force", ORACLES["brute_force"])
def stream_brute_force(t):
    out = B.brute_force_by_batch(entries_of(event_stream(t)), 20, 10800)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_volume_anomaly", """
    with r as (select time_bucket(interval 30 minutes, ts) as window_start, count(*) / 30.0 as rate from events group by 1)
    select window_start, round(rate, 6) as rate, case when rate > 0.36 then 'high' else 'low' end as anomaly from r
    where (rate > 0.36 or rate < 0.012) and window_start + interval 30 minutes <= (select max(ts) from events) - interval 1 hour""")
def stream_volume_anomaly(t):
    out = S.run_to_end(L.volume_anomaly(entries_of(event_stream(t)), 0.12, 30, "1 hour"))
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "rate", n=6)


def cells(t):
    """Closed cells of the stream of entries."""
    return S.run_to_end(L.log_cells(entries_of(event_stream(t)), "10 minutes"))


_CLOSED = f"""with w(win, secs) as (values ('5m', 300), ('1h', 3600), ('24h', 86400)),
    e as (select win as "window", event_id, ts, event_type, user_id, value from events, w where ts < timestamp '{AS_OF}' and ts >= timestamp '{AS_OF}' - to_seconds(secs)
      and date_trunc('minute', ts) + interval 1 minute <= (select max(ts) from events) - interval 10 minutes)"""


@query("stream_log_stats", _CLOSED + ORACLES["log_stats"][len(_WINDOWED):])
def stream_log_stats(t):
    return rounded(rounded(L.stats_of_cells(cells(t), AS_OF), "avg_duration_ms"), "error_rate", n=6)


@query("stream_log_counts", _CLOSED + ORACLES["log_counts"][len(_WINDOWED):])
def stream_log_counts(t):
    return L.counts_of_cells(cells(t), AS_OF)


@query("stream_error_patterns", """
    select 'E' || (user_id % 13) as error_type, count(*) as n from events
    where event_type = 'error' and date_trunc('day', ts) + interval 1 day <= (select max(ts) from events where event_type = 'error') - interval 1 hour group by 1 order by n desc, 1 limit 10""")
def stream_error_patterns(t):
    """Most frequent error types of all closed days."""
    errors = entries_of(event_stream(t)).where("level = 'ERROR'")
    daily = S.run_to_end(L.windowed_counts(errors, "1 day", watermark="1 hour", by=["error_type"]))
    return daily.groupBy("error_type").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc("error_type")).limit(10)


@query("stream_metric_rollups", _POINTS + """
    , w(size, secs) as (values ('1m', 60), ('5m', 300), ('15m', 900), ('1h', 3600), ('24h', 86400)),
    k as (select * from p where name <> 'unregistered.metric'), x as (select *, time_bucket(to_seconds(secs), ts) as window_start from k, w)
    select size, name, window_start, count(*) as count, round(avg(value), 9) as avg, min(value) as min, max(value) as max from x
    where window_start + to_seconds(secs) <= (select max(ts) from p) - interval 10 minutes group by all""")
def stream_metric_rollups(t):
    """Closed windows of every size, one stream each."""
    defs, out = M.definitions(t.spark), None
    for size, seconds in M.WINDOWS.items():
        one = S.run_to_end(M.rollup_metrics(points(event_stream(t)), defs, f"{seconds} seconds", watermark="10 minutes"))
        one = one.select(F.lit(size).alias("size"), "name", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "count", "avg", "min", "max")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "avg", n=9)


_ARRIVALS = """
    with a as (select *, least(4, greatest(0, date_diff('day', date '2024-01-01', ts::date) // 6 + case when event_id % 7 = 0 then 1 else 0 end)) as epoch from events),
    m as (select epoch, max(max(ts)) over (order by epoch rows between unbounded preceding and 1 preceding) - interval 1 day as mark from a group by epoch),
    r as (select a.*, mark, coalesce(ts < mark, false) as late from a join m using (epoch))"""


def late_parts(t):
    """The events in five arrivals of six days each, one trigger after another; every seventh comes an arrival too late."""
    place = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    came = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(place / 6) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)))
    folder = f"{shared_dir(t.spark)}/arrivals-{uuid.uuid4().hex}"
    out = None
    for arrival in range(5):
        t.events.where(came == arrival).write.mode("append").parquet(f"{folder}/in")
        out = split_late(S.stream_table(t.spark, f"{folder}/in", "*.parquet", t.events.schema), "ts", "1 day", f"{folder}/out")
    return out


@query("stream_late_rows", _ARRIVALS + " select event_id, ts, user_id, event_type, value, epoch, late from r")
def stream_late_rows(t):
    in_time, late, _ = late_parts(t)
    both = in_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "epoch", "late")


@query("stream_late_counts", _ARRIVALS + " select epoch, mark, count_if(not late)::bigint as on_time, count_if(late)::bigint as late from r group by epoch, mark")
def stream_late_counts(t):
    return late_parts(t)[2].withColumn("mark", F.col("mark").cast("timestamp_ntz"))
