"""Log lines to structured rows, and what is counted and watched over them.

``parse_logs`` is stateless column work and runs unchanged on a stream.  The watch functions come
as exact batch forms; the windowed forms for streams are beside them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.operators.ordered import ordered_scan
from sievemill.operators.relational import _moment

# --- fixed values: severity of levels, names of sources -------------------------------------------
LEVELS = {"TRACE": 0, "DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
SOURCES = ("application", "system", "database", "webserver", "security", "audit", "performance")
# -----------------------------------------------------------------------------------------------

# --- fixed values: line formats, tried in this order ----------------------------------------------
APPLICATION = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - (\w+) - \[([^\]]+)\] - (.+)"
NGINX = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([^"]+)" (\d+) (\d+) "([^"]*)" "([^"]*)"'
SLOW_QUERY = r"(?s)^# Time: (\S+ \S+).*?# Query_time: ([\d.]+).*?# Rows_examined: (\d+).*?\n(.+?)(?=\n#|\z)"
SECURITY = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z) \[(\w+)\] (\w+): (.+) \| user=(\S+) ip=(\S+)"
JSON_OBJECT = r"^\{.*\}$"
# -----------------------------------------------------------------------------------------------

_FIELDS = {
    "ts": "timestamp", "level": "string", "source": "string", "service": "string", "message": "string", "user_id": "string",
    "session_id": "string", "request_id": "string", "ip_address": "string", "metadata": "map<string,string>", "tags": "array<string>",
    "error_type": "string", "stack_trace": "string", "duration_ms": "double",
}
_JSON = (
    "timestamp string, level string, source string, service string, message string, user_id string, session_id string, request_id string, "
    "ip_address string, metadata map<string,string>, tags array<string>, error_type string, stack_trace string, duration_ms double"
)


@dataclass(frozen=True)
class LogPattern:
    """One line format: the regex that recognises it and the fields it yields.

    With ``groups`` the regex runs once per line and ``build`` gets the array of its groups; without,
    ``build`` gets the line.
    """

    name: str
    regex: str
    source: str
    build: Callable[[Column], dict[str, Column]]
    groups: int = 0


def _entry(**fields: Column) -> Column:
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS.items()])


_MARK = "\u0001"


def _groups(line: Column, regex: str, n: int) -> Column:
    """All groups of the first match, from one run of the regex: the match and the rest of the line
    are replaced by the groups with a mark between them."""
    marked = F.regexp_replace(line, regex + r"(?s:.*)\z", _MARK.join(f"${i}" for i in range(1, n + 1)))
    return F.split(marked, _MARK)


def _application(g: Column) -> dict[str, Column]:
    user = F.regexp_extract(g[4], r"user_id=(\S+)", 1)
    return {
        "ts": F.try_to_timestamp(F.concat(g[0], F.lit("."), g[1]), F.lit("yyyy-MM-dd HH:mm:ss.SSS")),
        "level": F.upper(g[2]), "source": F.lit("application"), "service": g[3], "message": g[4],
        "metadata": F.when(user != "", F.create_map(F.lit("user_id"), user)),
    }


def _nginx(g: Column) -> dict[str, Column]:
    status = g[3].try_cast("int")
    words = F.split(g[2], r"\s+")
    return {
        "ts": F.try_to_timestamp(g[1], F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
        "level": F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO"),
        "source": F.lit("webserver"), "service": F.lit("nginx"), "message": g[2], "ip_address": g[0],
        "metadata": F.create_map(
            F.lit("method"), F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit("path"), F.coalesce(F.get(words, F.lit(1)), F.lit("")),
            F.lit("status_code"), g[3], F.lit("response_size"), g[4], F.lit("referer"), g[5], F.lit("user_agent"), g[6],
        ),
    }


def _slow_query(g: Column) -> dict[str, Column]:
    text = F.trim(g[3])
    return {
        "ts": F.try_to_timestamp(g[0], F.lit("yyMMdd HH:mm:ss")), "level": F.lit("WARNING"), "source": F.lit("database"),
        "service": F.lit("mysql"), "message": F.concat(F.lit("Slow query: "), F.substring(text, 1, 100), F.lit("...")),
        "duration_ms": g[1].try_cast("double") * 1000,
        "metadata": F.create_map(F.lit("query"), text, F.lit("query_time"), g[1], F.lit("rows_examined"), g[2]),
    }


def _security(g: Column) -> dict[str, Column]:
    return {
        "ts": g[0].try_cast("timestamp"), "level": F.upper(g[1]), "source": F.lit("security"), "service": F.lit("security"),
        "message": g[3], "user_id": g[4], "ip_address": g[5], "metadata": F.create_map(F.lit("event_type"), g[2]),
        "tags": F.array(F.lit("security"), F.lower(g[2])),
    }


def _json(line: Column) -> dict[str, Column]:
    data = F.from_json(line, _JSON)
    out = {n: data[n] for n in _FIELDS if n not in ("ts", "level", "source", "service", "message")}
    return out | {
        "ts": data["timestamp"].try_cast("timestamp"), "level": F.upper(F.coalesce(data["level"], F.lit("INFO"))),
        "source": F.coalesce(data["source"], F.lit("application")), "service": F.coalesce(data["service"], F.lit("unknown")),
        "message": F.coalesce(data["message"], F.lit("")),
    }


PATTERNS: list[LogPattern] = [
    LogPattern("application", APPLICATION, "application", _application, 5),
    LogPattern("nginx_access", NGINX, "webserver", _nginx, 7),
    LogPattern("slow_query", SLOW_QUERY, "database", _slow_query, 4),
    LogPattern("security_audit", SECURITY, "security", _security, 6),
    LogPattern("json_structured", JSON_OBJECT, "application", _json),
]


def register_log_pattern(name: str, regex: str, source: str, build: Callable[[Column], dict[str, Column]]) -> None:
    """Add a line format, tried after the built-in ones."""
    PATTERNS.append(LogPattern(name, regex, source, build))


def parse_logs(lines: DataFrame, column: str = "value", source: str | None = None, received: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Structured entries of text lines.

    The first format that matches reads the line; anything else becomes an INFO entry with the whole
    line.  Blank lines, unreadable JSON and unknown levels or sources are dropped.  ``received``
    stamps entries that carry no time of their own.
    """
    line = F.trim(F.col(column))
    # blank space of any kind around the line counts, not just spaces
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    used = [p for p in PATTERNS if source is None or p.source == source]
    which = None
    for p in used:
        which = F.when(F.col("_line").rlike(p.regex), F.lit(p.name)) if which is None else which.when(F.col("_line").rlike(p.regex), F.lit(p.name))
    named = lines.select(*keep, line.alias("_line")).where(F.col("_line") != "")
    named = named.withColumn("_format", F.lit("raw") if which is None else which.otherwise("raw"))
    cut_up = None
    for p in used:
        if p.groups:
            test, made = F.col("_format") == p.name, _groups(F.col("_line"), p.regex, p.groups)
            cut_up = F.when(test, made) if cut_up is None else cut_up.when(test, made)
    named = named.withColumn("_groups", F.lit(None).cast("array<string>") if cut_up is None else cut_up)
    raw = _entry(level=F.lit("INFO"), source=F.lit(source or "application"), service=F.lit("unknown"), message=F.col("_line"))
    entry = None
    for p in used:
        made = _entry(**p.build(F.col("_groups") if p.groups else F.col("_line")))
        test = F.col("_format") == p.name
        entry = F.when(test, made) if entry is None else entry.when(test, made)
    entry = raw if entry is None else entry.otherwise(raw)
    # generated rows are a border for the optimizer: the filter on level and source stays behind it,
    # instead of building every entry a second time in front
    out = named.select(*keep, F.col("_format").alias("format"), "_line", F.inline(F.array(entry)))
    known = F.col("level").isin(*LEVELS) & F.col("source").isin(*SOURCES)
    broken = (F.col("format") == "json_structured") & F.get_json_object("_line", "$").isNull()
    out = out.where(known & ~broken).drop("_line")
    if received is not None:
        out = out.withColumn("ts", F.coalesce(F.col("ts"), received))
    ident = F.concat_ws("|", F.coalesce(F.col("ts").cast("string"), F.lit("")), "level", "source", "message")
    return out.withColumn("log_id", F.md5(ident))


def severity(level: Column) -> Column:
    """Number of a level, for ordering and bounds."""
    out = None
    for name, n in LEVELS.items():
        out = F.when(level == name, n) if out is None else out.when(level == name, n)
    return out


# --- fixed values: statistics windows, in seconds -------------------------------------------------
STAT_WINDOWS = {"5m": 300, "1h": 3600, "24h": 86400}
# -----------------------------------------------------------------------------------------------


#: what entries are counted by
DIMENSIONS = {"level": "level", "source": "source", "service": "service", "error_type": "error_type", "user_id": "user_id"}


def log_stats(logs: DataFrame, as_of, windows: dict[str, int] = STAT_WINDOWS) -> DataFrame:
    """One row per trailing window: total, errors, error rate, mean duration."""
    return _in_windows(logs, as_of, windows).groupBy("window").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"),
        F.avg(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))).alias("avg_duration_ms"),
    ).withColumn("error_rate", F.col("errors") / F.col("total"))


def log_counts(logs: DataFrame, as_of, windows: dict[str, int] = STAT_WINDOWS, top: int = 5) -> DataFrame:
    """Counts by level, source and service, and the top error types and users, per trailing window.

    All five groupings share one shuffle of (window, dimension, value) counts.
    """
    long = _in_windows(logs, as_of, windows).select(
        "window", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in DIMENSIONS.items()])).alias("x")
    ).select("window", "x.*").where(F.coalesce(F.col("value"), F.lit("")) != "")
    counted = long.groupBy("window", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return _listed(counted, top)


def _listed(counted: DataFrame, top: int) -> DataFrame:
    """All levels, sources and services, and the most frequent error types and users."""
    w = Window.partitionBy("window", "dimension").orderBy(F.desc("n"), F.asc("value"))
    listed = counted.where(F.col("dimension").isin("error_type", "user_id")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")
    return counted.where(~F.col("dimension").isin("error_type", "user_id")).unionByName(listed)


def log_cells(logs: DataFrame, watermark: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """Counts per small event-time window, dimension and value, from which any trailing window is summed up.

    On a stream a window's cells come out once the watermark has passed its end, and leave the state then.  The
    dimension ``all`` holds every entry by its level, with the sum and number of its durations.
    """
    timed = logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    cell = [F.struct(F.lit("all").alias("dimension"), F.coalesce("level", F.lit("")).alias("value"))]
    cell += [F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in DIMENSIONS.items()]
    long = timed.select("ts", F.when(F.col("duration_ms") > 0, F.col("duration_ms")).alias("ms"), F.explode(F.array(*cell)).alias("x"))
    long = long.where((F.col("x.dimension") == "all") | (F.coalesce("x.value", F.lit("")) != ""))
    counted = long.groupBy(F.window("ts", every).alias("w"), "x.dimension", "x.value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"), F.count("ms").alias("n_ms")
    )
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "dimension", "value", "n", "ms", "n_ms")


def _cells_in_windows(cells: DataFrame, as_of, windows: dict[str, int]) -> DataFrame:
    """Cells that lie within each trailing window that ends at ``as_of``, that moment itself left out."""
    end = _moment(as_of).cast("timestamp")
    age = F.unix_micros(end) - F.unix_micros("window_start")
    names = F.filter(F.array(*[F.when(age <= s * 1_000_000, F.lit(n)) for n, s in windows.items()]), lambda x: x.isNotNull())
    return cells.where(F.col("window_end") <= end).withColumn("window", F.explode(names))


def stats_of_cells(cells: DataFrame, as_of, windows: dict[str, int] = STAT_WINDOWS) -> DataFrame:
    """``log_stats`` from cells; ``as_of`` is a moment at which a cell ends."""
    n_errors = F.when(F.col("value").isin("ERROR", "CRITICAL"), F.col("n")).otherwise(0)
    return _cells_in_windows(cells.where("dimension = 'all'"), as_of, windows).groupBy("window").agg(
        F.sum("n").alias("total"), F.sum(n_errors).alias("errors"), (F.sum("ms") / F.sum("n_ms")).alias("avg_duration_ms"),
    ).withColumn("error_rate", F.col("errors") / F.col("total"))


def counts_of_cells(cells: DataFrame, as_of, windows: dict[str, int] = STAT_WINDOWS, top: int = 5) -> DataFrame:
    """``log_counts`` from cells; ``as_of`` is a moment at which a cell ends."""
    inside = _cells_in_windows(cells.where("dimension <> 'all'"), as_of, windows)
    return _listed(inside.groupBy("window", "dimension", "value").agg(F.sum("n").alias("n")), top)


def _in_windows(logs: DataFrame, as_of, windows: dict[str, int]) -> DataFrame:
    end = _moment(as_of)
    age = F.unix_micros(end) - F.unix_micros(F.col("ts").cast("timestamp"))
    widest = max(windows.values())
    kind = dict(logs.dtypes)["ts"]
    recent = logs.where(F.col("ts").between((end - F.expr(f"INTERVAL {widest} SECONDS")).cast(kind), end.cast(kind)))
    names = F.filter(F.array(*[F.when(age <= s * 1_000_000, F.lit(n)) for n, s in windows.items()]), lambda x: x.isNotNull())
    return recent.withColumn("window", F.explode(names))


def trailing_counts(events: DataFrame, ts: str, seconds: int, part: Sequence[str] = ()) -> DataFrame:
    """Events of the last ``seconds`` (the current moment included) at every moment with an event.

    Each moment adds its events and takes them away again ``seconds`` later; the running sum of
    these changes is the trailing count.  Events of one moment are combined first, and a key with
    most of the events is scanned in chunks.
    """
    micros = events.select(*part, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    counted = micros.groupBy(*part, "at").agg(F.count(F.lit(1)).alias("n"))
    return trailing_sums(counted, seconds, part).select(*part, F.timestamp_micros("at").alias(ts), "events", "recent")


def trailing_sums(counted: DataFrame, seconds: int, part: Sequence[str] = ()) -> DataFrame:
    """``trailing_counts`` from the number ``n`` of events per key and moment ``at`` (microseconds)."""
    change = counted.select(
        *part,
        F.explode(F.array(
            F.struct("at", F.col("n").alias("d"), "n"),
            F.struct((F.col("at") + seconds * 1_000_000).alias("at"), (-F.col("n")).alias("d"), F.lit(0).cast("bigint").alias("n")),
        )).alias("x"),
    ).select(*part, "x.*")
    net = change.groupBy(*part, "at").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    summed = ordered_scan(net, ["at"], part, sums={"recent": F.col("d")})
    return summed.where(F.col("n") > 0).select(*part, "at", F.col("n").alias("events"), "recent")


def error_surge(logs: DataFrame, n: int = 10, seconds: int = 60) -> DataFrame:
    """Moments at which more than ``n`` errors lie in the trailing ``seconds``."""
    errors = logs.where(F.col("level").isin("ERROR", "CRITICAL"))
    return trailing_counts(errors, "ts", seconds).where(F.col("recent") > n)


# --- fixed values: security events that can start a brute-force alert ------------------------------
TRIGGERS = ("failed_login", "unauthorized_access")
# -----------------------------------------------------------------------------------------------


def brute_force(logs: DataFrame, n: int = 5, seconds: int = 300) -> DataFrame:
    """Addresses with more than ``n`` security events in the trailing ``seconds``, at moments with a
    failed login or unauthorised access.  Expects ts, source, ip_address, event_type."""
    events = logs.where((F.col("source") == "security") & F.col("ip_address").isNotNull())
    busy = trailing_counts(events, "ts", seconds, ["ip_address"]).where(F.col("recent") > n)
    starts = events.where(F.col("event_type").isin(*TRIGGERS)).select("ip_address", F.col("ts").cast("timestamp").alias("ts")).distinct()
    return busy.join(starts, ["ip_address", "ts"], "left_semi")


def volume_anomaly(logs: DataFrame, expected: float, minutes: int = 5, watermark: str | None = None) -> DataFrame:
    """Windows whose rate per minute is over 3 x or under 0.1 x the expected rate; with a watermark, closed windows
    of a stream."""
    timed = logs.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("ts", watermark)
    rates = timed.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(
        (F.count(F.lit(1)) / minutes).alias("rate")
    )
    kind = F.when(F.col("rate") > expected * 3, "high").when(F.col("rate") < expected * 0.1, "low")
    return rates.select(F.col("w.start").alias("window_start"), "rate", kind.alias("anomaly")).where(F.col("anomaly").isNotNull())


def error_patterns(logs: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent error types of error entries."""
    errors = logs.where(F.col("level").isin("ERROR", "CRITICAL"))
    kind = F.coalesce("error_type", F.lit("unknown_error"))
    return errors.groupBy(kind.alias("error_type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("error_type")).limit(k)


def windowed_counts(logs: DataFrame, size: str, slide: str | None = None, watermark: str | None = None, by: Sequence[str] = ("level",)) -> DataFrame:
    """Counts per event-time window, for batch and stream alike."""
    timed = logs.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("ts", watermark)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n"
    )


def dedup_stream(logs: DataFrame, watermark: str = "10 minutes", keys: Sequence[str] = ("log_id",)) -> DataFrame:
    """Repeated entries dropped; on a stream the watermark bounds the state."""
    if logs.isStreaming:
        return logs.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))
    return logs.dropDuplicates(list(keys))


def active_users(events: DataFrame, hours: int, ts: str = "ts", user: str = "user_id", exact: bool = True) -> DataFrame:
    """Distinct users per window of ``hours``; streams need the approximate count."""
    users = F.count_distinct(user) if exact else F.approx_count_distinct(user)
    return events.groupBy(F.window(F.col(ts).cast("timestamp"), f"{hours} hours").alias("w")).agg(users.alias("active_users")).select(
        F.col("w.start").alias("window_start"), "active_users"
    )


def user_sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """Activity sessions per user, split by a pause."""
    return events.groupBy(user, F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events"
    )
