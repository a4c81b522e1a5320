"""Filters, search, sorting, paging, joins and retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.columns import snake_case

# --- fixed values: well-known short column names -----------------------------------------------
DEFAULT_MAPPING = {
    "fname": "first_name",
    "lname": "last_name",
    "dob": "date_of_birth",
    "addr": "address",
    "phone": "phone_number",
    "email": "email_address",
    "amt": "amount",
    "qty": "quantity",
}
# -----------------------------------------------------------------------------------------------


def map_columns(df: DataFrame, mapping: Mapping[str, str] = DEFAULT_MAPPING) -> DataFrame:
    """Rename by dictionary, else to snake case; a name already taken gets a numeric suffix."""
    taken: set[str] = set()
    names = []
    for c in df.columns:
        base = mapping.get(c.lower().strip(), snake_case(c)) or "column"
        name, n = base, 2
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name)
        names.append(name)
    return df.toDF(*names)


def search(df: DataFrame, term: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with ``term`` in any column, case ignored."""
    tests = [F.lower(F.col(c).cast("string")).contains(term.lower()) for c in (cols or df.columns)]
    return df.where(F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), tests), F.lit(False)))


def filter_eq(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; an argument that is None does not filter.  ``a__b`` reads JSON field b of a."""
    for name, value in wanted.items():
        if value is None:
            continue
        if "__" in name and name not in df.columns:
            column, path = name.split("__", 1)
            df = df.where(F.get_json_object(column, "$." + path.replace("__", ".")) == F.lit(str(value)))
        else:
            df = df.where(F.col(name) == F.lit(value))
    return df


def _moment(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def since(df: DataFrame, ts: str, period: int | str, as_of) -> DataFrame:
    """Rows of the last N days, or of today / week / month / all, seen from ``as_of``."""
    if period == "all":
        return df
    end = _moment(as_of)
    if period == "today":
        start = F.date_trunc("day", end)
    else:
        days = {"day": 1, "week": 7, "month": 30, "year": 365}.get(period, period)
        start = end - F.expr(f"INTERVAL {int(days)} DAYS")
    # the bound takes the column's own type, so that it reaches the scan as a pushed filter
    kind = dict(df.dtypes)[ts]
    return df.where(F.col(ts) >= start.cast(kind))


def usage_type(reason: Column) -> Column:
    """Class of a token transaction by its reason text; the first hit wins."""
    text = F.lower(reason)
    return (
        F.when(text.contains("generat"), "generation")
        .when(text.contains("train") | text.contains("model"), "training")
        .when(text.contains("predict"), "prediction")
        .when(text.contains("purchase"), "purchase")
        .when(text.contains("bonus") | text.contains("reward"), "bonus")
        .otherwise("other")
    )


def of_usage_type(df: DataFrame, kind: str, reason: str = "reason", change: str = "change") -> DataFrame:
    """Transactions of one class by substring; purchase and bonus must also add tokens."""
    text = F.lower(F.coalesce(F.col(reason), F.lit("")))
    tests = {
        "generation": text.contains("generat"),
        "training": text.contains("train") | text.contains("model"),
        "prediction": text.contains("predict"),
        "purchase": text.contains("purchase") & (F.col(change) > 0),
        "bonus": (text.contains("bonus") | text.contains("reward")) & (F.col(change) > 0),
    }
    return df.where(tests[kind]) if kind in tests else df


def readable_by(df: DataFrame, user: str, action: str = "read", prefix: str | None = None, provider: str | None = None) -> DataFrame:
    """Objects ``user`` may act on: owner, else the user's own entry, else the public one."""
    granted = F.coalesce(F.element_at("permissions", F.lit(user)), F.element_at("permissions", F.lit("*")))
    allowed = (F.col("owner") == user) | F.array_contains(F.split(granted, ","), action)
    out = df.where(F.coalesce(allowed, F.lit(False)))
    if prefix is not None:
        out = out.where(F.col("path").startswith(prefix))
    return filter_eq(out, provider=provider)


def with_any_tag(df: DataFrame, tags: Sequence[str], column: str = "tags") -> DataFrame:
    """Rows whose tag list shares a member with ``tags``."""
    return df.where(F.arrays_overlap(column, F.array(*[F.lit(t) for t in tags])))


def search_logs(
    df: DataFrame, text: str | None = None, start=None, end=None, level: str | None = None,
    source: str | None = None, service: str | None = None, limit: int | None = 100, ts: str = "ts", tie: str = "log_id",
) -> DataFrame:
    """Log search: every given filter, newest first."""
    kind = dict(df.dtypes)[ts]
    if start is not None:
        df = df.where(F.col(ts) >= _moment(start).cast(kind))
    if end is not None:
        df = df.where(F.col(ts) <= _moment(end).cast(kind))
    df = filter_eq(df, level=level, source=source, service=service)
    if text is not None:
        df = search(df, text, ["message"])
    df = df.orderBy(F.desc(ts), F.asc(tie))
    return df if limit is None else df.limit(limit)


def metric_values(df: DataFrame, name: str, start=None, end=None, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Points of one metric in a time range whose labels match."""
    df = df.where(F.col("name") == name)
    kind = dict(df.dtypes)["ts"]
    if start is not None:
        df = df.where(F.col("ts") >= _moment(start).cast(kind))
    if end is not None:
        df = df.where(F.col("ts") <= _moment(end).cast(kind))
    for k, v in (labels or {}).items():
        df = df.where(F.col("labels")[k] == v)
    return df


def stale(df: DataFrame, ts: str, timeout_seconds: int, as_of) -> DataFrame:
    """Rows whose last sign of life is older than the timeout."""
    bound = (_moment(as_of) - F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")).cast(dict(df.dtypes)[ts])
    return df.where(F.col(ts) < bound)


def expired(df: DataFrame, as_of, ts: str = "expires_at") -> DataFrame:
    """Objects past their expiry date."""
    return df.where(F.col(ts) < _moment(as_of).cast(dict(df.dtypes)[ts]))


def to_archive(df: DataFrame, as_of, created: str = "created_at") -> DataFrame:
    """Objects older than their ``archive_after_days`` that are not archived yet."""
    age = F.datediff(_moment(as_of), F.col(created))
    return df.where((F.col("storage_class") != "archive") & (age > F.col("archive_after_days")))


def format_logs(df: DataFrame, n: int, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """Newest ``n`` lines, oldest first, as ``[ts] [LEVEL] message``."""
    newest = df.orderBy(F.desc(ts), F.desc(tie)).limit(n)
    stamp = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    line = F.format_string("[%s] [%s] %s", stamp, F.upper("log_level"), F.col("message"))
    return newest.orderBy(F.asc(ts), F.asc(tie)).select(line.alias("line"))


def slow(df: DataFrame, ms: float = 1000.0, column: str = "duration_ms") -> DataFrame:
    """Rows slower than ``ms``."""
    return df.where(F.col(column) > ms)


def weighted_score(weights: Mapping[str, float], cap: float | None = None) -> Column:
    """Sum of weight x column (null counts 0), optionally capped."""
    total = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.coalesce(F.col(c), F.lit(0)) for c, w in weights.items()])
    return total if cap is None else F.least(F.lit(float(cap)), total)


def sort(df: DataFrame, column: str, ascending: bool = True, missing=None, tie: str | None = None) -> DataFrame:
    """Order by a column, nulls last both ways; ``missing`` replaces null first."""
    key = F.col(column) if missing is None else F.coalesce(F.col(column), F.lit(missing))
    order = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    return df.orderBy(order, *([F.asc(tie)] if tie else []))


def page(df: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    """One page of an ordered table; the last order expression must break ties."""
    return df.orderBy(*order).offset(offset).limit(size)


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent, _on(child, parent, keys), "left_anti")


def exists_in(df: DataFrame, other: DataFrame, keys: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Rows with at least one match in ``other``."""
    return df.join(other, _on(df, other, keys), "left_semi")


def _on(a: DataFrame, b: DataFrame, keys):
    if not isinstance(keys, Mapping):
        return list(keys)
    return reduce(lambda x, y: x & y, [a[k] == b[v] for k, v in keys.items()])


def link(rules: DataFrame, models: DataFrame, keys: Mapping[str, str], target: str = "linked_model_id", source: str = "id") -> DataFrame:
    """Fill ``target`` where it is null with the matching row of ``models`` (smallest id on several)."""
    found = models.groupBy(*keys.values()).agg(F.min(source).alias("_found"))
    found = found.select(*[F.col(v).alias(f"_m_{k}") for k, v in keys.items()], "_found")
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_m_{k}") for k in keys])
    joined = rules.join(found, on, "left")
    return joined.select(*[F.coalesce(target, "_found").alias(c) if c == target else F.col(c) for c in rules.columns])


def stack_tables(*tables: DataFrame) -> DataFrame:
    """Union by name; a column a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def retain(df: DataFrame, ts: str, days: int, as_of, done: Column | None = None) -> DataFrame:
    """Rows that survive a retention run: not finished, or newer than ``days``."""
    bound = (_moment(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")).cast(dict(df.dtypes)[ts])
    old = F.col(ts) < bound
    drop = old if done is None else old & done
    return df.where(~F.coalesce(drop, F.lit(False)))


def retain_children(children: DataFrame, kept: DataFrame, on: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose parent survived; those of deleted parents, and orphans, go."""
    parents = kept.select(F.col(parent_key or on).alias("_parent"))
    return children.join(parents, F.col(on) == F.col("_parent"), "left_semi")


def hours_in(text: str) -> int:
    """Hours in "24h", "7d" or "2w"; anything else means a day."""
    scale = {"h": 1, "d": 24, "w": 168}
    return int(text[:-1]) * scale[text[-1]] if text and text[-1] in scale else 24
