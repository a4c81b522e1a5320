"""Cleaning steps.  Each is DataFrame -> DataFrame; statistics come from one aggregate up front."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.functions import rng
from sievemill.operators import ordered
from sievemill.operators.profile import iqr_bounds, outside, value_counts
from sievemill.operators.quantiles import exact_quantiles
from sievemill.session import limit, stored


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """One row per distinct key.  With ``order`` it is the first row; as an aggregate, so that a
    key holding most of the rows is reduced before the shuffle."""
    if not subset:
        return df.dropDuplicates()
    if not order:
        return df.dropDuplicates(list(subset))
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.select(*subset).distinct()
    first = df.groupBy(*subset).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*subset, "_row.*").select(*df.columns)


def convert_types(df: DataFrame) -> DataFrame:
    """Text columns become numbers when every value reads as one, timestamps when some value starts
    like a date and every value reads as one.  Columns with runs of 13-19 digits are identifiers and
    stay text, so that card masking still finds them."""
    texts = C.string_columns(df)
    if not texts:
        return df
    aggs = []
    for i, c in enumerate(texts):
        used = F.col(c).isNotNull()
        whole = F.col(c).rlike(r"^\s*[+-]?\d{1,12}\s*$")
        aggs += [
            F.bool_or(F.when(used, F.col(c).rlike(r"^\s*\d{13,19}\s*$"))).alias(f"id_{i}"),
            F.bool_and(F.when(used, F.col(f"_num_{i}").isNotNull())).alias(f"n_{i}"),
            F.bool_and(F.when(used, whole)).alias(f"w_{i}"),
            F.bool_or(F.when(used, F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}"))).alias(f"s_{i}"),
            F.bool_and(F.when(used, F.col(f"_date_{i}").isNotNull())).alias(f"t_{i}"),
        ]
    facts = C.with_readings(df, texts).agg(*aggs).first()
    plan = {}
    for i, c in enumerate(texts):
        if facts[f"id_{i}"]:
            continue
        if facts[f"n_{i}"]:
            plan[c] = F.trim(c).try_cast("bigint" if facts[f"w_{i}"] else "double")
        elif facts[f"s_{i}"] and facts[f"t_{i}"]:
            plan[c] = C.parse_date(F.col(c))
    return df.withColumns(plan) if plan else df


def modes(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, object]:
    """Most frequent value per column, the smaller on ties.  Counting is distributed; a ranked
    filter runs in every task before one row per column reaches the driver."""
    by_type: dict[str, list[str]] = {}
    kinds = dict(df.dtypes)
    for c in cols or df.columns:
        by_type.setdefault(kinds[c], []).append(c)
    out: dict[str, object] = {}
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    for names in by_type.values():
        counted = (
            df.select(*names).unpivot([], names, "column", "value").where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        )
        for row in counted.withColumn("r", F.row_number().over(w)).where("r = 1").collect():
            out[row["column"]] = row["value"]
    return out


def fill_missing(
    df: DataFrame, strategy: str, cols: Sequence[str] | None = None, *, order: Sequence[str] = (), part: Sequence[str] = (),
    key: str | None = None, seed: int = 42, value=None, low=None, high=None, as_of=None,
) -> DataFrame:
    """Fill nulls.

    remove; mean / median (numeric columns); mode (any); forward / backward (need ``order``);
    interpolate; random_range (observed or given ends), random_existing, custom, current_date,
    sequence, uuid -- the random and id forms need a row ``key``.
    """
    if strategy == "remove":
        return df.dropna(subset=list(cols) if cols else None)
    if strategy in ("mean", "median"):
        nums = [c for c in C.numeric_columns(df) if not cols or c in cols]
        if not nums:
            return df
        row = df.agg(*[F.avg(c).alias(f"a_{i}") for i, c in enumerate(nums)], *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(nums)]).first()
        holed = [c for i, c in enumerate(nums) if row[f"n_{i}"]]
        if strategy == "mean":
            known = {c: row[f"a_{nums.index(c)}"] for c in holed}
        else:
            known = {c: q[0] for c, q in exact_quantiles(df, holed, [0.5]).items()}
        # a column with holes turns to double, as a mean of whole numbers need not be whole
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in known.items() if v is not None}) if known else df
    if strategy == "mode":
        known = modes(df, cols)
        kinds = dict(df.dtypes)
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c])) for c, v in known.items()})
    targets = list(cols or df.columns)
    if strategy == "forward":
        return ordered.ffill(df, [c for c in targets if c not in order and c not in part], order, part)
    if strategy == "backward":
        return ordered.bfill(df, [c for c in targets if c not in order and c not in part], order, part)
    if strategy == "interpolate":
        nums = [c for c in C.numeric_columns(df) if c in targets and c not in order and c not in part]
        return ordered.interpolate(df, nums, order, part)
    if strategy == "custom":
        kinds = dict(df.dtypes)
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(kinds[c])) for c in targets})
    if strategy == "current_date":
        kinds = dict(df.dtypes)
        if as_of is None:
            raise ValueError("current_date needs as_of: nothing here reads a clock")
        today = F.to_date(F.lit(as_of))
        return df.withColumns({c: F.coalesce(F.col(c), today.cast(kinds[c])) for c in targets})
    if strategy == "random_range":
        ends = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in targets for n, f in (("lo", F.min), ("hi", F.max))]).first()
        kinds = dict(df.dtypes)
        plan = {}
        for c in targets:
            a = low if low is not None else ends[f"lo_{c}"]
            b = high if high is not None else ends[f"hi_{c}"]
            if a is None:
                continue
            drawn = F.lit(float(a)) + rng.uniform(seed, f"fill:{c}", key) * F.lit(float(b) - float(a))
            if kinds[c] in ("int", "bigint", "smallint", "tinyint"):
                drawn = F.lit(int(a)) + F.floor(rng.uniform(seed, f"fill:{c}", key) * F.lit(int(b) - int(a) + 1))
            plan[c] = F.coalesce(F.col(c), drawn.cast(kinds[c]))
        return df.withColumns(plan)
    if strategy == "random_existing":
        for c in targets:
            df = _draw_existing(df, c, key, seed)
        return df
    if strategy == "sequence":
        for c in targets:
            df = _next_numbers(df, c, key)
        return df
    if strategy == "uuid":
        return df.withColumns({c: F.coalesce(F.col(c), uuid_text(F.md5(F.concat(F.lit(f"{seed}:{c}:"), F.col(key).cast("string"))))) for c in targets})
    raise ValueError(f"unknown strategy {strategy}")


def uuid_text(hex32: Column) -> Column:
    """8-4-4-4-12 grouping of 32 hex digits."""
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hex32, a, n) for a, n in parts])


def _draw_existing(df: DataFrame, c: str, key: str, seed: int) -> DataFrame:
    # a missing cell draws the ordinal of a filled one: values come up as often as they occur, and
    # no list of values is ever held in one place
    filled = df.where(F.col(c).isNotNull()).select(F.col(key).alias("_k"), F.col(c).alias("_v"))
    n = filled.count()
    if n == 0:
        return df
    numbered = ordered.ordered_scan(filled, ["_k"], number="_at").select("_at", "_v")
    wanted = F.when(F.col(c).isNull(), F.floor(rng.uniform(seed, f"fill:{c}", key) * F.lit(n)) + 1)
    joined = df.withColumn("_want", wanted).join(numbered, F.col("_want") == F.col("_at"), "left")
    return joined.select(*[F.coalesce(c, "_v").alias(c) if x == c else F.col(x) for x in df.columns])


def _next_numbers(df: DataFrame, c: str, key: str) -> DataFrame:
    top = df.agg(F.max(c)).first()[0] or 0
    kind = dict(df.dtypes)[c]
    holes = df.where(F.col(c).isNull()).select(F.col(key).alias("_k"))
    numbered = ordered.ordered_scan(holes, ["_k"], number="_n")
    joined = df.join(numbered, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(F.col(c), (F.lit(top) + F.col("_n")).cast(kind)).alias(c) if x == c else F.col(x) for x in df.columns])


def trim_text(df: DataFrame) -> DataFrame:
    """Blanks around text removed."""
    return df.withColumns({c: F.trim(c) for c in C.string_columns(df)})


def standardize(df: DataFrame, dates: Sequence[str] = (), numbers: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """Trim; lower-case e-mails and strip phones in columns that are mostly such; on request rewrite
    dates to yyyy-MM-dd, drop thousands separators, and proper-case names."""
    texts = C.string_columns(df)
    if not texts:
        return df
    trimmed = df.withColumns({c: F.trim(c) for c in texts})
    aggs = []
    for i, c in enumerate(texts):
        aggs += [F.count(c).alias(f"n_{i}"), F.count_if(F.col(c).rlike(C.EMAIL_WHOLE)).alias(f"e_{i}"),
                 F.count_if(F.col(c).rlike(C.PHONE_WHOLE)).alias(f"p_{i}")]
    facts = trimmed.agg(*aggs).first()
    plan = {}
    for i, c in enumerate(texts):
        value = F.col(c)
        if facts[f"n_{i}"] and facts[f"e_{i}"] * 2 >= facts[f"n_{i}"]:
            value = F.when(value.rlike(C.EMAIL_WHOLE), F.lower(value)).otherwise(value)
        if facts[f"n_{i}"] and facts[f"p_{i}"] * 2 >= facts[f"n_{i}"]:
            value = F.when(value.rlike(C.PHONE_WHOLE), F.regexp_replace(value, r"[^\d+]", "")).otherwise(value)
        if c in dates:
            value = F.coalesce(F.date_format(C.parse_date(value), "yyyy-MM-dd"), value)
        if c in numbers:
            bare = F.regexp_replace(value, ",", "")
            value = F.when(C.parse_number(bare).isNotNull(), bare).otherwise(value)
        if c in names:
            value = F.initcap(value)
        plan[c] = value
    return trimmed.withColumns(plan)


def cap_outliers(df: DataFrame, cols: Sequence[str] | None = None, sensitivity: float = 3.0) -> tuple[DataFrame, dict[str, int]]:
    """Clip a column to its 1st..99th percentile when any value lies over ``sensitivity`` population
    deviations from the mean.  Also returns the number of such values per column."""
    cols = list(cols or C.numeric_columns(df))
    counts = zscore_counts(df, cols, sensitivity)
    hit = [c for c in cols if counts[c]]
    ends = exact_quantiles(df, hit, [0.01, 0.99])
    plan = {c: C.clip(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in ends.items()}
    return (df.withColumns(plan) if plan else df), counts


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """(mean, population deviation) per column."""
    aggs = [f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def zscore_counts(df: DataFrame, cols: Sequence[str], sensitivity: float) -> dict[str, int]:
    known = moments(df, cols)
    aggs = []
    for i, c in enumerate(cols):
        m, s = known[c]
        far = F.abs(F.col(c) - F.lit(m)) / F.lit(s) > sensitivity if s else F.lit(False)
        aggs.append(F.count_if(F.coalesce(far, F.lit(False))).alias(f"z_{i}"))
    row = df.agg(*aggs).first()
    return {c: row[f"z_{i}"] for i, c in enumerate(cols)}


def zscore(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / population deviation, as new columns; null where the deviation is 0."""
    known = moments(df, cols)
    plan = {}
    for c in cols:
        m, s = known[c]
        plan[c + suffix] = (F.col(c) - F.lit(m)) / F.lit(s) if s else F.lit(None).cast("double")
    return df.withColumns(plan)


def scale(df: DataFrame, cols: Sequence[str], method: str) -> DataFrame:
    """zscore / minmax / robust / log scaling in place; a column without spread stays as it is."""
    cols = list(cols)
    plan: dict[str, Column] = {}
    if method == "zscore":
        for c, (m, s) in moments(df, cols).items():
            plan[c] = (F.col(c) - F.lit(m)) / F.lit(s) if s else F.col(c).cast("double")
    elif method == "minmax":
        aggs = [f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]
        row = df.agg(*aggs).first()
        for i, c in enumerate(cols):
            lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
            plan[c] = (F.col(c) - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi != lo else F.col(c).cast("double")
    elif method == "robust":
        for c, (q1, q2, q3) in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).items():
            plan[c] = (F.col(c) - F.lit(q2)) / F.lit(q3 - q1) if q1 is not None and q3 != q1 else F.col(c).cast("double")
    elif method == "log":
        for c in cols:
            plan[c] = F.when(F.col(c) > 0, F.log1p(F.col(c))).when(F.col(c).isNotNull(), F.lit(0.0))
    else:
        raise ValueError(f"unknown scaling {method}")
    return df.withColumns(plan)


def label_codes(df: DataFrame, cols: Sequence[str], most: int = 19) -> dict[str, list]:
    """Sorted distinct values of columns that have 2..``most`` of them (checked first)."""
    cols = list(cols)
    if not cols:
        return {}
    # an estimate of 2 x most rules a column out, so the exact list read below stays short
    seen = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"d_{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        if seen[f"d_{i}"] > 2 * most:
            continue
        values = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect())
        if 2 <= len(values) <= most:
            out[c] = values
    return out


def transform_columns(df: DataFrame, plan: Mapping[str, str] | None = None, scaler: str = "zscore") -> DataFrame:
    """Per-column transform: a scaler for numbers, label codes for columns with 2..19 values.

    Without ``plan`` numeric columns get ``scaler`` and short text columns ``label``.
    """
    if plan is None:
        plan = {c: scaler for c in C.numeric_columns(df)} | {c: "label" for c in C.string_columns(df)}
    coded = label_codes(df, [c for c, how in plan.items() if how == "label"])
    out = df
    for how in ("zscore", "minmax", "robust", "log"):
        cols = [c for c, h in plan.items() if h == how]
        if cols:
            out = scale(out, cols, how)
    for c, values in coded.items():
        code = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)) - 1
        out = out.withColumn(c, code.cast("int"))
    return out


def enrich_dates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Year, month, day and weekday (Monday = 0) of every date column."""
    plan = {}
    for c in cols or C.date_columns(df):
        plan |= {f"{c}_year": F.year(c), f"{c}_month": F.month(c), f"{c}_day": F.dayofmonth(c), f"{c}_weekday": F.weekday(c)}
    return df.withColumns(plan) if plan else df


def enrich_quartiles(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Quartile label of every numeric column with more than 10 distinct values.

    Edges are right-closed; equal edges collapse and labels follow the remaining order.
    """
    cols = [c for c in (cols or C.numeric_columns(df)) if not c.startswith("_")]
    if not cols:
        return df
    seen = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"d_{i}") for i, c in enumerate(cols)]).first()
    many = []
    for i, c in enumerate(cols):
        d = seen[f"d_{i}"]
        exact = d if d > 20 else df.select(c).where(F.col(c).isNotNull()).distinct().limit(11).count()
        if exact > 10:
            many.append(c)
    plan = {}
    for c, edges in exact_quantiles(df, many, [0.0, 0.25, 0.5, 0.75, 1.0]).items():
        distinct = sorted(set(edges))
        labels = [f"Q{i + 1}" for i in range(len(distinct) - 1)]
        plan[f"{c}_quartile"] = C.cut_labels(F.col(c).cast("double"), distinct, labels)
    return df.withColumns(plan) if plan else df


# --- fixed values: address words ---------------------------------------------------------------
ABBREVIATIONS = {"St": "Street", "Ave": "Avenue"}
# -----------------------------------------------------------------------------------------------


def expand_abbreviations(df: DataFrame, words: Mapping[str, str] = ABBREVIATIONS, cols: Sequence[str] | None = None) -> DataFrame:
    """Whole words replaced in address columns (by name unless ``cols`` is given)."""
    targets = cols if cols is not None else [c for c in C.string_columns(df) if "address" in c.lower()]
    plan = {}
    for c in targets:
        value = F.col(c)
        for short, full in words.items():
            value = F.regexp_replace(value, rf"\b{re.escape(short)}\b", full)
        plan[c] = value
    return df.withColumns(plan) if plan else df


def flag_anomalies(
    df: DataFrame, column: str, kind: str, *, factor: float = 1.5, rare: float = 0.01, window: int = 20, z: float = 3.0,
    order: Sequence[str] = (), part: Sequence[str] = (), name: str = "_anomaly",
) -> DataFrame:
    """Boolean flag: ``iqr`` fences, ``rare`` category share, or ``rolling`` z-score against the
    preceding ``window`` rows of the group."""
    if kind == "iqr":
        return df.withColumn(name, outside(F.col(column), iqr_bounds(df, [column], factor)[column]))
    if kind == "rare":
        n = df.select(column).where(F.col(column).isNotNull()).count()
        few = stored(value_counts(df, [column]).where(F.col("n") < rare * n).select(F.col("value").alias("_rare")))
        joined = df.join(few, F.col(column).cast("string") == F.col("_rare"), "left")
        return joined.withColumn(name, F.col("_rare").isNotNull()).drop("_rare")
    if kind == "rolling":
        return _rolling_flag(df, column, window, z, order, part, name)
    raise ValueError(f"unknown kind {kind}")


def _rolling_flag(df, column, window, z, order, part, name):
    rows = ordered.ordered_scan(df, order, part, number="_n")
    # blocks of rows, each with a copy of the ``window`` rows before it, so that a long group is
    # many window partitions
    block = max(window, min(max(50 * window, 1000), limit(df.sparkSession, "sievemill.groupRows")))
    home = F.floor((F.col("_n") - 1) / block)
    tail = (F.col("_n") - 1) % block >= block - window
    copied = rows.withColumn("_b", F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))))
    copied = copied.withColumn("_home", F.col("_b") == home)
    w = Window.partitionBy(*part, "_b").orderBy("_n").rowsBetween(-window, -1)
    mean, sd = F.avg(column).over(w), F.stddev_samp(column).over(w)
    flag = (F.count(column).over(w) >= window) & (sd > 0) & (F.abs(F.col(column) - mean) / sd > z)
    return copied.withColumn(name, F.coalesce(flag, F.lit(False))).where("_home").drop("_home", "_b", "_n")


def validate_constraints(df: DataFrame, constraints: Mapping[str, Column]) -> DataFrame:
    """Cross-column rules: rows that break each one (a null result breaks nothing)."""
    names = list(constraints)
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.coalesce(~constraints[n], F.lit(False))).alias(f"v_{i}") for i, n in enumerate(names)],
    )
    return C.stack_rows(one, [
        F.struct(F.lit(n).alias("constraint"), F.col("rows").alias("rows"), F.col(f"v_{i}").alias("violations"))
        for i, n in enumerate(names)
    ])


