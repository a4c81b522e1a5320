"""Profiling and quality: what a table holds and how good it is."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.functions import columns as C
from sievemill.operators.closeness import ordered_distances
from sievemill.operators.quantiles import exact_quantiles


def family(data_type: T.DataType) -> str:
    """Type family that decides which operators apply to a column."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string" if isinstance(data_type, T.StringType) else "nested"


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value as text, n) of every distinct non-null value, counted in one shuffle."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row with a column per group of columns: how many distinct values, or combinations of values, it has.

    Nulls do not count in a group of one column; in larger groups a null equals a null.  All groups are counted in one
    shuffle of (group, 128-bit digest), combined in the map tasks, so no value moves and no row has a slot per column.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def read(c: str) -> Column:
        if isinstance(kinds[c], (T.FloatType, T.DoubleType)):
            return F.col(c) + F.lit(0.0).cast(kinds[c])  # -0.0 is 0.0
        # hashes pass over nulls inside of nested values
        return F.to_json(c, {"ignoreNullFields": "false"}) if isinstance(kinds[c], (T.ArrayType, T.StructType, T.MapType)) else F.col(c)

    cells = []
    for i, cols in enumerate(groups.values()):
        parts = [read(c) for c in cols] if len(cols) == 1 else [p for c in cols for p in (read(c), F.col(c).isNull())]
        cell = F.struct(F.lit(i).alias("at"), F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))
        cells.append(F.when(F.col(cols[0]).isNotNull(), cell) if len(cols) == 1 else cell)
    long = df.select(F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))
    found = long.groupBy("at", "a", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    return found.agg(*[F.coalesce(F.max(F.when(F.col("at") == i, F.col("n"))), F.lit(0)).cast("bigint").alias(name) for i, name in enumerate(groups)])


def top_values(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column; ties go to the smaller text.

    The rank filter is applied per map task before the exchange, so a column with a huge number of
    values never meets in one task.
    """
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = value_counts(df, cols).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("column", "rank", "value", "n")


def numeric_stats(df: DataFrame, cols: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max per numeric column.

    ``accuracy`` switches the quartiles to ``approx_percentile``.
    """
    cols = list(cols or C.numeric_columns(df))
    probs = [0.25, 0.5, 0.75]
    if accuracy is None:
        known = exact_quantiles(df, cols, probs)
        quart = {c: [F.lit(q).cast("double") for q in known[c]] for c in cols}
        extra = []
    else:
        extra = [F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(f"q_{i}") for i, c in enumerate(cols)]
        quart = {c: [F.col(f"q_{i}")[j] for j in range(3)] for i, c in enumerate(cols)}
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(c).alias(f"n_{i}"), F.avg(x).alias(f"a_{i}"), F.stddev_samp(x).alias(f"s_{i}"),
                 F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}")]
    one = df.agg(*aggs, *extra)
    return C.stack_rows(one, [
        F.struct(
            F.lit(c).alias("column"), F.col(f"n_{i}").alias("n"), F.col(f"a_{i}").alias("mean"),
            F.col(f"s_{i}").alias("std"), F.col(f"lo_{i}").alias("min"), quart[c][0].alias("q1"),
            quart[c][1].alias("median"), quart[c][2].alias("q3"), F.col(f"hi_{i}").alias("max"),
        )
        for i, c in enumerate(cols)
    ])


def iqr_bounds(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float] | None]:
    """Fences q1 - f*iqr and q3 + f*iqr per column (None for an all-null column)."""
    out: dict[str, tuple[float, float] | None] = {}
    for c, (q1, q3) in exact_quantiles(df, cols, [0.25, 0.75]).items():
        out[c] = None if q1 is None else (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def outside(col: Column, fence: tuple[float, float] | None) -> Column:
    """True for a value outside the fence; null and fence-less columns are inside."""
    if fence is None:
        return F.lit(False)
    return F.coalesce((col < F.lit(fence[0])) | (col > F.lit(fence[1])), F.lit(False))


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Outlier count per numeric column."""
    cols = list(cols or C.numeric_columns(df))
    fences = iqr_bounds(df, cols, factor)
    one = df.agg(*[F.count_if(outside(F.col(c), fences[c])).alias(f"o_{i}") for i, c in enumerate(cols)])
    return C.stack_rows(one, [
        F.struct(F.lit(c).alias("column"), F.col(f"o_{i}").alias("outliers")) for i, c in enumerate(cols)
    ])


def column_score(null_pct: Column, unique_pct: Column) -> Column:
    """Column quality; the uniqueness bonus can lift it to 110."""
    return F.greatest(F.lit(0.0), F.lit(100.0) - null_pct * 0.5 + F.least(unique_pct * 0.1, F.lit(10.0)))


def profile(df: DataFrame, approx: bool = False, k: int = 5) -> DataFrame:
    """One row per column: type, nulls, uniqueness, quality, numeric statistics, top values."""
    cols = df.columns
    nums = C.numeric_columns(df)
    texts = C.string_columns(df)
    fam = {f.name: family(f.dataType) for f in df.schema.fields}
    quart = exact_quantiles(df, nums, [0.25, 0.5, 0.75])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n_{i}")] + ([F.approx_count_distinct(c).alias(f"d_{i}")] if approx else [])
        if c in nums:
            x = F.col(c).cast("double")
            q1, _, q3 = quart[c]
            fence = None if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
            aggs += [F.avg(x).alias(f"a_{i}"), F.stddev_samp(x).alias(f"s_{i}"), F.min(x).alias(f"lo_{i}"),
                     F.max(x).alias(f"hi_{i}"), F.count_if(outside(x, fence)).alias(f"o_{i}")]
    structs = []
    for i, c in enumerate(cols):
        nulls = F.col("rows") - F.col(f"n_{i}")
        null_pct = nulls / F.col("rows") * 100
        unique_pct = F.col(f"d_{i}") / F.col("rows") * 100
        num = c in nums

        def only(name: str, kind: str = "double", num=num, i=i):
            return (F.col(f"{name}_{i}") if num else F.lit(None)).cast(kind)

        median = F.lit(quart[c][1]).cast("double") if num else F.lit(None).cast("double")
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(fam[c]).alias("type"), nulls.alias("null_count"),
            null_pct.alias("null_percentage"), F.col(f"d_{i}").alias("unique_count"),
            unique_pct.alias("unique_percentage"), column_score(null_pct, unique_pct).alias("quality_score"),
            only("lo").alias("min"), only("hi").alias("max"), only("a").alias("mean"), median.alias("median"),
            only("s").alias("std"), only("o", "bigint").alias("outliers"),
        ))
    one = df.agg(*aggs)
    if not approx:
        one = C.beside(one, distinct_counts(df, {f"d_{i}": [c] for i, c in enumerate(cols)}))
    facts = C.stack_rows(one, structs)
    if not texts:
        return facts.withColumn("top_values", F.lit(None).cast("map<string,bigint>"))
    tops = top_values(df, texts, k).groupBy("column").agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
                lambda e: F.struct(e["value"], e["n"]),
            )
        ).alias("top_values")
    )
    return facts.join(tops, "column", "left")


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each equal set (nulls equal), as one row ``duplicates``."""
    keys = list(cols or df.columns)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def spare_name(name: str, taken: Sequence[str]) -> str:
    """``name`` with as many underscores before it as it takes to be none of ``taken``."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def quality_score(df: DataFrame) -> DataFrame:
    """Dataset score: 0.4 mean column score + 0.4 completeness + 0.2 (100 - duplicate %)."""
    cols = df.columns
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)],
    )
    # the last group is the whole row, with a constant beside it so that a single column counts as a row too
    whole = spare_name("_one", cols)
    distinct = distinct_counts(df.withColumn(whole, F.lit(1)), {f"d_{i}": [c] for i, c in enumerate(cols)} | {"different": [*cols, whole]})
    joined = C.beside(facts, distinct).withColumn("duplicates", F.col("rows") - F.col("different"))
    rows = F.col("rows")
    scores = [column_score((rows - F.col(f"n_{i}")) / rows * 100, F.col(f"d_{i}") / rows * 100) for i in range(len(cols))]
    mean_score = sum(scores[1:], scores[0]) / len(cols)
    filled = sum([F.col(f"n_{i}") for i in range(1, len(cols))], F.col("n_0"))
    return joined.select(
        rows.alias("rows"),
        mean_score.alias("column_score"),
        (filled / (rows * len(cols)) * 100).alias("completeness"),
        F.col("duplicates"),
        (F.col("duplicates") / rows * 100).alias("duplicate_percentage"),
    ).withColumn(
        "quality_score",
        F.round(F.col("column_score") * 0.4 + F.col("completeness") * 0.4 + (100 - F.col("duplicate_percentage")) * 0.2, 2),
    )


def mixed_flags(texts: Sequence[str]) -> list[Column]:
    """Per text column: does it hold values of more than one kind (number, date, other text)?

    To be aggregated over :func:`columns.with_readings`.
    """
    out = []
    for i, c in enumerate(texts):
        usable = F.col(c).isNotNull() & (F.col(c) != "")
        number, date = F.col(f"_num_{i}").isNotNull(), F.col(f"_date_{i}").isNotNull()
        kinds = sum(
            (F.coalesce(F.bool_or(usable & k), F.lit(False)).cast("int") for k in (~number & date, ~number & ~date)),
            F.coalesce(F.bool_or(usable & number), F.lit(False)).cast("int"),
        )
        out.append((kinds > 1).alias(f"m_{i}"))
    return out


def detect_issues(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Issue rows: duplicates (medium), missing values (low under 5 % of rows), mixed types (high)."""
    texts = C.string_columns(df)
    nulls = sum([F.count_if(F.col(c).isNull()) for c in df.columns[1:]], F.count_if(F.col(df.columns[0]).isNull()))
    facts = C.with_readings(df, texts).agg(F.count(F.lit(1)).alias("rows"), nulls.alias("missing"), *mixed_flags(texts))
    one = C.beside(facts, duplicate_count(df, subset))
    dup, missing = F.col("duplicates"), F.col("missing")

    def issue(kind, severity, column, count, message, when):
        return F.when(when, F.struct(
            F.lit(kind).alias("issue"), severity.alias("severity"), F.lit(column).cast("string").alias("column"),
            count.cast("bigint").alias("n"), message.alias("message"),
        ))

    found = [
        issue("duplicates", F.lit("medium"), None, dup, F.format_string("Found %d duplicate rows", dup), dup > 0),
        issue("missing_values", F.when(missing < F.col("rows") * 0.05, "low").otherwise("medium"), None, missing,
              F.format_string("Found %d missing values", missing), missing > 0),
    ] + [
        issue("mixed_types", F.lit("high"), c, F.lit(None), F.lit(f"Column '{c}' contains mixed data types"), F.col(f"m_{i}"))
        for i, c in enumerate(texts)
    ]
    return one.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("i.*")


def _blank(col: Column, words: Sequence[str]) -> Column:
    text = F.lower(F.trim(col.cast("string")))
    return col.isNull() | text.isin(*words)


def completeness(df: DataFrame, missing_words: Sequence[str] = ("", "null", "nan", "n/a")) -> DataFrame:
    """Share of filled cells in percent, also as the rounded score."""
    cols = df.columns
    blanks = [F.count_if(_blank(F.col(c), missing_words)) for c in cols]
    total = F.count(F.lit(1)) * len(cols)
    return df.agg(total.alias("cells"), sum(blanks[1:], blanks[0]).alias("missing")).withColumn(
        "completeness", F.when(F.col("cells") > 0, (F.col("cells") - F.col("missing")) / F.col("cells") * 100).otherwise(0.0)
    ).withColumn("score", F.round("completeness").cast("bigint"))


def data_quality(df: DataFrame) -> DataFrame:
    """min(100, round(0.8 completeness + 15)) when numeric and text columns both exist, else + 5."""
    bonus = 15 if C.numeric_columns(df) and C.string_columns(df) else 5
    return completeness(df).select(
        "completeness",
        F.least(F.lit(100), F.round(F.col("completeness") * 0.8 + bonus)).cast("bigint").alias("data_quality"),
    )


def row_quality(df: DataFrame, name: str = "_quality_score") -> DataFrame:
    """100 less 10 per null in the row, held in 0..100."""
    nulls = sum([F.col(c).isNull().cast("int") for c in df.columns], F.lit(0))
    return df.withColumn(name, F.greatest(F.lit(0), F.lit(100) - nulls * 10))


_BOOL_WORDS = ("true", "false", "1", "0", "yes", "no", "y", "n")


def detect_types(df: DataFrame) -> DataFrame:
    """Type of every column judged by its values: Boolean, Date, Integer, Float, Email, String, Unknown."""
    aggs = []
    known = {"boolean": "Boolean", "datetime": "Date", "nested": "String"}
    fam = {f.name: family(f.dataType) for f in df.schema.fields}
    # trimmed text with blanks as null, read once per value
    judged = [c for c in df.columns if fam[c] not in known]
    cleaned = df.select(
        *[F.col(c).alias(f"_c_{i}") for i, c in enumerate(df.columns) if fam[c] in known],
        *[F.when(~_blank(F.col(c), ("", "null")), F.trim(F.col(c).cast("string"))).alias(f"_u_{i}") for i, c in enumerate(judged)],
    )
    read = C.with_readings(cleaned, [f"_u_{i}" for i in range(len(judged))])
    for i, c in enumerate(df.columns):
        if fam[c] in known:  # the schema already says it
            aggs.append(F.count(f"_c_{i}").alias(f"n_{i}"))
            continue
        at = judged.index(c)
        used, number, date = F.col(f"_u_{at}"), F.col(f"_num_{at}"), F.col(f"_date_{at}")
        month_first = used.rlike("|".join(C.MONTH_FIRST.values())) & C.parse_date(used, C.MONTH_FIRST).isNotNull()
        aggs += [
            F.count(used).alias(f"n_{i}"),
            F.bool_and(F.when(used.isNotNull(), F.lower(used).isin(*_BOOL_WORDS))).alias(f"b_{i}"),
            F.bool_and(F.when(used.isNotNull(), date.isNotNull() | month_first)).alias(f"t_{i}"),
            F.bool_and(F.when(used.isNotNull(), number.isNotNull())).alias(f"f_{i}"),
            F.bool_and(F.when(number.isNotNull(), number == F.floor(number))).alias(f"w_{i}"),
            F.count_if(used.rlike(C.EMAIL_WHOLE)).alias(f"e_{i}"),
        ]
    ladder = []
    for i, c in enumerate(df.columns):
        if fam[c] in known:
            kind = F.when(F.col(f"n_{i}") == 0, "Unknown").otherwise(known[fam[c]])
            ladder.append(F.struct(F.lit(c).alias("column"), kind.alias("type"), F.col(f"n_{i}").alias("filled")))
            continue
        kind = (
            F.when(F.col(f"n_{i}") == 0, "Unknown").when(F.col(f"b_{i}"), "Boolean").when(F.col(f"t_{i}"), "Date")
            .when(F.col(f"f_{i}") & F.col(f"w_{i}"), "Integer").when(F.col(f"f_{i}"), "Float")
            .when(F.col(f"e_{i}") > F.col(f"n_{i}") * 0.8, "Email").otherwise("String")
        )
        ladder.append(F.struct(F.lit(c).alias("column"), kind.alias("type"), F.col(f"n_{i}").alias("filled")))
    return C.stack_rows(read.agg(*aggs), ladder)


# --- fixed values: name parts that give a semantic type, first match wins ----------------------
NAME_TYPES = {
    "email": ("email", "mail"),
    "phone": ("phone", "tel", "mobile"),
    "name": ("first", "last", "full"),
    "address": ("address", "street", "city"),
    "date": ("date", "time", "created", "updated"),
    "account": ("id", "account", "number"),
    "currency": ("price", "amount", "cost", "salary"),
}
# -----------------------------------------------------------------------------------------------


def detect_types_by_name(columns: Sequence[str]) -> dict[str, str | None]:
    """Semantic type by column name alone."""
    out = {}
    for c in columns:
        low = c.lower()
        hits = (kind for kind, parts in NAME_TYPES.items() if any(p in low for p in parts))
        out[c] = next((kind for kind in hits if kind != "name" or "name" in low), None)
    return out


def initial_analysis(df: DataFrame) -> DataFrame:
    """First look at a table: missing (error over 30 %), duplicates, mixed types, bad dates and e-mails."""
    cols = df.columns
    texts = C.string_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(_blank(F.col(c), ("", "null"))).alias(f"n_{i}") for i, c in enumerate(cols)]
    aggs += mixed_flags(texts)
    for i, c in enumerate(texts):
        used = F.when(~_blank(F.col(c), ("", "null")), F.trim(F.col(c)))
        aggs += [F.count(used).alias(f"u_{i}"), F.count_if(used.rlike(C.EMAIL_WHOLE)).alias(f"e_{i}"),
                 F.count_if(used.isNotNull() & F.col(f"_date_{i}").isNotNull()).alias(f"t_{i}")]
    one = C.beside(C.with_readings(df, texts).agg(*aggs), duplicate_count(df))

    def row(kind, column, n, severity, when):
        return F.when(when, F.struct(F.lit(kind).alias("issue"), F.lit(column).alias("column"),
                                     n.cast("bigint").alias("n"), severity.alias("severity")))

    rows = [row("missing", c, F.col(f"n_{i}"), F.when(F.col(f"n_{i}") > F.col("rows") * 0.3, "error").otherwise("warning"),
                F.col(f"n_{i}") > 0) for i, c in enumerate(cols)]
    rows.append(row("duplicates", "All columns", F.col("duplicates"), F.lit("info"), F.col("duplicates") > 0))
    for i, c in enumerate(texts):
        rows.append(row("inconsistency", c, F.lit(None), F.lit("warning"), F.col(f"m_{i}")))
        for tag in ("t", "e"):
            # a column counts as dates / e-mails when over 80 % of its values are; the rest are faults
            good, used = F.col(f"{tag}_{i}"), F.col(f"u_{i}")
            rows.append(row("format", c, used - good, F.lit("error"), (good > used * 0.8) & (good < used)))
    return one.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("i")).select("i.*")


# --- fixed values: identifier formats by industry ----------------------------------------------
FORMATS = {
    "icd10": r"^[A-Z]\d{2}(\.\w{1,4})?$",
    "sku": r"^[A-Z]{3}-\d{4}$",
    "part_number": r"^PRT-\d{4}-[A-Z]{2}$",
    "policy_number": r"^POL[0-9A-F-]{10}$",
    "zip": r"^\d{5}(-\d{4})?$",
    "order_id": r"^ORD-?[0-9A-F]{6,10}$",
    "transaction_id": r"^TXN[0-9A-F-]{12}$",
}
# -----------------------------------------------------------------------------------------------


def account_check(col: Column) -> Column:
    """Ten digits, the last being the sum of the first nine modulo 10."""
    digits = F.transform(F.split(F.substring(col, 1, 9), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return col.rlike(r"^\d{10}$") & ((total % 10) == F.substring(col, 10, 1).try_cast("int"))


def validate_formats(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Per column: rows checked and failed.  A rule is a name of ``FORMATS``, "account" or a regex."""
    aggs, structs = [], []
    for i, (c, rule) in enumerate(rules.items()):
        good = account_check(F.col(c)) if rule == "account" else F.col(c).rlike(FORMATS.get(rule, rule))
        aggs += [F.count(c).alias(f"n_{i}"), F.count_if(~good).alias(f"b_{i}")]
        structs.append(F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"),
                                F.col(f"n_{i}").alias("checked"), F.col(f"b_{i}").alias("failed")))
    return C.stack_rows(df.agg(*aggs), structs)


def check_mapping(df: DataFrame, required: dict[str, str], mapping: dict[str, str]) -> DataFrame:
    """Per required target field: mapped column, whether it exists, and values that do not cast."""
    aggs, plans = [F.count(F.lit(1)).alias("rows")], []
    for i, (target, wanted) in enumerate(required.items()):
        source = next((s for s, t in mapping.items() if t == target), None)
        present = source in df.columns
        if present:
            value = F.col(source)
            aggs.append(F.count_if(value.isNotNull() & value.cast("string").try_cast(wanted).isNull()).alias(f"b_{i}"))
        plans.append((i, target, wanted, source, present))
    return C.stack_rows(df.agg(*aggs), [
        F.struct(
            F.lit(t).alias("field"), F.lit(w).alias("wanted"), F.lit(s).cast("string").alias("source"),
            F.lit(p).alias("mapped"), (F.col(f"b_{i}") if p else F.lit(None).cast("bigint")).alias("bad_values"),
            (F.col(f"b_{i}") == 0 if p else F.lit(False)).alias("ok"),
        )
        for i, t, w, s, p in plans
    ])


def table_statistics(df: DataFrame) -> DataFrame:
    """Statistics of a generated table: profile plus quartiles and the most frequent value."""
    nums = C.numeric_columns(df)
    quart = exact_quantiles(df, nums, [0.25, 0.75])
    modes = top_values(df, [f.name for f in df.schema.fields if family(f.dataType) != "nested"], 1)
    base = profile(df).join(modes.select("column", F.col("value").alias("mode")), "column", "left")
    q = {c: v for c, v in quart.items()}

    def pick(j):
        out = F.lit(None).cast("double")
        for c, v in q.items():
            out = F.when(F.col("column") == c, F.lit(v[j]).cast("double")).otherwise(out)
        return out

    return base.withColumns({"q25": pick(0), "q75": pick(1)})


def privacy_metrics(df: DataFrame, qi: Sequence[str], sensitive: str, ordered: bool = False) -> DataFrame:
    """Measured privacy: smallest class k, smallest distinct-sensitive count l, largest distance t,
    share of rows alone in their class.

    t is the largest total-variation distance between a class's distribution of the sensitive value
    and the table's.  Values a class lacks enter through 1 - sum(global share of the values it has),
    so classes are never crossed with all values.  ``ordered`` takes the ordered distance of numbers instead.
    """
    qi = list(qi)
    cells = df.groupBy(*qi, sensitive).agg(F.count(F.lit(1)).alias("n"))
    overall = cells.groupBy(F.col(sensitive).alias("_s")).agg(F.sum("n").alias("g"))
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    classes = cells.groupBy(*[F.col(c).alias(f"_q_{c}") for c in qi]).agg(
        F.sum("n").alias("size"), F.count(sensitive).alias("l")
    )
    on = F.lit(True)
    for c in qi:
        on = on & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    rows = total.first()["rows"]
    joined = cells.join(classes, on).join(overall, F.col(sensitive).eqNullSafe(F.col("_s")))
    p, q = F.col("n") / F.col("size"), F.col("g") / F.lit(rows)
    per_class = joined.groupBy(*qi).agg(
        F.max("size").alias("size"), F.max("l").alias("l"),
        ((F.sum(F.abs(p - q)) + 1 - F.sum(q)) / 2).alias("t"),
    )
    out = per_class.agg(
        F.min("size").alias("k"), F.min("l").alias("l"), F.max("t").alias("t"),
        (F.sum(F.when(F.col("size") == 1, 1).otherwise(0)) / F.lit(rows)).alias("unique_share"),
    )
    if not ordered:
        return out
    return C.beside(out.drop("t"), ordered_distances(df, qi, sensitive).agg(F.max("_t").alias("t"))).select("k", "l", "t", "unique_share")
