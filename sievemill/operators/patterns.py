"""Pattern analysis: column types, distributions, correlations, functional dependencies."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators.ordered import gaps, ordered_scan, frequency_label
from sievemill.operators.profile import distinct_counts, family, iqr_bounds, outside, top_values
from sievemill.operators.quantiles import exact_quantiles


def correlations(df: DataFrame, cols: Sequence[str] | None = None, threshold: float | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, all in one aggregate."""
    cols = list(cols or C.numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)])
    out = C.stack_rows(one, [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r_{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ])
    return out if threshold is None else out.where(F.abs("correlation") > threshold)


def functional_deps(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """For every ordered pair: does the first column fix the second?

    Per determinant one grouped aggregate keeps the smallest and largest value of all other
    columns; the dependency holds when they agree in every group.  Partial aggregates combine
    before the shuffle, so no set of values is ever built.
    """
    cols = list(cols or df.columns)
    parts = []
    for a in cols:
        others = [c for c in cols if c != a]
        per_value = df.select(*cols).where(F.col(a).isNotNull()).groupBy(a).agg(
            F.count(F.lit(1)).alias("_n"),
            *[f(c).alias(f"_{n}_{i}") for i, c in enumerate(others) for n, f in (("lo", F.min), ("hi", F.max))],
        )
        one = per_value.agg(
            (F.max("_n") <= 1).alias("_key"),
            *[F.bool_and(F.col(f"_lo_{i}").eqNullSafe(F.col(f"_hi_{i}"))).alias(f"_h_{i}") for i in range(len(others))],
        )
        parts.append(C.stack_rows(one, [
            F.struct(F.lit(a).alias("determinant"), F.lit(c).alias("dependent"),
                     F.coalesce(F.col(f"_h_{i}"), F.lit(False)).alias("holds"), F.coalesce("_key", F.lit(False)).alias("is_key"))
            for i, c in enumerate(others)
        ]))
    return reduce(DataFrame.unionByName, parts)


def shape(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """n, mean, sample deviation, min, max, bias-corrected skewness, kurtosis per column."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n_{i}"), F.avg(x).alias(f"m_{i}"), F.stddev_samp(x).alias(f"s_{i}"), F.min(x).alias(f"lo_{i}"),
                 F.max(x).alias(f"hi_{i}"), F.skewness(x).alias(f"g_{i}"), F.kurtosis(x).alias(f"k_{i}")]
    row = df.agg(*aggs).first() if aggs else {}
    out = {}
    for i, c in enumerate(cols):
        n, g = row[f"n_{i}"], row[f"g_{i}"]
        skew = g * math.sqrt(n * (n - 1)) / (n - 2) if g is not None and not math.isnan(g) and n > 2 else None
        out[c] = {"n": n, "mean": row[f"m_{i}"], "std": row[f"s_{i}"], "min": row[f"lo_{i}"], "max": row[f"hi_{i}"],
                  "skew": skew, "g1": g, "kurtosis": row[f"k_{i}"]}
    return out


def normal_p(n: int, g1: float, kurt: float) -> float:
    """p-value of the D'Agostino-Pearson omnibus test from population skewness and excess kurtosis."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta2 - 1)) - 1
    z_skew = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    expected = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt + 3 - expected) / math.sqrt(variance)
    third = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + math.sqrt(1 + 4 / third**2))
    base = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z_kurt = (1 - 2 / (9 * a) - math.copysign(abs(base) ** (1 / 3), base)) / math.sqrt(2 / (9 * a))
    return math.exp(-(z_skew**2 + z_kurt**2) / 2)


def uniform_statistic(df: DataFrame, col: str, lo: float, hi: float, n: int) -> float:
    """Kolmogorov-Smirnov distance to the uniform distribution on [lo, hi]."""
    counted = (
        df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = ordered_scan(counted, ["v"], sums={"cum": F.col("n")})
    share = (F.col("v") - F.lit(lo)) / F.lit(hi - lo)
    above, below = F.col("cum") / n - share, share - (F.col("cum") - F.col("n")) / n
    return ranked.agg(F.max(F.greatest(above, below))).first()[0]


def ks_p(distance: float, n: int) -> float:
    """Asymptotic p-value of a Kolmogorov-Smirnov distance."""
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * distance
    if lam < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


def distribution_label(df: DataFrame, col: str) -> str:
    """normal / uniform / exponential / unknown."""
    s = shape(df, [col])[col]
    if s["n"] < 8 or not s["std"]:
        return "unknown"
    if normal_p(s["n"], s["g1"], s["kurtosis"]) > 0.05:
        return "normal"
    # a sample far off in its fourth moment cannot pass as uniform, which saves the ranked pass
    if abs(s["kurtosis"] + 1.2) < 0.6 and abs(s["g1"]) < 0.6:
        if ks_p(uniform_statistic(df, col, s["min"], s["max"], s["n"]), s["n"]) > 0.05:
            return "uniform"
    return "exponential" if s["skew"] > 2 else "unknown"


def _densities(s: dict) -> dict[str, tuple[dict, object]]:
    """Method-of-moments parameters and density of each candidate distribution."""
    m, sd, lo, hi = s["mean"], s["std"], s["min"], s["max"]
    span = hi - lo
    out: dict[str, tuple[dict, object]] = {
        "normal": ({"mean": m, "std": sd}, lambda x: math.exp(-((x - m) / sd) ** 2 / 2) / (sd * math.sqrt(2 * math.pi))),
        "uniform": ({"low": lo, "high": hi}, lambda x: 1 / span),
        "exponential": ({"loc": lo, "scale": m - lo}, lambda x: math.exp(-(x - lo) / (m - lo)) / (m - lo)),
    }
    shift = m - lo
    shp, scl = (shift / sd) ** 2, sd * sd / shift
    out["gamma"] = (
        {"shape": shp, "loc": lo, "scale": scl},
        lambda x: math.exp((shp - 1) * math.log(max(x - lo, 1e-300) / scl) - (x - lo) / scl - math.lgamma(shp)) / scl,
    )
    mean01, var01 = shift / span, (sd / span) ** 2
    both = mean01 * (1 - mean01) / var01 - 1
    a, b = mean01 * both, (1 - mean01) * both
    if a > 0 and b > 0:
        norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)

        def beta(x):
            u = min(max((x - lo) / span, 1e-12), 1 - 1e-12)
            return math.exp(norm + (a - 1) * math.log(u) + (b - 1) * math.log(1 - u)) / span

        out["beta"] = ({"a": a, "b": b, "loc": lo, "scale": span}, beta)
    return out


def fit_distribution(df: DataFrame, col: str, bins: int = 50) -> dict:
    """Best of five distributions by squared error of the histogram density."""
    s = shape(df, [col])[col]
    if s["n"] < 2 or not s["std"]:
        return {"name": None, "params": {}, "sse": None}
    width = (s["max"] - s["min"]) / bins
    x = F.col(col).cast("double")
    counted = (
        df.where(x.isNotNull()).groupBy(C.linear_bin(x, s["min"], s["max"], bins).alias("b")).count().collect()  # <= bins rows
    )
    seen = {r["b"]: r["count"] / (s["n"] * width) for r in counted}
    best = {"name": None, "params": {}, "sse": math.inf}
    for name, (params, density) in _densities(s).items():
        sse = sum((density(s["min"] + (b + 0.5) * width) - seen.get(b, 0.0)) ** 2 for b in range(bins))
        if sse < best["sse"]:
            best = {"name": name, "params": params, "sse": sse}
    return best


# --- fixed values: spellings of a two-valued column ---------------------------------------------
BOOLEAN_PAIRS = (
    ("True", "False"), ("true", "false"), ("TRUE", "FALSE"), ("Yes", "No"), ("yes", "no"), ("YES", "NO"), ("1", "0"), ("Y", "N"), ("y", "n"),
)
# -----------------------------------------------------------------------------------------------


def analyze_patterns(df: DataFrame, distributions: bool = True) -> dict[str, dict]:
    """Type and facts of every column: boolean by schema or spelling, integer / float, datetime,
    categorical (under 50 % distinct), text, empty.  Whole columns are tested, in two passes."""
    fams = {f.name: family(f.dataType) for f in df.schema.fields}
    texts = [c for c in df.columns if fams[c] == "string"]
    nums = [c for c in df.columns if fams[c] == "numeric"]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(c).alias(f"n_{i}")]
        if fams[c] != "nested":
            aggs += [F.min(c).alias(f"lo_{i}"), F.max(c).alias(f"hi_{i}")]
        if fams[c] == "boolean":
            aggs += [F.count_if(F.col(c)).alias(f"true_{i}")]
        if c in nums:
            aggs += [F.bool_and(F.col(c).cast("double") == F.floor(F.col(c).cast("double"))).alias(f"w_{i}")]
        if c in texts:
            v = F.col(c)
            used = v.isNotNull()
            number, moment = F.col(f"_num_{texts.index(c)}"), F.col(f"_date_{texts.index(c)}")
            flipped = F.reverse(v)
            aggs += [
                F.bool_and(F.when(used, number.isNotNull())).alias(f"num_{i}"),
                F.bool_and(F.when(number.isNotNull(), number == F.floor(number))).alias(f"w_{i}"),
                F.bool_and(F.when(used, moment.isNotNull())).alias(f"ts_{i}"),
                F.min(moment).alias(f"tlo_{i}"), F.max(moment).alias(f"thi_{i}"),
                F.avg(F.length(v)).alias(f"alen_{i}"), F.min(F.length(v)).alias(f"llen_{i}"), F.max(F.length(v)).alias(f"hlen_{i}"),
                F.bool_or(v.rlike(C.EMAIL_IN_TEXT)).alias(f"email_{i}"), F.bool_or(v.rlike(C.URL_IN_TEXT)).alias(f"url_{i}"),
                F.bool_or(v.rlike(C.PHONE_IN_TEXT)).alias(f"phone_{i}"), F.bool_or(v.rlike(C.UUID_IN_TEXT)).alias(f"uuid_{i}"),
                F.count_if(v.rlike(C.CAPITALISED_NAME)).alias(f"name_{i}"),
                F.min(flipped).alias(f"rlo_{i}"), F.max(flipped).alias(f"rhi_{i}"),
            ]
    row = C.with_readings(df, texts).agg(*aggs).first()
    flat = {f"d_{i}": [c] for i, c in enumerate(df.columns) if fams[c] != "nested"}
    distinct = distinct_counts(df, flat).first() if flat else None
    out: dict[str, dict] = {}
    as_number: list[str] = []
    categories: list[str] = []
    for i, c in enumerate(df.columns):
        n, rows = row[f"n_{i}"], row["rows"]
        base = {"null_count": rows - n, "total_count": rows}
        if n == 0:
            out[c] = {"type": "empty", **base, "unique_count": 0}
            continue
        if fams[c] == "nested":
            out[c] = {"type": "nested", **base}
            continue
        lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
        base["unique_count"] = distinct[f"d_{i}"]
        if fams[c] == "boolean":
            out[c] = {"type": "boolean", **base, "true_count": row[f"true_{i}"], "false_count": n - row[f"true_{i}"], "representation": True}
        elif fams[c] == "datetime":
            out[c] = {"type": "datetime", **base, "min_date": str(lo), "max_date": str(hi)}
        elif fams[c] == "string" and distinct[f"d_{i}"] <= 2 and any({lo, hi} <= set(p) for p in BOOLEAN_PAIRS):
            yes = next(p[0] for p in BOOLEAN_PAIRS if {lo, hi} <= set(p))
            out[c] = {"type": "boolean", **base, "representation": yes}
            categories.append(c)
        elif c in nums or row[f"num_{i}"]:
            out[c] = {"type": "integer" if row[f"w_{i}"] else "float", **base}
            as_number.append(c)
        elif row[f"ts_{i}"]:
            out[c] = {"type": "datetime", **base, "min_date": str(row[f"tlo_{i}"]), "max_date": str(row[f"thi_{i}"])}
        elif distinct[f"d_{i}"] < 0.5 * n:
            out[c] = {"type": "categorical", **base}
            categories.append(c)
        else:
            found = [p for p in ("email", "url", "phone", "uuid") if row[f"{p}_{i}"]]
            found += ["name"] if row[f"name_{i}"] > 0.5 * n else []
            out[c] = {"type": "text", **base, "avg_length": row[f"alen_{i}"], "min_length": row[f"llen_{i}"],
                      "max_length": row[f"hlen_{i}"], "detected_patterns": found}
        if fams[c] == "string" and out[c]["type"] in ("text", "categorical") and lo != hi:
            # the smallest and the largest value share exactly the prefix that all values share
            out[c]["common_prefix"] = _shared(lo, hi)
            out[c]["common_suffix"] = _shared(row[f"rlo_{i}"], row[f"rhi_{i}"])[::-1]
    if as_number:
        numbers = df.select(*[F.col(c).cast("double").alias(c) if c in nums else C.parse_number(F.col(c)).alias(c) for c in as_number])
        shapes, middles = shape(numbers, as_number), exact_quantiles(numbers, as_number, [0.5])
        for c in as_number:
            s, facts = shapes[c], out[c]
            facts |= {"min": s["min"], "max": s["max"], "mean": s["mean"], "std": s["std"], "median": middles[c][0]}
            run = facts["unique_count"] == s["n"] and s["max"] - s["min"] + 1 == s["n"] > 1
            if facts["type"] == "integer" and run:
                facts |= {"is_sequence": True, "sequence_start": int(s["min"]), "sequence_step": 1}
            if distributions:
                facts["distribution"] = distribution_label(numbers, c)
    if categories:
        for r in top_values(df, categories, 10).collect():  # <= 10 rows per column
            facts = out[r["column"]]
            if facts["type"] == "boolean":
                side = "true_count" if r["value"] == facts["representation"] else "false_count"
                facts[side] = r["n"]
            else:
                facts.setdefault("top_categories", {})[r["value"]] = r["n"]
        for c in categories:
            if out[c]["type"] == "categorical":
                top = max(out[c]["top_categories"].items(), key=lambda kv: kv[1])
                out[c] |= {"top_value": top[0], "top_frequency": top[1] / (out[c]["total_count"] - out[c]["null_count"])}
            else:
                out[c].setdefault("true_count", 0)
                out[c].setdefault("false_count", 0)
    return out


def _shared(a: str, b: str) -> str:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def is_sequence(df: DataFrame, col: str) -> DataFrame:
    """Whether the values are a run of whole numbers; an aggregate test, no sort."""
    v = F.col(col)
    return df.agg(
        F.coalesce(
            (F.count(v) > 1) & (F.max(v) - F.min(v) + 1 == F.count(v)) & (F.count_distinct(v) == F.count(v))
            & F.bool_and(v == F.floor(v)), F.lit(False),
        ).alias("is_sequence"),
        F.min(v).alias("sequence_start"),
    )


def patterns_table(df: DataFrame, patterns: dict[str, dict]) -> DataFrame:
    """Column facts as rows: column, type, fact, value (text)."""
    rows = [(c, p["type"], k, str(v)) for c, p in patterns.items() for k, v in p.items() if k != "type"]
    return df.sparkSession.createDataFrame(rows, "column string, type string, fact string, value string")


def learn(df: DataFrame, threshold: float = 0.7) -> dict:
    """Everything a generator needs from a sample: column patterns, strong correlations, functional
    dependencies of non-key columns, outlier and missing rates, time steps."""
    patterns = analyze_patterns(df)
    nums = [c for c in C.numeric_columns(df) if not patterns[c].get("is_sequence")]
    strong = correlations(df, nums, threshold).collect() if len(nums) > 1 else []  # columns squared rows
    few = [c for c, p in patterns.items() if p["type"] in ("categorical", "boolean", "integer") and not p.get("is_sequence")]
    deps = functional_deps(df, few).where("holds and not is_key").collect() if len(few) > 1 else []
    if nums:
        fences = iqr_bounds(df, nums)
        row = df.agg(*[F.count_if(outside(F.col(c), fences[c])).alias(f"o_{i}") for i, c in enumerate(nums)]).first()
        for i, c in enumerate(nums):
            patterns[c]["outlier_rate"] = row[f"o_{i}"] / max(patterns[c]["total_count"], 1)
    for c, p in patterns.items():
        p["missing_rate"] = p["null_count"] / max(p["total_count"], 1)
        if p["type"] == "datetime" and c in C.date_columns(df):
            step = gaps(df.select(c), c).groupBy("gap").count().orderBy(F.desc("count"), F.asc("gap")).limit(1)
            first = step.select("gap", frequency_label(F.col("gap")).alias("frequency")).first()
            if first is not None:
                p |= {"interval_seconds": first["gap"], "frequency": first["frequency"]}
    # a ladder of literals holds the first ten; what has more is drawn from its whole frequency table
    many = [c for c, p in patterns.items() if p["type"] == "categorical" and p["unique_count"] > len(p["top_categories"])]
    counted = {c: df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")) for c in many}
    return {
        "patterns": patterns,
        "frequencies": counted,
        "correlations": [(r["column_a"], r["column_b"], r["correlation"]) for r in strong],
        "dependencies": [(r["determinant"], r["dependent"]) for r in deps],
    }
