"""Privacy and compliance transforms."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.functions import rng
from sievemill.operators.ordered import ordered_scan
from sievemill.operators.profile import distinct_counts, value_counts
from sievemill.session import stored

# --- fixed values: name parts of personal, health and card columns ------------------------------
PII_PARTS = ("name", "email", "phone", "address", "ssn", "dob")
PHI_PARTS = ("patient", "diagnosis", "treatment", "medication", "medical")
ACCOUNT_PARTS = ("account", "card")
QUASI_NAMES = ("age", "zipcode", "gender", "birthdate", "address")
# -----------------------------------------------------------------------------------------------


def _named(columns: Sequence[str], parts: Sequence[str]) -> list[str]:
    return [c for c in columns if any(p in c.lower() for p in parts)]


def pii_columns(columns: Sequence[str]) -> list[str]:
    return _named(columns, PII_PARTS)


def phi_columns(columns: Sequence[str]) -> list[str]:
    return _named(columns, PHI_PARTS)


def pseudonymize(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Values replaced by a short sha-256; personal columns by name unless given."""
    cols = pii_columns(df.columns) if cols is None else cols
    return df.withColumns({c: C.short_hash(F.col(c)) for c in cols}) if cols else df


def mask_cards(df: DataFrame, cols: Sequence[str] | None = None, luhn: bool = False) -> DataFrame:
    """Card numbers (13-19 digits, blanks and dashes ignored) keep four characters at each end.

    ``luhn`` masks only numbers whose check digit is right.
    """
    plan = {}
    for c in cols or C.string_columns(df):
        bare = F.regexp_replace(c, "[ -]", "")
        card = bare.rlike(r"^\d{13,19}$")
        if luhn:
            card = card & F.call_function("luhn_check", bare)
        plan[c] = F.when(card, C.mask_middle(F.col(c))).otherwise(F.col(c))
    return df.withColumns(plan) if plan else df


def mask_accounts(df: DataFrame) -> DataFrame:
    """Text of account / card columns longer than eight characters is masked in the middle."""
    cols = [c for c in _named(df.columns, ACCOUNT_PARTS) if c in C.string_columns(df)]
    plan = {c: F.when(F.length(c) > 8, C.mask_middle(F.col(c))).otherwise(F.col(c)) for c in cols}
    return df.withColumns(plan) if plan else df


def mask_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to short hashes, other values to a reproducible number below 10,000."""
    texts = C.string_columns(df)
    plan = {}
    for c in cols:
        if c in texts:
            plan[c] = C.short_hash(F.col(c))
        elif c in df.columns:
            number = F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 13), 16, 10).cast("bigint") % 10000
            plan[c] = F.when(F.col(c).isNotNull(), number)
    return df.withColumns(plan) if plan else df


def _generalize(df: DataFrame, cols: Sequence[str], k: int, bins: int, other: str) -> DataFrame:
    nums = [c for c in cols if c in C.numeric_columns(df)]
    if nums:
        ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(nums) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        plan = {}
        for i, c in enumerate(nums):
            if ends[f"lo_{i}"] is not None:
                plan[c] = C.linear_bin(F.col(c).cast("double"), ends[f"lo_{i}"], ends[f"hi_{i}"], bins)
        df = df.withColumns(plan)
    for c in cols:
        if c in nums:
            continue
        rare = stored(value_counts(df, [c]).where(F.col("n") < k).select(F.col("value").alias("_rare")))
        joined = df.join(rare, F.col(c).cast("string") == F.col("_rare"), "left")
        # the label is text, so a date column becomes text too
        df = joined.select(*[
            F.when(F.col("_rare").isNotNull(), F.lit(other)).otherwise(F.col(x).cast("string")).alias(x) if x == c else F.col(x)
            for x in df.columns
        ])
    return df


def _distinct_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    row = C.beside(df.agg(F.count(F.lit(1)).alias("n")), distinct_counts(df, {f"d_{i}": [c] for i, c in enumerate(df.columns)})).first()
    return row["n"], {c: row[f"d_{i}"] for i, c in enumerate(df.columns)}


def generalize(df: DataFrame, k: int, qi: Sequence[str] | None = None) -> DataFrame:
    """Quasi-identifiers coarsened: numbers to equal-width bins, rare categories to OTHER.

    By default a column is one when it has more than k and fewer than 80 % distinct values.
    """
    if qi is None:
        n, distinct = _distinct_counts(df)
        qi = [c for c in df.columns if k < distinct[c] < n * 0.8]
    else:
        n = df.count()
    return _generalize(df, qi, k, max(n // k, 5), "OTHER")


def k_anonymize(df: DataFrame, k: int, qi: Sequence[str] | None = None) -> DataFrame:
    """Generalise, then drop rows of classes smaller than k."""
    if qi is None:
        qi = [c for c in df.columns if c.lower() in QUASI_NAMES]
        n, distinct = _distinct_counts(df)
        if not qi:
            qi = [c for c in df.columns if distinct[c] > n * 0.1]
    else:
        n = df.count()
    if not qi:
        return df
    coarse = _generalize(df, qi, k, max(n // k, 1), "Other")
    return suppress(coarse, qi, F.count(F.lit(1)) >= k)


def suppress(df: DataFrame, qi: Sequence[str], keep: Column) -> DataFrame:
    """Rows whose class satisfies the aggregate ``keep``.  Class sizes are combined map-side; the
    rows then meet a table with one row per class, so a class with a third of the rows can be split."""
    classes = stored(df.groupBy(*[F.col(c).alias(f"_q_{c}") for c in qi]).agg(keep.alias("_keep")).where("_keep"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in qi])
    return df.join(classes, on, "left_semi")


def l_diversify(df: DataFrame, qi: Sequence[str], sensitive: str, l: int) -> DataFrame:  # noqa: E741
    """Rows of classes with at least ``l`` distinct sensitive values."""
    return suppress(df, qi, F.count_distinct(sensitive) >= l)


def t_close(df: DataFrame, qi: Sequence[str], sensitive: str, t: float) -> DataFrame:
    """Rows of classes whose sensitive distribution is within total variation ``t`` of the table's."""
    n = df.count()
    cells = df.groupBy(*qi, sensitive).agg(F.count(F.lit(1)).alias("_n"))
    overall = cells.groupBy(F.col(sensitive).alias("_s")).agg((F.sum("_n") / F.lit(n)).alias("_g"))
    classes = cells.groupBy(*[F.col(c).alias(f"_q_{c}") for c in qi]).agg(F.sum("_n").alias("_size"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in qi])
    joined = cells.join(classes, on).join(overall, F.col(sensitive).eqNullSafe(F.col("_s")))
    # values a class lacks weigh 1 - sum(global share of those it has)
    distance = (F.sum(F.abs(F.col("_n") / F.col("_size") - F.col("_g"))) + 1 - F.sum("_g")) / 2
    near = joined.groupBy(*[f"_q_{c}" for c in qi]).agg(distance.alias("_t")).where(F.col("_t") <= t)
    near = stored(near)
    return df.join(near, on, "left_semi")


def laplace_noise(
    df: DataFrame, cols: Sequence[str] | None, epsilon: float, key: str, seed: int = 42,
    bounds: Mapping[str, tuple[float, float]] | None = None, clip: bool = False,
) -> DataFrame:
    """Laplace noise of scale range / epsilon.  The range is observed unless ``bounds`` gives it."""
    cols = [c for c in (cols or C.numeric_columns(df)) if c != key]
    known = dict(bounds or {})
    todo = [c for c in cols if c not in known]
    if todo:
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(todo) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        known |= {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(todo)}
    plan = {}
    for c in cols:
        lo, hi = known[c]
        if lo is None:
            continue
        centred = rng.uniform_open(seed, f"laplace:{c}", key) - 0.5
        noise = F.lit(-(hi - lo) / epsilon) * F.signum(centred) * F.log(F.lit(1.0) - F.abs(centred) * 2)
        value = F.col(c) + noise
        plan[c] = C.clip(value, float(lo), float(hi)) if clip else value
    return df.withColumns(plan)


def randomized_response(df: DataFrame, cols: Sequence[str] | None, epsilon: float, key: str, seed: int = 42) -> DataFrame:
    """Keep a category with probability e^eps / (e^eps + m - 1), else draw any of the m values."""
    cols = [c for c in (cols or C.string_columns(df)) if c != key]
    for c in cols:
        domain = df.select(F.col(c).alias("_v")).where(F.col(c).isNotNull()).distinct()
        m = domain.count()
        if m == 0:
            continue
        keep = math.exp(epsilon) / (math.exp(epsilon) + m - 1)
        swap = F.col(c).isNotNull() & (rng.uniform(seed, f"keep:{c}", key) > F.lit(keep))
        at = F.floor(rng.uniform(seed, f"draw:{c}", key) * F.lit(m)).cast("bigint") + 1
        numbered = ordered_scan(domain, ["_v"], number="_at")
        # kept rows get negative numbers of their own, which meet nothing: nulls would all land in one partition of the join
        none = F.lit(-1) - F.pmod(F.xxhash64(key), F.lit(1 << 20))
        joined = df.withColumn("_want", F.when(swap, at).otherwise(none)).join(numbered, F.col("_want") == F.col("_at"), "left")
        df = joined.select(*[F.coalesce("_v", c).alias(c) if x == c else F.col(x) for x in df.columns])
    return df


def apply_privacy(
    df: DataFrame, *, k: int | None = None, l: int | None = None, t: float | None = None, mask: Sequence[str] = (),  # noqa: E741
    epsilon: float | None = None, key: str | None = None, qi: Sequence[str] | None = None, sensitive: str | None = None, seed: int = 42,
) -> DataFrame:
    """Switchboard: every technique whose argument is given, in a fixed order."""
    if epsilon is not None:
        df = laplace_noise(df, [c for c in C.numeric_columns(df) if c != key], epsilon, key, seed)
    if k is not None:
        df = k_anonymize(df, k, qi) if qi else generalize(df, k)
    if l is not None and qi and sensitive:
        df = l_diversify(df, qi, sensitive, l)
    if t is not None and qi and sensitive:
        df = t_close(df, qi, sensitive, t)
    return mask_columns(df, mask) if mask else df


# --- fixed values: what each preset switches on, and the default strengths ----------------------
PRESETS = {
    "gdpr": ("mask", "k"),
    "hipaa": ("noise", "mask", "k", "l"),
    "pci": ("mask",),
    "healthcare": ("mask", "k", "l"),
    "finance": ("accounts",),
}
DEFAULT_K, DEFAULT_L, DEFAULT_T = 5, 3, 0.2
# -----------------------------------------------------------------------------------------------


def apply_compliance(
    df: DataFrame, presets: Sequence[str], *, qi: Sequence[str], sensitive: str | None = None, key: str | None = None,
    epsilon: float = 1.0, seed: int = 42,
) -> DataFrame:
    """Compliance presets combined: gdpr, hipaa, pci, and the industries healthcare, finance."""
    wanted = {step for p in presets for step in PRESETS[p]}
    if "noise" in wanted and key is not None:
        keep = {key, *qi}
        df = laplace_noise(df, [c for c in C.numeric_columns(df) if c not in keep], epsilon, key, seed)
    if "k" in wanted:
        df = k_anonymize(df, DEFAULT_K, qi)
    if "l" in wanted and sensitive:
        df = l_diversify(df, qi, sensitive, DEFAULT_L)
    if "mask" in wanted:
        found = set(pii_columns(df.columns)) | (set(phi_columns(df.columns)) if {"hipaa", "healthcare"} & set(presets) else set())
        df = mask_cards(mask_columns(df, sorted(found - set(qi) - {sensitive})))
    if "accounts" in wanted:
        df = mask_accounts(df)
    return df
