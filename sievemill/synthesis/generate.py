"""Synthetic tables: single columns, learned patterns, plain configurations, related tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.columns import clip
from sievemill.operators.ordered import ordered_scan
from sievemill.operators.privacy import laplace_noise
from sievemill.synthesis.draw import COUNTRIES, STATES, Draw, normal_cdf, rows


def gen_integer(d: Draw, name: str, p: Mapping) -> Column:
    """Sequence, uniform, or clipped normal whole numbers."""
    if p.get("is_sequence"):
        return (F.lit(p.get("sequence_start", 1)) + d.key * p.get("sequence_step", 1)).cast("bigint")
    low, high = int(p["min"]), int(p["max"])
    if p.get("distribution") == "uniform":
        return d.integer(name, low, high)
    return d.normal(name, *_centre(p, low, high), low, high).cast("bigint")


def gen_float(d: Draw, name: str, p: Mapping) -> Column:
    """Uniform, exponential, or normal reals, clipped to the range."""
    low, high = float(p["min"]), float(p["max"])
    mean, std = _centre(p, low, high)
    how = p.get("distribution")
    if how == "uniform":
        return d.real(name, low, high)
    if how == "exponential":
        return clip(d.exponential(name, mean), low, high)
    return d.normal(name, mean, std, low, high)


def _centre(p: Mapping, low: float, high: float) -> tuple[float, float]:
    mean, std = p.get("mean"), p.get("std")
    return ((low + high) / 2 if mean is None else mean), ((high - low) / 4 if std is None else std)


def gen_datetime(d: Draw, name: str, p: Mapping, n: int | None = None) -> Column:
    """Regular series, else random in range.  With the row count the values ascend with the row key:
    each row draws inside its own slice of the range, so nothing has to be sorted."""
    lo, hi = (F.unix_micros(F.lit(str(p[k])).cast("timestamp")) for k in ("min_date", "max_date"))
    if p.get("is_regular_series"):
        step = F.lit(int(round(float(p["interval_seconds"]) * 1_000_000)))
        return F.timestamp_micros(lo + d.key * step)
    share = d.uniform(name) if n is None else (d.key + d.uniform(name)) / F.lit(float(n))
    return F.timestamp_micros((lo + F.floor(share * (hi - lo) / 1_000_000) * 1_000_000).cast("bigint"))


# --- fixed values: the other side of each spelling of true --------------------------------------
FALSE_OF = {"True": "False", "true": "false", "TRUE": "FALSE", "Yes": "No", "yes": "no", "YES": "NO", "Y": "N", "y": "n", "1": "0"}
# -----------------------------------------------------------------------------------------------


def gen_boolean(d: Draw, name: str, p: Mapping) -> Column:
    """True with the observed share, in the observed spelling."""
    yes, no = p.get("true_count", 0), p.get("false_count", 0)
    hit = d.chance(name, yes / (yes + no) if yes + no else 0.5)
    spelling = p.get("representation", True)
    return hit if spelling not in FALSE_OF else F.when(hit, spelling).otherwise(FALSE_OF[spelling])


def gen_categorical(d: Draw, name: str, p: Mapping) -> Column:
    """Category by observed frequency."""
    weights = p.get("categories") or p.get("top_categories") or {f"Category_{i}": 1 for i in range(5)}
    return d.weighted(name, dict(weights))


def gen_text(d: Draw, name: str, p: Mapping) -> Column:
    """Text of the detected kind, else from prefix and suffix, else words."""
    kinds = p.get("detected_patterns", [])
    makers = {"email": d.email, "url": d.url, "phone": d.phone, "uuid": d.uuid, "name": d.full_name}
    for kind, make in makers.items():
        if kind in kinds:
            return make(name)
    prefix, suffix = p.get("common_prefix", ""), p.get("common_suffix", "")
    length = int(p.get("avg_length", 10))
    if prefix or suffix:
        middle = max(1, length - len(prefix) - len(suffix))
        text = F.concat(*[d.hex(f"{name}.{i}") for i in range(0, middle, 32)])
        return F.concat(F.lit(prefix), F.substring(text, 1, middle), F.lit(suffix))
    if length > 50:
        return F.concat_ws(" ", *[d.sentence(f"{name}.{i}") for i in range(max(1, round(length / 70)))])
    return F.concat(d.word(name), d.digits(name, 5))


GENERATORS = {
    "integer": gen_integer, "float": gen_float, "datetime": gen_datetime, "boolean": gen_boolean,
    "categorical": gen_categorical, "text": gen_text,
}


def generate(
    base: DataFrame, key: str, learned: Mapping, *, seed: int = 42, missing: float | None = None, outliers: float | None = None,
    relationships: bool = True, many: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Rows with the learned patterns.  ``base`` holds the row keys (see :func:`draw.rows`).

    Column expressions only, so the job is one narrow stage.  ``many`` gives a frequency table
    (value, n) for categories too numerous for a literal ladder; those that were learned are used without it.
    """
    patterns = learned["patterns"]
    many = {**learned.get("frequencies", {}), **(many or {})}
    d, out = Draw(seed, F.col(key)), {}
    for c, p in patterns.items():
        if p["type"] in GENERATORS:
            out[c] = GENERATORS[p["type"]](d, c, p)
        else:
            out[c] = F.lit(None).cast("string")
    df = base.select(F.col(key).alias("_key"), *[e.alias(c) for c, e in out.items()])
    for c, table in many.items():
        df = draw_from_table(df, c, table, "_key", seed)
    if relationships:
        pairs = learned.get("correlations", [])
        df = correlate(df, pairs, patterns, "_key", seed)
        # a pair that is already tied by its correlation is not redrawn from the determinant
        tied = {frozenset(p[:2]) for p in pairs}
        for a, b in learned.get("dependencies", []):
            if a in df.columns and b in df.columns and frozenset((a, b)) not in tied:
                df = draw_from_table(df, b, many[b], a, seed) if b in many else df.withColumn(b, gen_dependent(a, b, patterns[b], seed))
    if missing is not None:
        df = inject_missing(df, {c: min(p.get("missing_rate", 0.0), missing) for c, p in patterns.items()}, "_key", seed)
    if outliers is not None:
        df = inject_outliers(df, {c: p for c, p in patterns.items() if p["type"] in ("integer", "float")}, outliers, "_key", seed)
    return df.drop("_key")


def gen_dependent(determinant: str, name: str, pattern: Mapping, seed: int = 42) -> Column:
    """Value drawn from the determinant's value, so equal determinants give equal results."""
    return GENERATORS[pattern["type"]](Draw(seed, F.col(determinant)), f"{determinant}>{name}", pattern)


def draw_from_table(df: DataFrame, column: str, table: DataFrame, key: str, seed: int) -> DataFrame:
    """Category by frequency from a table (value, n) of any size: the draw is a rank, ranks and
    cumulated counts are merged in one ordered scan."""
    counted = ordered_scan(table.select("value", "n"), ["value"], sums={"cum": F.col("n")})
    total = table.agg(F.sum("n")).first()[0]
    rank = F.floor(Draw(seed, F.col(key)).uniform(column) * F.lit(total)) + F.lit(0.5)
    wanted = df.select(F.col(key).alias("k"), rank.alias("at"), F.lit(None).cast("string").alias("value"))
    bounds = counted.select(F.lit(None).cast("bigint").alias("k"), F.col("cum").cast("double").alias("at"), "value")
    merged = ordered_scan(wanted.unionByName(bounds), ["at", "k"], following={"_v": "value"})
    picked = merged.where(F.col("k").isNotNull()).select(F.col("k").alias("_k"), "_v")
    joined = df.join(picked, F.col(key) == F.col("_k"))
    return joined.select(*[F.col("_v").alias(c) if c == column else F.col(c) for c in df.columns])


def correlate(df: DataFrame, pairs: Sequence[tuple[str, str, float]], patterns: Mapping, key: str, seed: int = 42) -> DataFrame:
    """Second column of each pair redrawn as r x first + sqrt(1 - r^2) x noise, on the standardised
    scale, then put back to its own mean, spread and range."""
    for a, b, r in pairs:
        pa, pb = patterns[a], patterns[b]
        if not pa.get("std") or not pb.get("std"):
            continue
        noise = Draw(seed, F.col(key)).normal(f"{a}~{b}")
        z = (F.col(a) - F.lit(pa["mean"])) / F.lit(pa["std"]) * F.lit(r) + noise * F.lit(max(0.0, 1 - r * r) ** 0.5)
        value = clip(z * F.lit(pb["std"]) + F.lit(pb["mean"]), pb["min"], pb["max"])
        df = df.withColumn(b, value.cast("bigint") if pb["type"] == "integer" else value)
    return df


def gen_correlated(base: DataFrame, key: str, corr: Sequence[Sequence[float]], targets: Mapping[str, Mapping], seed: int = 42) -> DataFrame:
    """Columns with the given correlation matrix and marginals (normal / uniform / exponential).

    The matrix is factored once on the driver; a row's values are a linear mix of its own draws.
    """
    factor = np.linalg.cholesky(np.asarray(corr, dtype=float))
    d = Draw(seed, F.col(key))
    own = [d.normal(f"copula.{i}") for i in range(len(targets))]
    made = base
    for i, (name, p) in enumerate(targets.items()):
        z = sum((own[j] * F.lit(float(factor[i, j])) for j in range(1, i + 1)), own[0] * F.lit(float(factor[i, 0])))
        how = p.get("distribution", "normal")
        if how == "normal":
            value = F.lit(float(p["mean"])) + z * F.lit(float(p["std"]))
        elif how == "uniform":
            value = F.lit(float(p["min"])) + normal_cdf(z) * F.lit(float(p["max"] - p["min"]))
        else:
            value = F.lit(-float(p["scale"])) * F.log(F.greatest(F.lit(1.0) - normal_cdf(z), F.lit(1e-12)))
        made = made.withColumn(name, value)
    return made


def inject_missing(df: DataFrame, rates: Mapping[str, float], key: str, seed: int = 42) -> DataFrame:
    """Cells nulled with the given rate per column."""
    d = Draw(seed, F.col(key))
    plan = {c: F.when(~d.chance(f"missing.{c}", r), F.col(c)) for c, r in rates.items() if r > 0 and c in df.columns}
    return df.withColumns(plan) if plan else df


def inject_outliers(df: DataFrame, patterns: Mapping[str, Mapping], rate: float, key: str, seed: int = 42) -> DataFrame:
    """Values moved 0.1 to 0.5 ranges below the minimum or above the maximum."""
    d = Draw(seed, F.col(key))
    plan = {}
    for c, p in patterns.items():
        span = float(p["max"]) - float(p["min"])
        move = d.real(f"outlier.{c}.by", 0.1, 0.5) * F.lit(span)
        far = F.when(d.chance(f"outlier.{c}.side", 0.5), F.lit(float(p["min"])) - move).otherwise(F.lit(float(p["max"])) + move)
        value = F.when(d.chance(f"outlier.{c}", rate), far).otherwise(F.col(c))
        plan[c] = value.cast("bigint") if p["type"] == "integer" else value
    return df.withColumns(plan) if plan else df


def people_column(d: Draw, name: str, kind: str, as_of: str) -> Column:
    """Column of a table of people, by its name."""
    low = name.lower()
    if "name" in low:
        return d.first_name(name) if "first" in low else d.last_name(name) if "last" in low else d.full_name(name)
    by_part = {
        "email": lambda: d.email(name), "phone": lambda: d.phone(name), "address": lambda: d.address(name),
        "city": lambda: d.city(name), "state": lambda: d.choice(name, STATES), "country": lambda: d.choice(name, COUNTRIES),
        "age": lambda: d.integer(name, 18, 80),
        "birth": lambda: F.date_sub(F.to_date(F.lit(as_of)), d.integer(name, 18 * 365, 80 * 365).cast("int")),
        "dob": lambda: F.date_sub(F.to_date(F.lit(as_of)), d.integer(name, 18 * 365, 80 * 365).cast("int")),
        "gender": lambda: d.choice(name, ["Male", "Female", "Other"]),
        "salary": lambda: d.integer(name, 30000, 150000), "income": lambda: d.integer(name, 30000, 150000),
    }
    return next((make() for part, make in by_part.items() if part in low), generic_column(d, name, kind, as_of))


def numeric_column(d: Draw, name: str, kind: str, as_of: str) -> Column:
    """Numeric column by its name."""
    low = name.lower()
    if "price" in low or "cost" in low:
        return d.real(name, 10, 1000, 2)
    if "quantity" in low or "count" in low:
        return d.integer(name, 1, 100)
    if "percent" in low:
        return d.real(name, 0, 100, 2)
    if "score" in low:
        return d.integer(name, 0, 100)
    return d.integer(name, -1000, 1000) if kind == "integer" else d.real(name, -1000, 1000, 2)


def timeseries_column(d: Draw, name: str, kind: str, as_of: str, n: int = 0) -> Column:
    """Daily dates up to ``as_of``, or a trend of 0.1 per row with noise."""
    if kind == "date":
        return F.date_add(F.date_sub(F.to_date(F.lit(as_of)), n), d.key.cast("int"))
    if kind in ("integer", "float"):
        value = F.lit(100.0) + d.key * 0.1 + d.normal(name, 0, 10)
        return value.cast("bigint") if kind == "integer" else F.round(value, 2)
    return generic_column(d, name, kind, as_of)


def generic_column(d: Draw, name: str, kind: str, as_of: str) -> Column:
    """Column by its declared type alone."""
    makers = {
        "string": lambda: d.word(name), "integer": lambda: d.integer(name, 0, 1000), "float": lambda: d.real(name, 0, 1000, 2),
        "currency": lambda: d.real(name, 0, 1000, 2),
        "date": lambda: F.date_sub(F.to_date(F.lit(as_of)), d.integer(name, 0, 365).cast("int")),
        "boolean": lambda: d.chance(name, 0.5), "category": lambda: d.choice(name, [f"Category_{i}" for i in range(5)]),
        "email": lambda: d.email(name), "phone": lambda: d.phone(name), "name": lambda: d.full_name(name), "address": lambda: d.address(name),
    }
    return makers[kind]() if kind in makers else F.concat(F.lit("Value_"), d.key.cast("string"))


def generate_config(base: DataFrame, key: str, cols: Sequence[Mapping], kind: str = "generic", seed: int = 42, as_of: str = "2024-01-01", n: int = 0,
                    keep: Mapping[str, str] | None = None) -> DataFrame:
    """Table from a plain list of {name, type}; ``kind`` is people, numeric, timeseries or generic.

    ``keep`` carries columns of ``base`` over under a new name.
    """
    d = Draw(seed, F.col(key))
    out = [F.col(source).alias(name) for name, source in (keep or {}).items()]
    for c in cols:
        name, t = c["name"], c.get("type", "string")
        if kind == "people":
            made = people_column(d, name, t, as_of)
        elif kind == "numeric":
            made = numeric_column(d, name, t, as_of)
        elif kind == "timeseries":
            made = timeseries_column(d, name, t, as_of, n)
        else:
            made = generic_column(d, name, t, as_of)
        out.append(made.alias(name))
    return base.select(*out)


def table_order(tables: Sequence[Mapping], relations: Sequence[Mapping]) -> list[str]:
    """Parents before children."""
    waits = {t["name"]: {r["to"] for r in relations if r["from"] == t["name"] and r["to"] != t["name"]} for t in tables}
    done: list[str] = []
    while waits:
        free = [name for name, on in waits.items() if not (on & waits.keys())]
        if not free:
            raise ValueError(f"tables refer to each other in a circle: {sorted(waits)}")
        done += free
        waits = {k: v for k, v in waits.items() if k not in free}
    return done


def generate_tables(spark, tables: Sequence[Mapping], relations: Sequence[Mapping], seed: int = 42, epsilon: float | None = None) -> dict[str, DataFrame]:
    """Related tables with referential integrity.

    Primary keys are 1..rows, so a foreign key is a draw from the parent's row count: no join and no
    shuffle.  A relation is {"from": child, "column": fk column, "to": parent}; without "column" it
    covers every foreign_key column of the child.
    """
    sizes = {t["name"]: int(t["rows"]) for t in tables}
    configs = {t["name"]: t for t in tables}
    out = {}
    for name in table_order(tables, relations):
        d = Draw(seed, F.col("_id"))
        cols = []
        for c in configs[name]["columns"]:
            stream = f"{name}.{c['name']}"
            if c["type"] == "id":
                made = d.key + 1
            elif c["type"] == "foreign_key":
                rel = next((r for r in relations if r["from"] == name and r.get("column", c["name"]) == c["name"]), None)
                made = d.integer(stream, 1, sizes[rel["to"]]) if rel else d.key + 1
            else:
                made = {
                    "integer": lambda: d.integer(stream, 1, 999), "float": lambda: d.real(stream, 0, 1000),
                    "date": lambda: d.date(stream, "2020-01-01", "2024-01-01"), "boolean": lambda: d.chance(stream, 0.5),
                    "email": lambda: d.email(stream),
                }.get(c["type"], lambda: d.word(stream))()
            cols.append(made.alias(c["name"]))
        df = rows(spark, sizes[name]).select("_id", *cols)
        if epsilon is not None:
            noisy = [c["name"] for c in configs[name]["columns"] if c["type"] in ("integer", "float")]
            df = laplace_noise(df, noisy, epsilon, "_id", seed) if noisy else df
        out[name] = df.drop("_id")
    return out


def assign_foreign_key(df: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str, seed: int = 42) -> DataFrame:
    """Foreign key drawn from the keys an existing parent table holds: the parent's keys are
    numbered, and a child meets the key whose number it drew."""
    keys = parent.select(F.col(parent_key).alias(name)).where(F.col(name).isNotNull()).distinct()
    n = keys.count()
    numbered = ordered_scan(keys, [name], number="_at")
    wanted = Draw(seed, F.col(key)).integer(f"fk.{name}", 1, max(n, 1))
    return df.withColumn("_at", wanted).join(numbered, "_at", "left").drop("_at")


def apply_relations(df: DataFrame, relations: Sequence[Mapping], key: str, seed: int = 42, lookups: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Relations inside a template: ``dependent`` (target date = source + 1..14 days), ``calculation``
    (product of the sources, or an own expression), ``lookup`` (target from a table, else fixed by the
    source's value)."""
    d = Draw(seed, F.col(key))
    for r in relations:
        sources = [s.strip() for s in r["source"].split(",")]
        target = r["target"]
        if any(s not in df.columns for s in sources):
            continue
        if r["type"] == "dependent":
            days = d.integer(f"rel.{target}", 1, 14).cast("int")
            df = df.withColumn(target, F.date_add(F.col(sources[0]).cast("date"), days))
        elif r["type"] == "calculation":
            if "expression" in r:
                value = F.expr(r["expression"])
            else:
                value = F.col(sources[0])
                for s in sources[1:]:
                    value = value * F.col(s)
            df = df.withColumn(target, F.round(value.cast("double"), 2))
        elif r["type"] == "lookup":
            table = (lookups or {}).get(target)
            if table is not None:
                df = df.drop(target).join(table.select(sources[0], target), sources[0], "left")
            else:
                own = Draw(seed, F.col(sources[0]))
                made = own.choice(f"lookup.{target}", r["values"]) if "values" in r else own.word(f"lookup.{target}")
                df = df.withColumn(target, made)
    return df
