"""Order-dependent operators (fills, lags, running sums) that survive hot groups.

``ordered_scan`` measures the largest group, in rows and in bytes.  When it fits one task the ordinary window form is
used.  Otherwise rows are range-partitioned on (group, order) into chunks, each chunk is scanned
on its own, and what a chunk needs from its neighbours (a sum, the last value seen ...) is taken
from a table with one row per (group, chunk).  Both forms return the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.functions.columns import beside
from sievemill.session import cut, limit


def group_sizes(df: DataFrame, part: Sequence[str]) -> tuple[int, int]:
    """(rows, rows of the largest group); partial counts are combined map-side."""
    if not part:
        n = df.count()
        return n, n
    row = df.groupBy(*part).count().agg(F.sum("count").alias("n"), F.max("count").alias("m")).first()
    return int(row["n"] or 0), int(row["m"] or 0)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: eight a field, and what strings, binaries and nested values hold beside that."""
    size = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
    return size


def group_weights(df: DataFrame, part: Sequence[str]) -> tuple[int, int, int, int]:
    """(rows, rows of the largest group, bytes, bytes of the heaviest group), counted in the map tasks first."""
    per_group = df.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df).cast("bigint")).alias("b"))
    row = per_group.agg(F.sum("n"), F.max("n"), F.sum("b"), F.max("b")).first()
    return tuple(int(x or 0) for x in row)


def ordered_scan(
    df: DataFrame,
    order: Sequence[str],
    part: Sequence[str] = (),
    *,
    sums: Mapping[str, Column] | None = None,
    last: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    lag: Mapping[str, str] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add order-dependent columns to ``df``.

    ``order`` must be a total order inside a group.  ``sums`` maps an output name to an expression
    summed over the rows up to the current one; ``last`` / ``following`` to a column whose latest /
    next non-null value is wanted (the current row included); ``lag`` to a column whose previous
    value is wanted; ``number`` names a row number from 1.
    """
    sums, last = dict(sums or {}), dict(last or {})
    following, lag = dict(following or {}), dict(lag or {})
    part, order = list(part), list(order)
    spark = df.sparkSession
    rows, biggest, size, heaviest = group_weights(df, part)

    if biggest <= limit(spark, "sievemill.groupRows") and heaviest <= limit(spark, "sievemill.groupBytes"):
        return df.withColumns(_local(part, order, sums, last, following, lag, number))

    chunks = max(2, math.ceil(rows / limit(spark, "sievemill.chunkRows")), math.ceil(size / limit(spark, "sievemill.chunkBytes")))
    # the chunk number is written down with the rows: range bounds are sampled, so recomputing
    # them in the second pass could give another split
    rows_df = cut(
        df.repartitionByRange(chunks, *[F.col(c) for c in part + order]).withColumn("_chunk", F.spark_partition_id())
    )
    keys = part + ["_chunk"]
    rank = F.struct(*order)
    carried = {"_n": F.count(F.lit(1))}
    for out, expr in sums.items():
        carried[f"_s_{out}"] = F.sum(expr)
    for out, src in last.items():
        carried[f"_l_{out}"] = F.max_by(F.col(src), F.when(F.col(src).isNotNull(), rank))
    for out, src in following.items():
        carried[f"_f_{out}"] = F.min_by(F.col(src), F.when(F.col(src).isNotNull(), rank))
    for out, src in lag.items():
        carried[f"_g_{out}"] = F.max_by(F.struct(F.col(src).alias("v")), rank)
    per_chunk = rows_df.groupBy(*keys).agg(*[e.alias(c) for c, e in carried.items()])

    # at most ``chunks`` rows per group from here on
    across = Window.partitionBy(*part).orderBy("_chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*part).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = {"_c_n": F.coalesce(F.sum("_n").over(before), F.lit(0))}
    for out in sums:
        carry[f"_c_s_{out}"] = F.sum(f"_s_{out}").over(before)
    for out in last:
        carry[f"_c_l_{out}"] = F.last(f"_l_{out}", ignorenulls=True).over(before)
    for out in following:
        carry[f"_c_f_{out}"] = F.last(f"_f_{out}", ignorenulls=True).over(after)
    for out in lag:
        carry[f"_c_g_{out}"] = F.last(f"_g_{out}").over(before)
    carry_df = per_chunk.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[e.alias(c) for c, e in carry.items()]
    )
    local = rows_df.withColumns(_local(keys, order, sums, last, following, lag, "_rn", prefix="_o_"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(carry_df, on, "left")
    out_cols = [F.col(c) for c in df.columns]
    for out in sums:
        both = F.col(f"_o_{out}").isNull() & F.col(f"_c_s_{out}").isNull()
        total = F.coalesce(F.col(f"_o_{out}"), F.lit(0)) + F.coalesce(F.col(f"_c_s_{out}"), F.lit(0))
        out_cols.append(F.when(~both, total).alias(out))
    for out in last:
        out_cols.append(F.coalesce(f"_o_{out}", f"_c_l_{out}").alias(out))
    for out in following:
        out_cols.append(F.coalesce(f"_o_{out}", f"_c_f_{out}").alias(out))
    for out in lag:
        out_cols.append(F.when(F.col("_o__rn") == 1, F.col(f"_c_g_{out}.v")).otherwise(F.col(f"_o_{out}")).alias(out))
    if number:
        out_cols.append((F.col("_o__rn") + F.col("_c_n")).cast("bigint").alias(number))
    return joined.select(*out_cols)


def _local(part, order, sums, last, following, lag, number, prefix="") -> dict[str, Column]:
    w = Window.partitionBy(*part).orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead is looking back in reverse: a frame that ends at the end of the partition is
    # recomputed for every row, one that starts at its beginning only grows
    back = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = {prefix + o: F.sum(e).over(up) for o, e in sums.items()}
    out |= {prefix + o: F.last(c, ignorenulls=True).over(up) for o, c in last.items()}
    out |= {prefix + o: F.last(c, ignorenulls=True).over(back) for o, c in following.items()}
    out |= {prefix + o: F.lag(c).over(w) for o, c in lag.items()}
    if number:
        out[prefix + number] = F.row_number().over(w).cast("bigint")
    return out


def ffill(df: DataFrame, cols: Sequence[str], order: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """Replace a null by the latest earlier value of its group."""
    filled = ordered_scan(df, order, part, last={f"_fill_{c}": c for c in cols})
    return _swap(filled, df.columns, cols)


def bfill(df: DataFrame, cols: Sequence[str], order: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """Replace a null by the next later value of its group."""
    filled = ordered_scan(df, order, part, following={f"_fill_{c}": c for c in cols})
    return _swap(filled, df.columns, cols)


def _swap(filled: DataFrame, columns: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return filled.select(*[F.col(f"_fill_{c}").alias(c) if c in cols else F.col(c) for c in columns])


def interpolate(df: DataFrame, cols: Sequence[str], order: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """Fill nulls on the straight line between the neighbours by row position; ends are held flat."""
    numbered = ordered_scan(df, order, part, number="_pos")
    for c in cols:
        seen = F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).cast("double").alias("v")))
        numbered = numbered.withColumn(f"_seen_{c}", seen)
    scanned = ordered_scan(
        numbered, ["_pos"], part,
        last={f"_prev_{c}": f"_seen_{c}" for c in cols},
        following={f"_next_{c}": f"_seen_{c}" for c in cols},
    )
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(F.col(c))
            continue
        lo, hi = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        share = (F.col("_pos") - lo["p"]) / (hi["p"] - lo["p"])
        line = lo["v"] + (hi["v"] - lo["v"]) * share
        value = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(lo.isNull(), hi["v"])
        out.append(value.when(hi.isNull(), lo["v"]).otherwise(line).alias(c))
    return scanned.select(*out)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row of every key; an aggregate, so partial results combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def gaps(df: DataFrame, ts: str, part: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Seconds between consecutive timestamps of a group, as column ``gap``."""
    timed = df.where(F.col(ts).isNotNull()).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    scanned = ordered_scan(timed, ["_us", *tie], part, lag={"_before": "_us"})
    return scanned.where(F.col("_before").isNotNull()).select(
        *part, ((F.col("_us") - F.col("_before")) / F.lit(1e6)).alias("gap")
    )


def _gap_mode(gap_df: DataFrame, part: Sequence[str]) -> DataFrame:
    best = F.max_by("gap", F.struct(F.col("n"), -F.col("gap"))).alias("interval")
    spread = [F.stddev_samp("gap").alias("gap_std"), F.count(F.lit(1)).alias("gaps")]
    counted = gap_df.groupBy(*part, "gap").agg(F.count(F.lit(1)).alias("n"))
    if part:
        return counted.groupBy(*part).agg(best).join(gap_df.groupBy(*part).agg(*spread), list(part))
    return beside(counted.agg(best), gap_df.agg(*spread))


def regular_series(df: DataFrame, ts: str, part: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Gap mode (seconds), gap deviation and whether the series is regular (deviation under 1 s)."""
    stats = _gap_mode(gaps(df, ts, part, tie), part)
    return stats.withColumn("is_regular", F.coalesce(F.col("gap_std") < 1.0, F.lit(False)))


def temporal_frequency(df: DataFrame, ts: str, part: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Name of the usual step between timestamps."""
    stats = _gap_mode(gaps(df, ts, part, tie), part)
    return stats.withColumn("frequency", frequency_label(F.col("interval")))


def frequency_label(seconds: Column) -> Column:
    """Ladder from a step in seconds to its name."""
    steps = {"second": 1, "minute": 60, "hour": 3600, "daily": 86400, "weekly": 7 * 86400, "monthly": 31 * 86400}
    out = None
    for name, bound in steps.items():
        out = F.when(seconds <= bound, name) if out is None else out.when(seconds <= bound, name)
    return out.otherwise("yearly")


def ema(df: DataFrame, value: str, alpha: float, order: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """Exponential moving average, seeded with the first value of the group, as column ``ema``.

    Rows are numbered and cut into blocks long enough that the weight of anything before the
    previous block is below double precision; a block is then a weighted prefix sum plus the end
    value of the block before it, so no task has to walk a whole group.
    """
    decay = 1.0 - alpha
    if decay == 0:  # nothing earlier counts
        return df.where(F.col(value).isNotNull()).withColumn("ema", F.col(value).cast("double"))
    block = max(8, math.ceil(math.log(1e-18) / math.log(decay)))
    part = list(part)
    rows = ordered_scan(df.where(F.col(value).isNotNull()), order, part, number="_n")
    rows = rows.withColumns({"_b": F.floor((F.col("_n") - 1) / block), "_j": (F.col("_n") - 1) % block})
    # the very first value carries full weight, every later one carries alpha
    weight = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    w = Window.partitionBy(*part, "_b").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    term = weight * F.col(value) * F.pow(F.lit(decay), -F.col("_j").cast("double"))
    rows = rows.withColumn("_e", F.sum(term).over(w) * F.pow(F.lit(decay), F.col("_j").cast("double")))
    ends = rows.where(F.col("_j") == block - 1).select(
        *[F.col(p).alias(f"_p_{p}") for p in part], (F.col("_b") + 1).alias("_pb"), F.col("_e").alias("_end")
    )
    on = F.col("_b") == F.col("_pb")
    for p in part:
        on = on & F.col(p).eqNullSafe(F.col(f"_p_{p}"))
    carried = F.coalesce(F.col("_end"), F.lit(0.0)) * F.pow(F.lit(decay), F.col("_j").cast("double") + 1)
    return rows.join(ends, on, "left").withColumn("ema", F.col("_e") + carried).select(*df.columns, "ema")
