"""Trailing distinct counts and quantiles from mergeable sketches per cell of time.

Points are summed up once, per cell and group, in sketches of bounded size; every trailing window is the merge of its cells.  So
state and work of the windows hang on the number of cells and not on the points, in batch and stream alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: size of the sketches: 2^LG_K registers (standard error 1.04 / 2^(LG_K / 2)), and K of the quantile sketch (rank error under 0.01)
LG_K, K = 12, 400
#: share by which an estimate may be off: three standard errors of the distinct count, and the rank of a quantile
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.02


def cells(points: DataFrame, step: str, by: Sequence[str] = (), user: str | None = None, value: str | None = None, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """One row per step of time and group: cell (its end), n, and sketches of ``user`` and of ``value``.

    With ``value`` also its sum, least, greatest and last.  Rows without time are left out.  On a stream the watermark, if given,
    lets finished cells go; without it (complete output) all cells stay.
    """
    timed = points.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull())
    if watermark:
        timed = timed.withWatermark(ts, watermark)
    made = [F.count(F.lit(1)).alias("n")]
    if user:
        made.append(F.hll_sketch_agg(F.col(user).cast("string"), LG_K).alias("users"))
    if value:
        v = F.col(value).cast("double")
        made += [F.kll_sketch_agg_double(v, K).alias("values"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.max(F.struct(ts, v.alias("value"))).alias("latest")]
    return timed.groupBy(F.window(ts, step).alias("w"), *by).agg(*made).withColumn("cell", F.col("w.end")).drop("w")


def trailing(made: DataFrame, size: str, step: str, by: Sequence[str] = (), ranks: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Windows of ``size`` that end at every ``step`` at which a cell is in reach: window_end, the groups, n and what the cells hold.

    ``users`` is the estimated number of distinct users, ``p50`` and the like the estimated quantiles.
    """
    ends = F.explode(F.sequence("cell", F.col("cell") + F.expr(f"interval {size}") - F.expr(f"interval {step}"), F.expr(f"interval {step}"))).alias("window_end")
    merged = [F.sum("n").alias("n")]
    out = [F.col("n")]
    if "users" in made.columns:
        merged.append(F.hll_union_agg("users").alias("users"))
        out.append(F.hll_sketch_estimate("users").alias("users"))
    if "values" in made.columns:
        merged += [F.kll_merge_agg_double("values", K).alias("values"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.max("latest").alias("latest")]
        out += [F.kll_sketch_get_quantile_double("values", F.lit(float(r))).alias(f"p{round(r * 100)}") for r in ranks]
        out += [F.col("total"), (F.col("total") / F.col("n")).alias("mean"), F.col("least"), F.col("greatest"), F.col("latest.value").alias("last")]
    return made.select("*", ends).groupBy("window_end", *by).agg(*merged).select("window_end", *by, *out)


def trailing_sizes(made: DataFrame, sizes: dict[str, str], by: Sequence[str] = (), **options) -> DataFrame:
    """``trailing`` for several {size: step}, with the column ``size``; the cells' step divides every step here."""
    parts = [trailing(coarser(made, step, by), size, step, by, **options).withColumn("size", F.lit(size)) for size, step in sizes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coarser(made: DataFrame, step: str, by: Sequence[str] = ()) -> DataFrame:
    """Cells of a longer step, merged from shorter ones."""
    merged = [F.sum("n").alias("n")]
    if "users" in made.columns:
        merged.append(F.hll_union_agg("users").alias("users"))
    if "values" in made.columns:
        merged += [F.kll_merge_agg_double("values", K).alias("values"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.max("latest").alias("latest")]
    before = F.col("cell") - F.expr("interval 1 microsecond")  # a cell's end belongs to the time before it
    return made.groupBy(F.window(before, step).alias("w"), *by).agg(*merged).withColumn("cell", F.col("w.end")).drop("w")
