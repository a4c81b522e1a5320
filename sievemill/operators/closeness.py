"""Ordered distance of numeric sensitive values: how far each class's distribution lies from the table's."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.operators.ordered import ordered_scan
from sievemill.session import stored


def _same(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in cols])


def ordered_distances(df: DataFrame, qi: Sequence[str], sensitive: str) -> DataFrame:
    """One row per class: the columns ``qi`` as ``_q_...`` and its ordered distance ``_t`` (0 to 1) from the table.

    With the table's m distinct values in order, the distance is the sum of ``|P_i - Q_i|`` over the first i values,
    divided by m - 1, where P and Q are the cumulative shares of the class and the table (0 if m is 1).  A class is
    never crossed with all m values.  Between two neighbouring values of its own P is constant and Q rises, so Q passes P
    once: the part below and the part above are differences of prefix sums of Q.  The place where Q passes comes from
    one scan of the table's and the classes' shares in a common order.

    Rows with a null or NaN value take no part; a class of such rows only has a null distance.
    """
    qi = list(qi)
    # -0.0 and 0.0 are one value
    number = F.col(sensitive).cast("double") + F.lit(0.0)
    known = df.select(*[F.col(c).alias(f"_q_{c}") for c in qi], F.when(~F.isnan(number), number).alias("_v"))
    keys = [f"_q_{c}" for c in qi]
    cells = stored(known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    held = cells.where(F.col("_v").isNotNull())

    values = held.groupBy("_v").agg(F.sum("_n").alias("_g"))
    # rank, cumulative count, and the sum of the cumulative counts
    values = ordered_scan(values, ["_v"], sums={"_cum": F.col("_g")}, number="_rank")
    values = stored(ordered_scan(values.select("_v", "_rank", F.col("_cum").cast("decimal(38,0)").alias("_cum")), ["_v"], sums={"_all": F.col("_cum")}))
    ends = values.agg(F.max("_rank").alias("m"), F.max("_cum").alias("n"), F.max("_all").alias("s")).first()
    classes = cells.select(*keys).distinct()
    if ends["m"] is None or ends["m"] == 1:
        distance = F.lit(None).cast("double") if ends["m"] is None else F.max(F.when(F.col("_v").isNotNull(), F.lit(0.0)))
        return cells.groupBy(*keys).agg(distance.alias("_t")) if ends["m"] else classes.withColumn("_t", distance)
    m, total, everything = int(ends["m"]), float(ends["n"]), ends["s"]

    sizes = stored(held.groupBy(*[F.col(k).alias(f"_c{k}") for k in keys]).agg(F.sum("_n").alias("_size")))
    own = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in keys])
    before = values.select(F.col("_v").alias("_w"), "_rank", (F.col("_all") - F.col("_cum")).cast("decimal(38,0)").alias("_sum"))
    points = held.join(before, F.col("_v") == F.col("_w")).drop("_w")
    points = ordered_scan(points, ["_v"], keys, sums={"_upto": F.col("_n")}, lag={"_from": "_rank", "_low": "_sum"})
    points = points.join(sizes, own).select(
        *keys, "_rank", "_sum", F.coalesce("_from", F.lit(1)).alias("_from"), F.coalesce("_low", F.lit(0)).cast("decimal(38,0)").alias("_low"),
        ((F.col("_upto") - F.col("_n")) / F.col("_size")).alias("_share"), F.lit(1).alias("_kind"),
    )
    curve = values.select((F.col("_cum").cast("double") / F.lit(total)).alias("_share"), F.lit(0).alias("_kind"), F.col("_rank").alias("_x"), F.col("_all").cast("decimal(38,0)").alias("_s"))
    met = ordered_scan(points.unionByName(curve, allowMissingColumns=True), ["_share", "_kind"], last={"_at": "_x", "_below": "_s"}).where("_kind = 1")

    # ranks _from to _rank - 1 hold the share of the values before; up to _at the table's share is not above it
    first, stop = F.col("_from"), F.col("_rank") - 1
    at = F.coalesce("_at", F.lit(0))
    turn = F.greatest(F.least(at, stop), first - 1)
    split = F.when(at < first, F.col("_low")).when(at >= stop, F.col("_sum")).otherwise(F.col("_below"))
    under = F.col("_share") * (turn - first + 1) - (split - F.col("_low")).cast("double") / total
    over = (F.col("_sum") - split).cast("double") / total - F.col("_share") * (stop - turn)
    rest = F.lit(m) - F.max("_rank") + 1 - (F.lit(everything).cast("decimal(38,0)") - F.max("_sum")).cast("double") / total
    near = met.groupBy(*[F.col(k).alias(f"_c{k}") for k in keys]).agg(((F.sum(under + over) + rest) / (m - 1)).alias("_t"))
    return classes.join(near, own, "left").select(*keys, "_t")


def t_close_ordered(df: DataFrame, qi: Sequence[str], sensitive: str, t: float) -> DataFrame:
    """Rows of classes whose numeric sensitive values are within ordered distance ``t`` of the table's.

    Classes without any value have no distance and go.
    """
    near = stored(ordered_distances(df, qi, sensitive).where(F.col("_t") <= t))
    return df.join(near, _same(qi), "left_semi")
