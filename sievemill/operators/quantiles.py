"""Exact quantiles without a sort and without an unbounded buffer.

Spark's ``percentile`` keeps one entry per distinct value, so it is used only for columns whose
distinct count is within the limit.  Other columns are narrowed by counting: a pass counts rows in
equal-width bins of the current bracket, keeps the bin that holds the wanted rank, and repeats
until the bracket is small.  Every pass is one scan with a partial aggregate for all such columns; no rows are moved.
Results follow the linear interpolation between order statistics.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.operators.ordered import ordered_scan
from sievemill.session import limit

_BINS = 512


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of each column as a small driver-side dictionary (columns x probs values)."""
    cols = list(cols)
    if not cols:
        return {}
    spark = df.sparkSession
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    sizes = typed.agg(
        *[F.approx_count_distinct(c, 0.05).alias(f"d{i}") for i, c in enumerate(cols)],
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
    ).first()
    bound = limit(spark, "sievemill.percentileValues")
    light = [c for i, c in enumerate(cols) if sizes[f"d{i}"] * 1.2 <= bound]
    out: dict[str, list[float | None]] = {}
    if light:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        row = typed.agg(*[F.percentile(c, wanted).alias(f"q{i}") for i, c in enumerate(light)]).first()
        for i, c in enumerate(light):
            out[c] = list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
    heavy = [i for i, c in enumerate(cols) if c not in out]
    if heavy:
        out |= _by_counting(typed, {cols[i]: sizes[f"n{i}"] for i in heavy}, probs, bound)
    return out


def _ranks(n: int, probs: Sequence[float]) -> list[int]:
    return sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})


def _by_counting(typed: DataFrame, sizes: Mapping[str, int], probs: Sequence[float], bound: int) -> dict[str, list[float]]:
    """Quantiles of all the columns in ``sizes`` (column -> values) at once: each pass reads the table once, however many are open.

    Order as Spark's: minus infinity, numbers, infinity, NaN.  Only the numbers are narrowed.  The driver sees at most
    columns x ranks x bins counts a pass, and at the end one value per column and rank.
    """
    cols, inf = list(sizes), float("inf")
    facts = []
    for i, c in enumerate(cols):
        number = F.when(~F.isnan(c) & (F.abs(c) < F.lit(inf)), F.col(c))
        facts += [
            F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.count_if(F.col(c) == F.lit(-inf)).alias(f"under{i}"),
            F.count_if(F.col(c) == F.lit(inf)).alias(f"over{i}"), F.count_if(F.isnan(c)).alias(f"nan{i}"),
        ]
    ends = typed.agg(*facts).first()
    found: dict[str, dict[int, float]] = {}
    # (column, lowest, highest value) -> (rows below it, ranks wanted in it)
    open_brackets: dict[tuple[str, float, float], tuple[int, list[int]]] = {}
    small: dict[tuple[str, float, float], tuple[int, list[int]]] = {}
    for i, (c, n) in enumerate(sizes.items()):
        first, above = ends[f"under{i}"], n - ends[f"nan{i}"]
        last = above - ends[f"over{i}"]
        ranks = _ranks(n, probs)
        found[c] = {r: -inf if r < first else inf if r < above else float("nan") for r in ranks if not first <= r < last}
        if inside := [r for r in ranks if first <= r < last]:
            open_brackets[(c, ends[f"lo{i}"], ends[f"hi{i}"])] = (first, inside)
    few = min(bound, 10_000)
    while open_brackets:
        brackets = list(open_brackets)
        below = [base for base, _ in open_brackets.values()]
        counted = (
            _in_brackets(typed, brackets).groupBy("t", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()
        )
        after: dict[tuple[str, float, float], tuple[int, list[int]]] = {}
        for row in sorted(counted, key=lambda r: (r["t"], r["lo"])):
            base = below[row["t"]]
            below[row["t"]] += row["n"]
            c = brackets[row["t"]][0]
            here = [r for r in open_brackets[brackets[row["t"]]][1] if base <= r < base + row["n"]]
            if not here:
                continue
            if row["lo"] == row["hi"]:
                found[c].update({r: row["lo"] for r in here})
            else:
                (small if row["n"] <= few else after)[(c, row["lo"], row["hi"])] = (base, here)
        open_brackets = after
    if small:
        _pick(typed, small, found)
    return {c: [_between(found[c], p * (n - 1)) for p in probs] for c, n in sizes.items()}


def _in_brackets(typed: DataFrame, brackets: Sequence[tuple[str, float, float]]) -> DataFrame:
    """(t, v, b): values that lie in a bracket, its place in the list and the bin inside it; brackets of a column do not overlap."""
    mine: dict[str, list[int]] = {}
    for t, (c, _, _) in enumerate(brackets):
        mine.setdefault(c, []).append(t)
    cells = []
    for c, places in mine.items():
        tag, low, width = F, F, F  # each grows into a chain of conditions
        for t in places:
            _, a, b = brackets[t]
            test = F.col(c).between(F.lit(a), F.lit(b))
            tag, low = tag.when(test, F.lit(t)), low.when(test, F.lit(a))
            width = width.when(test, F.lit(max(b / _BINS - a / _BINS, 5e-324)))
        cells.append(F.struct(tag.alias("t"), F.col(c).alias("v"), F.floor((F.col(c) - low) / width).alias("b")))
    return typed.select(F.inline(F.array(*cells))).where(F.col("t").isNotNull())


def _pick(typed: DataFrame, small: Mapping[tuple[str, float, float], tuple[int, list[int]]], found: dict[str, dict[int, float]]) -> None:
    """The wanted values of brackets that hold few rows, into ``found``; rows are sorted where they are gathered."""
    brackets = list(small)
    wanted = [(t, [r - base + 1 for r in here]) for t, (base, here) in enumerate(small.values())]
    places = F.broadcast(typed.sparkSession.createDataFrame(wanted, "t int, places array<int>"))  # columns x ranks rows at most
    gathered = _in_brackets(typed, brackets).groupBy("t").agg(F.array_sort(F.collect_list("v")).alias("x"))
    for row in gathered.join(places, "t").select("t", F.transform("places", lambda i: F.element_at("x", i)).alias("q")).collect():
        found[brackets[row["t"]][0]].update(zip(small[brackets[row["t"]]][1], row["q"]))


def _between(found: Mapping[int, float], at: float) -> float:
    a, b, share = found[math.floor(at)], found[math.ceil(at)], at - math.floor(at)
    if a == b or share == 0:
        return a
    return a + (b - a) * share if math.isfinite(b - a) else (1 - share) * a + share * b


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles per group: ``keys`` plus one column per entry of ``probs``.

    Values are counted per (group, value) first.  A group with few distinct values is finished by
    a weighted ``percentile``; if any group has more than the limit, ranks come from a running sum
    of the counts, which ``ordered_scan`` splits over many tasks.
    """
    keys = list(keys)
    spark = df.sparkSession
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    widest = counted.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if widest <= limit(spark, "sievemill.percentileValues"):
        return counted.groupBy(*keys).agg(
            *[F.percentile("_v", F.lit(float(p)), F.col("_n")).alias(name) for name, p in probs.items()]
        )
    totals = counted.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.sum("_n").alias("_all"))
    running = ordered_scan(counted, ["_v"], keys, sums={"_cum": F.col("_n")})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    ranked = running.join(totals, on)
    aggs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_all") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum"))
            aggs.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{side}_{name}"))
    picked = ranked.groupBy(*keys).agg(F.max("_all").alias("_all"), *aggs)
    cols = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_all") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, *cols)
