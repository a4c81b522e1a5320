"""Reproducible random draws.

A draw depends only on (seed, stream name, row key), never on partitioning, task or retry, so a
recomputed partition after an executor loss returns the same values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits = 52 bits, which a double holds exactly
_SPAN = float(16**13)


def _col(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def bits(seed: int, stream: str, key) -> Column:
    """Integer in [0, 2**52) from md5 of ``seed:stream:key``."""
    text = F.concat(F.lit(f"{seed}:{stream}:"), _col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int, stream: str, key) -> Column:
    """Uniform double in [0, 1)."""
    return bits(seed, stream, key) / F.lit(_SPAN)


def uniform_open(seed: int, stream: str, key) -> Column:
    """Uniform double strictly inside (0, 1)."""
    return (bits(seed, stream, key) + F.lit(0.5)) / F.lit(_SPAN)


def integer(seed: int, stream: str, key, low: int, high: int) -> Column:
    """Whole number in [low, high], both ends included."""
    return (F.lit(low) + F.floor(uniform(seed, stream, key) * F.lit(high - low + 1))).cast("bigint")


def real(seed: int, stream: str, key, low: float, high: float) -> Column:
    """Uniform double in [low, high)."""
    return F.lit(float(low)) + uniform(seed, stream, key) * F.lit(float(high - low))


def normal(seed: int, stream: str, key, mean: float = 0.0, std: float = 1.0) -> Column:
    """Normal draw by the Box-Muller transform of two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform_open(seed, stream + "#r", key)))
    angle = F.lit(2.0 * math.pi) * uniform(seed, stream + "#a", key)
    return F.lit(float(mean)) + F.lit(float(std)) * radius * F.cos(angle)


def exponential(seed: int, stream: str, key, scale: float) -> Column:
    """Exponential draw by inverse distribution function."""
    return F.lit(-float(scale)) * F.log(uniform_open(seed, stream, key))


def lognormal(seed: int, stream: str, key, mu: float, sigma: float) -> Column:
    """exp of a normal draw."""
    return F.exp(normal(seed, stream, key, mu, sigma))


def pareto(seed: int, stream: str, key, shape: float) -> Column:
    """Pareto II (Lomax) draw with unit scale: ``(1-u)**(-1/shape) - 1``."""
    return F.pow(F.lit(1.0) - uniform(seed, stream, key), F.lit(-1.0 / shape)) - F.lit(1.0)


def geometric(seed: int, stream: str, key, p: float) -> Column:
    """Number of trials to the first success, from 1."""
    draw = F.ceil(F.log(uniform_open(seed, stream, key)) / F.lit(math.log(1.0 - p)))
    return F.greatest(draw, F.lit(1)).cast("bigint")


def choice(seed: int, stream: str, key, values: list) -> Column:
    """One of ``values`` with equal weight."""
    index = F.floor(uniform(seed, stream, key) * F.lit(len(values))).cast("int")
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def weighted(seed: int, stream: str, key, weights: dict) -> Column:
    """One key of ``weights`` with probability proportional to its weight."""
    total = float(sum(weights.values()))
    draw = uniform(seed, stream, key)
    out, acc = None, 0.0
    items = list(weights.items())
    for value, weight in items[:-1]:
        acc += weight / total
        test = draw < F.lit(acc)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    last = F.lit(items[-1][0])
    return last if out is None else out.otherwise(last)
