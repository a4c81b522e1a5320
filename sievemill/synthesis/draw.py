"""Draws bound to a seed and a row key, and the small vocabularies text is made of."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import rng
from sievemill.functions.columns import clip
from sievemill.operators.clean import uuid_text

# --- fixed values: vocabularies ----------------------------------------------------------------
FIRST_NAMES = ["Amy", "Ben", "Cara", "Dan", "Eva", "Finn", "Gina", "Hugo", "Iris", "Jack", "Kira", "Liam", "Mona", "Nils", "Olga", "Paul", "Rosa", "Sam", "Tara", "Yara"]
LAST_NAMES = ["Adler", "Baker", "Castro", "Dunn", "Evans", "Fox", "Grant", "Hayes", "Ivers", "Jones", "Klein", "Lopez", "Meyer", "Novak", "Ortiz", "Price", "Quinn", "Reed", "Stone", "Wolf"]
STREETS = ["Main St", "Oak Ave", "Park Rd", "Hill Ln", "Lake Dr", "Mill St", "Pine Ave", "River Rd"]
CITIES = ["Springfield", "Riverton", "Lakeside", "Fairview", "Georgetown", "Milford", "Ashland", "Clinton"]
STATES = ["AL", "CA", "CO", "FL", "GA", "IL", "NY", "OH", "TX", "WA"]
COUNTRIES = ["Austria", "Brazil", "Canada", "Denmark", "Egypt", "France", "Ghana", "India", "Japan", "Kenya"]
WORDS = ["anchor", "basket", "candle", "desert", "ember", "forest", "garden", "harbor", "island", "jacket", "kernel", "ladder", "meadow", "needle", "orchid", "pepper", "quartz", "ribbon", "saddle", "timber"]
DOMAINS = ["example.com", "example.org", "example.net"]
COMPANY_ENDS = ["Inc", "LLC", "Group", "Partners"]
# -----------------------------------------------------------------------------------------------


def rows(spark: SparkSession, n: int, key: str = "_id") -> DataFrame:
    """``n`` row keys from 0, spread over the cluster."""
    return spark.range(n).withColumnRenamed("id", key)


@dataclass(frozen=True)
class Draw:
    """All draws of one generated table."""

    seed: int
    key: Column

    def uniform(self, name: str) -> Column:
        return rng.uniform(self.seed, name, self.key)

    def integer(self, name: str, low: int, high: int) -> Column:
        return rng.integer(self.seed, name, self.key, low, high)

    def real(self, name: str, low: float, high: float, digits: int | None = None) -> Column:
        x = rng.real(self.seed, name, self.key, low, high)
        return x if digits is None else F.round(x, digits)

    def normal(self, name: str, mean: float = 0.0, std: float = 1.0, low=None, high=None) -> Column:
        x = rng.normal(self.seed, name, self.key, mean, std)
        if low is None and high is None:
            return x
        return clip(x, float("-inf") if low is None else float(low), float("inf") if high is None else float(high))

    def exponential(self, name: str, scale: float) -> Column:
        return rng.exponential(self.seed, name, self.key, scale)

    def lognormal(self, name: str, mu: float, sigma: float) -> Column:
        return rng.lognormal(self.seed, name, self.key, mu, sigma)

    def pareto(self, name: str, shape: float) -> Column:
        return rng.pareto(self.seed, name, self.key, shape)

    def geometric(self, name: str, p: float) -> Column:
        return rng.geometric(self.seed, name, self.key, p)

    def beta(self, name: str, a: int, b: int) -> Column:
        """Beta with whole parameters: the a-th smallest of a + b - 1 uniforms."""
        draws = F.array(*[self.uniform(f"{name}#{i}") for i in range(a + b - 1)])
        return F.element_at(F.array_sort(draws), a)

    def choice(self, name: str, values: Sequence) -> Column:
        return rng.choice(self.seed, name, self.key, list(values))

    def weighted(self, name: str, weights: dict) -> Column:
        return rng.weighted(self.seed, name, self.key, weights)

    def chance(self, name: str, p: float) -> Column:
        return self.uniform(name) < F.lit(float(p))

    def hex(self, name: str) -> Column:
        """32 hex digits."""
        return F.md5(F.concat(F.lit(f"{self.seed}:{name}:"), self.key.cast("string")))

    def code(self, name: str, prefix: str, digits: int) -> Column:
        """Prefix and upper-case hex digits."""
        return F.concat(F.lit(prefix), F.upper(F.substring(self.hex(name), 1, digits)))

    def digits(self, name: str, n: int) -> Column:
        """``n`` decimal digits (at most 15 per draw, so longer runs take several)."""
        parts = []
        for i in range(0, n, 12):
            k = min(12, n - i)
            parts.append(F.lpad(F.floor(self.uniform(f"{name}#{i}") * F.lit(float(10**k))).cast("bigint").cast("string"), k, "0"))
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def uuid(self, name: str) -> Column:
        return uuid_text(self.hex(name))

    def first_name(self, name: str) -> Column:
        return self.choice(f"{name}.first", FIRST_NAMES)

    def last_name(self, name: str) -> Column:
        return self.choice(f"{name}.last", LAST_NAMES)

    def full_name(self, name: str) -> Column:
        return F.concat_ws(" ", self.first_name(name), self.last_name(name))

    def email(self, name: str, unique: bool = False) -> Column:
        """Address; the row key makes it unique."""
        tail = self.key.cast("string") if unique else self.integer(f"{name}.n", 1, 999).cast("string")
        return F.concat(F.lower(self.first_name(name)), F.lit("."), F.lower(self.last_name(name)), tail, F.lit("@"), self.choice(f"{name}.dom", DOMAINS))

    def url(self, name: str) -> Column:
        return F.concat(F.lit("https://www."), self.choice(f"{name}.dom", DOMAINS), F.lit("/"), self.word(f"{name}.path"))

    def phone(self, name: str) -> Column:
        return F.concat(F.lit("555-"), self.digits(f"{name}.a", 3), F.lit("-"), self.digits(f"{name}.b", 4))

    def city(self, name: str) -> Column:
        return self.choice(f"{name}.city", CITIES)

    def city_state(self, name: str) -> Column:
        return F.concat_ws(", ", self.city(name), self.choice(f"{name}.state", STATES))

    def address(self, name: str) -> Column:
        number = self.integer(f"{name}.no", 1, 999).cast("string")
        return F.concat(number, F.lit(" "), self.choice(f"{name}.street", STREETS), F.lit(", "), self.city_state(name), F.lit(" "), self.digits(f"{name}.zip", 5))

    def company(self, name: str) -> Column:
        return F.concat_ws(" ", self.last_name(name), self.choice(f"{name}.end", COMPANY_ENDS))

    def word(self, name: str) -> Column:
        return self.choice(f"{name}.word", WORDS)

    def sentence(self, name: str, words: int = 10) -> Column:
        picked = [self.word(f"{name}.{i}") for i in range(words)]
        return F.concat(F.initcap(picked[0]), F.lit(" "), F.concat_ws(" ", *picked[1:]), F.lit("."))

    def date(self, name: str, start: str, end: str) -> Column:
        """Day in [start, end]."""
        first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
        return F.date_add(first, F.floor(self.uniform(name) * (F.datediff(last, first) + 1)).cast("int"))

    def moment(self, name: str, start: str, end: str) -> Column:
        """Timestamp in [start, end), to the second."""
        lo, hi = (F.unix_timestamp(F.lit(x).cast("timestamp")) for x in (start, end))
        return F.timestamp_seconds(lo + F.floor(self.uniform(name) * (hi - lo)))


def normal_cdf(z: Column) -> Column:
    """Normal distribution function (Abramowitz and Stegun 26.2.17, error below 7.5e-8)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(z) * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)
