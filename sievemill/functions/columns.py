"""Column-family helpers and small text / date / number expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null once, at the edge; every later operator then sees one kind of missing."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


# --- fixed values: patterns recognised in text -------------------------------------------------
EMAIL_IN_TEXT = r"[\w\.-]+@[\w\.-]+\.\w+"
URL_IN_TEXT = r"https?://|www\."
PHONE_IN_TEXT = r"\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}"
UUID_IN_TEXT = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
CAPITALISED_NAME = r"^[A-Z][a-z]+(\s[A-Z][a-z]+)*$"
EMAIL_WHOLE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE_WHOLE = r"^[\d\-()+\s]{7,}$"
# -----------------------------------------------------------------------------------------------

# --- fixed values: date formats and the shape of text each one reads ---------------------------
DATE_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "yyyy/MM/dd HH:mm:ss": r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$",
    "dd-MM-yyyy HH:mm:ss": r"^\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}$",
    "dd/MM/yyyy HH:mm:ss": r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ssX": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2})$",
    "yyyy-MM-dd HH:mm:ss.SSSSSS": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}$",
}
MONTH_FIRST = {"MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$", "MM-dd-yyyy": r"^\d{2}-\d{2}-\d{4}$"}
# -----------------------------------------------------------------------------------------------


def parse_date(text: Column, formats: Mapping[str, str] = DATE_FORMATS) -> Column:
    """Timestamp in text, null when no format reads it.

    The shape of the text picks the one format to try, so a value that is no date costs a few
    regex tests and no failed parse.
    """
    plain = F.trim(text)
    maybe = plain.rlike(r"^\d{2,4}[-/]\d{2}[-/]\d{2,4}")
    out = None
    for fmt, shape in formats.items():
        read = F.try_to_timestamp(plain, F.lit(fmt))
        out = F.when(plain.rlike(shape), read) if out is None else out.when(plain.rlike(shape), read)
    return F.when(maybe, out)


def parse_number(text: Column) -> Column:
    """Number in text, null when it is none (NaN and infinity words are not numbers)."""
    plain = F.trim(text.cast("string"))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def parse_bool(text: Column) -> Column:
    """true / 1 / yes, any case."""
    return F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes")


def snake_case(name: str) -> str:
    """Lower case, punctuation dropped, runs of blanks to one underscore."""
    return re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", name.lower().strip()))


def mask_middle(text: Column) -> Column:
    """First and last four characters kept, the rest starred."""
    stars = F.repeat(F.lit("*"), F.length(text) - 8)
    return F.concat(F.substring(text, 1, 4), stars, F.right(text, F.lit(4)))


def short_hash(value: Column) -> Column:
    """First eight hex digits of sha-256; null stays null."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, 8)


def linear_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Right-closed equal-width bin number from 0; the lowest value belongs to bin 0."""
    if high == low:
        return F.when(value.isNotNull(), F.lit(0))
    width = (high - low) / bins
    raw = F.ceil((value - F.lit(float(low))) / F.lit(width)) - 1
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def cut_labels(value: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed labelled bins; values outside the edges give null."""
    out = F.when(value < F.lit(float(edges[0])), F.lit(None))
    for edge, label in zip(edges[1:], labels):
        out = out.when(value <= F.lit(float(edge)), F.lit(label))
    return out


def clip(value: Column, low, high) -> Column:
    """Value held inside [low, high]; null stays null."""
    held = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), held)


def stack_rows(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One output row per struct expression of a (usually one-row) table."""
    return df.select(F.inline(F.array(*structs)))


def common_prefix(low: Column, high: Column) -> Column:
    """Common prefix of a set of strings, given its smallest and largest member."""
    lengths = F.sequence(F.lit(0), F.least(F.length(low), F.length(high)))
    return F.element_at(
        F.transform(
            F.filter(lengths, lambda n: F.substring(low, 1, n) == F.substring(high, 1, n)),
            lambda n: F.substring(low, 1, n),
        ),
        -1,
    )


def with_readings(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Add, per text column, its reading as a number (``_num_i``) and as a timestamp (``_date_i``).

    Aggregates over these columns read every value once, however many tests use it.
    """
    plan = {}
    for i, c in enumerate(texts):
        plan |= {f"_num_{i}": parse_number(F.col(c)), f"_date_{i}": parse_date(F.col(c))}
    return df.withColumns(plan) if plan else df


def beside(*one_row: DataFrame) -> DataFrame:
    """The columns of several one-row tables in one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
