"""Reading, writing, previewing and checking tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: keys under which a JSON object may hold its records ----------------------------
RECORD_KEYS = ("data", "records", "items", "results")
# -----------------------------------------------------------------------------------------------

_CORRUPT = "_corrupt_record"


def text_encoding(spark: SparkSession, path: str) -> str:
    """utf-8 when the whole file reads as such, else latin-1."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
    return "UTF-8" if broken.isEmpty() else "ISO-8859-1"


def read_table(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None, encoding: str | None = None,
    records_key: str | None = None, **options,
) -> DataFrame:
    """CSV (with header), JSON documents, JSON lines, parquet or ORC.

    A JSON document may be an array of records, one record, or an object with the records under a
    well-known key.  Without a schema text formats are inferred, which costs a pass.
    """
    if fmt == "csv":
        reader = spark.read.option("header", True).option("encoding", encoding or text_encoding(spark, path)).options(**options)
        return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    if fmt in ("json", "jsonl"):
        reader = spark.read.option("multiLine", fmt == "json").options(**options)
        df = reader.schema(schema).json(path) if schema is not None else reader.json(path)
        return _records(df, records_key) if fmt == "json" else df
    if fmt in ("parquet", "orc"):
        reader = spark.read.format(fmt).options(**options)
        return (reader.schema(schema) if schema is not None else reader).load(path)
    raise ValueError(f"unknown format {fmt}")


def _records(df: DataFrame, key: str | None) -> DataFrame:
    for name in [key] if key else RECORD_KEYS:
        if name in df.columns:
            kind = df.schema[name].dataType
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                return df.select(F.inline(name))
    if key:
        raise ValueError(f"no array of records under {key}")
    return df


def sniff_csv(spark: SparkSession, path: str) -> dict:
    """Delimiter and header of a CSV file, judged by its first 100 lines."""
    lines = [r["value"] for r in spark.read.text(path).limit(100).collect() if r["value"].strip()]
    if not lines:
        return {"sep": ",", "header": False, "columns": []}
    best = max(",;\t", key=lambda d: (_steady(lines, d), -",;\t".index(d)))
    first = _cells(lines[0], best)
    header = any(_wordy(c) for c in first)
    names = [c or f"Column{i + 1}" for i, c in enumerate(first)] if header else [f"Column{i + 1}" for i in range(len(first))]
    return {"sep": best, "header": header, "columns": names}


def _cells(line: str, sep: str) -> list[str]:
    out, cell, quoted = [], "", False
    i = 0
    while i < len(line):
        ch = line[i]
        if ch == '"':
            if quoted and line[i + 1:i + 2] == '"':
                cell += '"'
                i += 1
            else:
                quoted = not quoted
        elif ch == sep and not quoted:
            out.append(cell.strip())
            cell = ""
        else:
            cell += ch
        i += 1
    return [*out, cell.strip()]


def _steady(lines: list[str], sep: str) -> int:
    """Cells beyond the first when all lines agree on their number, else a weak vote."""
    widths = [len(_cells(x, sep)) for x in lines]
    return (widths[0] - 1) * 1000 if len(set(widths)) == 1 else min(widths) - 1


def _wordy(cell: str) -> bool:
    try:
        float(cell)
        number = True
    except ValueError:
        number = False
    letters = sum(ch.isalpha() for ch in cell)
    return not number or len(cell) > 20 or letters >= 2


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """CSV read with the sniffed dialect."""
    found = sniff_csv(spark, path)
    df = spark.read.options(sep=found["sep"], header=found["header"], inferSchema=True, quote='"', escape='"').csv(path)
    return df if found["header"] else df.toDF(*found["columns"])


def write_table(df: DataFrame, path: str, fmt: str, drop_internal: bool = True, mode: str = "error", partition_by: str | None = None) -> None:
    """Write csv, json, parquet or text.  Columns that start with ``_`` are dropped first."""
    if drop_internal:
        df = df.drop(*[c for c in df.columns if c.startswith("_")])
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    elif fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.format(fmt).save(path)


def write_tables(tables: Mapping[str, DataFrame], path: str, fmt: str, mode: str = "error") -> None:
    """One folder per table."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", fmt, mode=mode)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """First rows."""
    return df.limit(n)


def table_metadata(df: DataFrame) -> DataFrame:
    """row_count, column_count and the columns with their types, one row per column."""
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype")) for c, t in df.dtypes])
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select("row_count", F.lit(len(df.columns)).alias("column_count"), F.explode(listed).alias("x")).select("row_count", "column_count", "x.*")


def validate_source(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """One row: rows, broken rows, columns, headers, valid.  Broken rows are those the reader could
    not fit to the inferred schema."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            "rows", F.lit(0).cast("bigint").alias("broken"), F.lit(len(df.columns)).alias("columns"),
            F.lit(",".join(df.columns)).alias("headers"), F.lit(True).alias("valid"))
    if fmt == "csv":
        base = spark.read.option("header", True)
        inferred = base.option("inferSchema", True).csv(path).schema
        reader = base.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
        df = reader.schema(T.StructType([*inferred.fields, T.StructField(_CORRUPT, T.StringType())])).csv(path)
        names = list(inferred.names)
    else:
        plain = spark.read.option("multiLine", fmt == "json").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
        inferred = plain.json(path).schema
        names = [n for n in inferred.names if n != _CORRUPT]
        full = T.StructType([f for f in inferred.fields if f.name != _CORRUPT]).add(_CORRUPT, T.StringType())
        df = plain.schema(full).json(path)
    # the mark reads every column of every row, so that no column pruning hides a broken one
    mark = F.xxhash64(*[F.col(f"`{n}`") for n in names]) if names else F.length(_CORRUPT)
    counted = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(_CORRUPT).isNotNull()).alias("broken"), F.max(mark).alias("mark"))
    readable = (F.col("mark").isNotNull() | (F.col("rows") == 0)) & F.lit(len(names) > 0)
    return counted.select("rows", "broken", F.lit(len(names)).alias("columns"), F.lit(",".join(names)).alias("headers"),
                          ((F.col("broken") == 0) & readable).alias("valid"))
