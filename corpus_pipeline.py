"""The corpus pipeline: documents that two quality stages keep, one of each group of near copies, without repeated
passages, packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept.  The classifier and the rules learn
from the labelled rows of the whole tables in ``sf_dir``, never from what earlier stages have left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import chunks, packing, quality, rules, simhash
from sievemill.llm.common import prepare_texts, stored


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prepare_texts(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality.keep_good(docs, quality.train(*_labelled(spark, sf_dir)))


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return rules.keep_passing(docs, rules.train(*_labelled(spark, sf_dir)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    prepare_texts(spark)
    return simhash.one_per_group(docs, shingle=3, distance=2)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document of a smaller id has; ``n_chars`` follows the text."""
    prepare_texts(spark)
    cut = chunks.drop_repeats(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed: one row per piece."""
    prepare_texts(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", judge),
    ("simhash near-dedup", near_copies),
    ("substring dedup", passages),
    ("best-fit packing", pack),
]

#: no stage but the last can be said in SQL, so tests hold each against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents in ``sf_dir``; each result is written and read again."""
    docs = prepare_texts(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
