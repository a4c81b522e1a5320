"""Named queries of this subpackage, over whole tables with production parameters, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievemill.llm import bpe, chat, chunks, embeddings, infill, langid, packing, pages, quality, repair, rules, sharding, simhash
from sievemill.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def query(name: str, *tables: str, sql: str | None = None):
    """Register ``fn(*tables)`` under ``name``."""

    def keep(fn):
        QUERIES[name] = lambda spark, folder: fn(*[_table(spark, folder, t) for t in tables])
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op1_html_extraction", "pages")
def _op1(web_pages):
    return pages.extract(web_pages)


@query("op2_chat_formatting", "conversations")
def _op2(conversations):
    return chat.format_chats(conversations)


@query("op3_simhash_dedup", "documents")
def _op3(documents):
    return simhash.near_duplicates(documents)


@query("op4_language_id", "documents")
def _op4(documents):
    return langid.predict(documents, langid.train(documents))


@query("op5_quality_classifier", "documents", "labels")
def _op5(documents, labels):
    return quality.score_documents(documents, labels)


@query("op6_packing", "documents")
def _op6(documents):
    return packing.pack_documents(documents)


@query("op7_quality_rules", "documents", "labels")
def _op7(documents, labels):
    return rules.judge_documents(documents, labels)


@query("op8_embedding_dedup", "embeddings", sql="""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least_reached AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(r.b, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(r.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least_reached r ON r.a = e.vec_id""")
def _op8(vectors):
    return embeddings.near_vectors(vectors)


@query("op9_substring_dedup", "documents")
def _op9(documents):
    return chunks.drop_repeats(documents.select("doc_id", "text"))


@query("op10_byte_bpe", "documents")
def _op10(documents):
    return bpe.encode_documents(documents)


@query("op11_fill_in_middle", "documents", sql=infill.SQL)
def _op11(documents):
    return infill.digests(documents)


@query("op12_sharding", "documents")
def _op12(documents):
    return sharding.shard_documents(documents)


@query("op13_conversation_repair", "conversations", sql=repair.SQL)
def _op13(conversations):
    return repair.report(repair.damage(conversations))
