"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the words of a text, joined by single spaces, and looks back sixteen bytes.  Where it falls under a
threshold, the next word starts a new chunk.  So boundaries depend on the words around them alone: an insertion moves no
boundary further on, and a passage that two texts share has the same chunks in both but for its ends.  What is looked
up elsewhere is a passage: the fewest chunks in a row that have MIN_WORDS words, from each chunk on and up to each chunk.
Passages are told apart by a 64-bit digest; of the rows that hold one, that of the smallest id keeps it, the others lose
it.  Chunks that occur elsewhere, but not in a row, stay, and so do common lines and phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.llm.common import spare, stored, tidy

#: one byte in so many starts the next word's chunk; words that a run of repeated chunks has at least
SPACING, MIN_WORDS = 29, 14
#: bytes the rolling hash looks back (a power of two)
LOOK_BACK = 16
#: the gear table: a random 32-bit number for each byte
GEAR = np.random.default_rng(9).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte over the last LOOK_BACK bytes: ``sum(GEAR[byte k back] << k)`` modulo 2^32.

    Windows double: the hash of 2k bytes is that of the last k plus that of the k before, shifted by k.
    """
    h = GEAR[data]
    k = 1
    while k < LOOK_BACK:
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h, k = longer, 2 * k
    return h


def chunk(text: bytes, spacing: int = SPACING) -> tuple[np.ndarray, np.ndarray]:
    """First word of every chunk, with the number of words at the end, and the chunks' digests."""
    words = text.split()
    if not words:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    line = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    hits = np.flatnonzero(rolling(np.frombuffer(line, np.uint8)) < np.uint32((1 << 32) // spacing))
    first = np.unique(np.searchsorted(starts, hits, side="right"))
    cuts = np.concatenate([[0], first[first < len(words)], [len(words)]])
    at = starts[cuts].tolist()
    digest = xxhash.xxh3_64_digest
    digests = b"".join([digest(line[a : b - 1]) for a, b in zip(at, at[1:])])
    return cuts, np.frombuffer(digests, ">i8").astype(np.int64)


def passages(cuts: np.ndarray, digests: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First chunk, chunk after the last, and digest of every passage, in the order of the text.

    From each chunk on the fewest chunks that have ``min_words`` words, and up to each chunk likewise: these cover every
    run of chunks with so many words, the last chunks of a run too.
    """
    n = len(digests)
    after = np.searchsorted(cuts, cuts[:-1] + min_words)
    before = np.searchsorted(cuts, cuts[1:] - min_words, side="right") - 1
    ahead, back = np.flatnonzero(after <= n), np.flatnonzero(before >= 0)
    spans = np.unique(np.concatenate([ahead * (n + 1) + after[ahead], before[back] * (n + 1) + back + 1]))
    first, last = spans // (n + 1), spans % (n + 1)
    held, digest = digests.tobytes(), xxhash.xxh3_64_digest
    found = b"".join([digest(held[8 * a : 8 * b]) for a, b in zip(first.tolist(), last.tolist())])
    return first, last, np.frombuffer(found, ">i8").astype(np.int64)


def _earlier(first: np.ndarray, last: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """True for passages that stand earlier in the same text, clear of where they first stand."""
    _, at, which = np.unique(digests, return_index=True, return_inverse=True)
    return first >= last[at[which]]


def _covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """True for those of ``n`` chunks that a passage covers."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, last, -1)
    return np.cumsum(depth[:-1]) > 0


def _words_at(text: bytes) -> np.ndarray:
    """Byte position of each word's start and end, as rows."""
    word = ~np.isin(np.frombuffer(text, np.uint8), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def cut_out(text: bytes, cuts: np.ndarray, repeated: np.ndarray, min_words: int) -> tuple[bytes, int, list[tuple[int, int]]]:
    """``text`` without the runs of repeated chunks of ``min_words`` words or more, the words cut, and their word ranges."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8))).reshape(-1, 2)
    runs = [(int(cuts[a]), int(cuts[b])) for a, b in edge if cuts[b] - cuts[a] >= min_words]
    if not runs:
        return text, 0, []
    at, out, done = _words_at(text), [], 0
    for a, b in runs:
        out.append(text[done : at[a, 0]])
        done = int(at[b, 0]) if b < len(at) else len(text)
    out.append(text[done:])
    return b"".join(out).strip(b" \t\n\r\x0b\x0c"), sum(b - a for a, b in runs), runs


def _key(docs: DataFrame, id_col: str, text_col: str):
    """The id, or for rows without one a number beyond usual ids that hangs on the text."""
    hashed = F.xxhash64(F.col(text_col).cast("string")).bitwiseAND(F.lit((1 << 62) - 1))
    return F.coalesce(F.col(id_col).cast("bigint"), hashed.bitwiseOR(F.lit(1 << 62)))


def drop_repeats(docs: DataFrame, spacing: int = SPACING, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the text, and n_words, n_removed, removed (word ranges "a-b,c-d").

    A passage stays in the row of the smallest id that has it, at its first place there, and goes elsewhere.  Rows that share
    an id count as one document, so what they share stays in each; rows without an id come last.  The text between what
    is cut stays as it is, and outer white space of a changed text goes.  Null and empty texts stay; so do texts shorter
    than ``min_words``.  A text that is one repeated passage becomes empty and its row stays.  All columns stay; new ones
    whose name is taken get an underscore.  An empty table gives no rows.
    """
    key, text = spare(docs, "_key"), text_col
    keyed = docs.withColumn(key, _key(docs, id_col, text))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.large_binary())
            owners, digests, size = [], [], 0
            for k, v in zip(keys, values):
                own = np.unique(passages(*chunk(v.as_py() or b"", spacing), min_words)[2])
                owners.append(np.full(len(own), k, np.int64))
                digests.append(own)
                size += len(own)
                if size > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(digests)), pa.array(np.concatenate(owners))], names=["digest", "owner"])
                    owners, digests, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(digests)), pa.array(np.concatenate(owners))], names=["digest", "owner"])

    def held():
        return keyed.select(key, F.col(text).cast("string")).mapInArrow(tidy(emit), "digest bigint, owner bigint")

    shared = held().groupBy("digest").agg(F.min("owner").alias("first"), F.max("owner").alias("last")).where("first < last")
    shared = stored(shared.select("digest", "first"))
    later = held().join(shared, "digest").where("owner <> first")
    per_row = stored(later.groupBy("owner").agg(F.collect_set("digest").alias("_digests")))  # one text's passages at most
    owner, listed = spare(keyed, "_owner"), spare(keyed, "_digests")
    per_row = per_row.select(F.col("owner").alias(owner), F.col("_digests").alias(listed))
    met = keyed.join(per_row, keyed[key] == per_row[owner], "left").drop(owner)

    out = docs.schema
    extra = []
    for f in (T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.StringType())):
        name = spare(docs, f.name)
        extra.append(T.StructField(name, f.dataType))
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == text else f for f in out.fields] + extra)
    labels = schema.names
    columns = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(text).cast(pa.large_binary()), batch.column(listed)
            new, n_words, n_removed, ranges = [], [], [], []
            for t, marked in zip(texts, lists):
                value = t.as_py()
                if value is None:
                    new.append(None)
                    n_words.append(0)
                    n_removed.append(0)
                    ranges.append("")
                    continue
                cuts, digests = chunk(value, spacing)
                first, last, found = passages(cuts, digests, min_words)
                again = _earlier(first, last, found)
                if marked.is_valid:
                    again |= np.isin(found, marked.values.to_numpy())
                value, removed, runs = cut_out(value, cuts, _covered(len(digests), first[again], last[again]), min_words)
                new.append(value)
                n_words.append(int(cuts[-1]))
                n_removed.append(removed)
                ranges.append(",".join(f"{a}-{b}" for a, b in runs))
            kept = {c: batch.column(c) for c in columns}
            kept[text] = pa.array(new, pa.binary()).cast(pa.string())
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(ranges, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept.values(), *made], names=labels)

    return met.mapInArrow(tidy(rewrite), schema)
