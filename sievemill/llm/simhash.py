"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  Of two bits of difference at most, one segment at
least gets none (pigeonhole), and every other segment gets two at most.  So a fingerprint's keys are: one segment as it
is, with the next segment decoded, padded to 23 bits, to the 12-bit indices of all codewords of the perfect binary Golay
code within four bits.  There are one or six of them.  Two segments that differ in two bits have a point between them, one
bit from each; its codeword is three bits away at most, hence within four bits of both: they share that index, and the
fingerprints share a key.  Fingerprints that share a key are joined and their distance is checked.

Only distinct fingerprints are keyed, so copies cost nothing.  A key that very many fingerprints share (a large cluster
of near copies) is not joined with itself.  Its fingerprints are grouped by the 65 points within one bit of them:
two fingerprints are at two bits or less exactly when they have such a point in common, and each then links with the
point's smallest fingerprint.  That keeps every component, with rows in proportion to the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import components, spare, stored, tidy

#: words in a shingle, and bits by which linked fingerprints may differ
SHINGLE, DISTANCE = 3, 2
#: seed of the shingle hash
SEED = 42
#: first bit and width of each segment
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: fingerprints of one key that are joined pair by pair; beyond it they are grouped by common points
JOINED = 64
#: generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code
GENERATOR = 0b110001110101


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits that over half of the shingles' hashes have; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    size = min(shingle, len(words))
    starts = [0, *ends[: len(words) - size].tolist()]
    digest = xxhash.xxh64_digest
    counts, total = np.zeros(64, dtype=np.int64), len(words) - size + 1
    stops = (ends[size - 1 :] - 1).tolist()
    for at in range(0, total, 1 << 15):
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int("".join("1" if 2 * c > total else "0" for c in counts.tolist()), 2)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fingerprint (a signed long) of every row; a null text counts as one without words."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py() or b"", shingle) for t in batch.column("text").cast(pa.large_binary())]
            signed = np.array(made, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(signed)], names=["doc_id", "text_hash", "fp"])

    return narrow.mapInArrow(tidy(run), f"doc_id {kind}, text_hash bigint, fp bigint")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def golay_patterns() -> np.ndarray:
    """For each syndrome the patterns of four bits or less that lead to a codeword: one or six, the rest -1."""
    out = np.full((2048, 6), -1, dtype=np.int64)
    used = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], dtype=np.int64)
        for pattern, syndrome in zip(patterns.tolist(), _syndromes(patterns).tolist()):
            out[syndrome, used[syndrome]] = pattern
            used[syndrome] += 1
    return out


def golay_keys(fps: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (position in ``fps``, key): a segment as it is and an index of a codeword near the next segment."""
    unsigned = fps.view(np.uint64)
    cut = [(unsigned >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64) for first, width in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(cut):
        near = cut[(i + 1) % len(cut)]
        found = patterns[_syndromes(near)]
        at, which = np.nonzero(found >= 0)
        index = (near[at] ^ found[at, which]) >> 11
        rows.append(at)
        keys.append(np.int64(i) << 34 | exact[at] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def linked_fingerprints(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that span all components of those within ``distance`` bits."""
    if distance != DISTANCE:
        raise ValueError(f"the keys and the common points are made for {DISTANCE} bits of difference")
    patterns = golay_patterns()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            rows, keys = golay_keys(fps, patterns)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            points = (fps.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(points.ravel()), pa.array(np.repeat(fps, len(flips)))], names=["point", "fp"])

    keys = stored(distinct.select("fp").mapInArrow(keyed, "key bigint, fp bigint"))
    sizes = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = stored(keys.join(sizes, "key"))
    few = met.where(F.col("n") <= JOINED).select("key", "fp")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b").distinct()
    many = met.where(F.col("n") > JOINED).select("fp").distinct()
    balls = stored(many.mapInArrow(around, "point bigint, fp bigint"))
    least = stored(balls.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a"))
    stars = balls.join(least, "point").select("a", F.col("fp").alias("b")).where("a <> b").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, fingerprint (16 hex digits), component_id, text_hash, kept.

    Fingerprints link at ``distance`` bits or fewer; texts without words all have fingerprint zero and link like any other.
    ``component_id`` is the smallest id reachable by links.  ``kept`` marks, in each component, the rows of that id with the
    smallest text hash: exactly repeated rows are kept together and callers drop the repeats.  A null id never is a
    component's id unless it has no other.  An empty table gives no rows; further columns are left out.
    """
    all_rows = stored(fingerprints(docs, shingle, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    distinct = stored(all_rows.groupBy("fp").agg(first))
    roots = components(linked_fingerprints(distinct, distance))
    rooted = stored(distinct.join(roots, distinct["fp"] == roots["id"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    ids = stored(rooted.groupBy("root").agg(F.min("first").alias("first")))
    named = stored(rooted.select("fp", "root").join(ids, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("_hash")))
    return all_rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash",
        (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("_hash"))).alias("kept"),
    )


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id.  All columns stay as they are."""
    kept_id, kept_hash = spare(docs, "_kept_id"), spare(docs, "_kept_hash")
    kept = near_duplicates(docs, shingle, distance, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)).distinct()
    kept = stored(kept)
    text = F.xxhash64(F.col(text_col).cast("string"))
    met = docs.join(kept, docs[id_col].eqNullSafe(kept[kept_id]) & (text == kept[kept_hash]))
    return met.dropDuplicates([kept_id, kept_hash]).select(*[docs[c] for c in docs.columns])
