"""Hashed word and character n-grams of texts, for whole blocks of text at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import held_out, steps, tidy

#: bytes handled at once (a step's arrays take some hundred times as much), and buckets (a power of two); the last buckets are kept for REPEATED_WORD and REPEATED_LINE
STEP, BUCKET_BITS = 1 << 18, 12
DIMS = 1 << BUCKET_BITS
REPEATED_WORD, REPEATED_LINE, OTHERS = DIMS - 1, DIMS - 2, DIMS - 2

#: a share of repetition of one in so many weighs as much as the n-grams
REPETITION = 4

SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
#: bytes by their look: letters a or A, digits 0, anything else as it is
LOOKS = np.arange(256, dtype=np.uint8)
LOOKS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = ord("a")
LOOKS[ord("A") : ord("Z") + 1] = ord("A")
LOOKS[ord("0") : ord("9") + 1] = ord("0")


def _mix(h: np.ndarray) -> np.ndarray:
    """A bucket for each 32-bit number."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA77)
    return ((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D)) % np.uint32(OTHERS)


def _char_grams(data: np.ndarray, owner: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h = np.full(size, salt, dtype=np.uint32)
    for k in range(n):
        h = (h + data[k : k + size]) * np.uint32(0x9E3779B1)
    inside = owner[:size] == owner[n - 1 :]
    return _mix(h[inside]), owner[:size][inside]


def count_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of all n-grams that occur: character trigrams as they are (lower case) and by their looks,
    words and word pairs (lower case, ASCII).  Then, as rows, each text's share of words that equal the word before and of
    lines that equal an earlier line."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), lengths)
    low = np.frombuffer(b"".join(texts).lower(), np.uint8)
    buckets, owners, shares = [], [], np.zeros((2, len(texts)))
    for data, salt in ((low, 1), (LOOKS[raw], 2)):
        b, o = _char_grams(data, owner, 3, salt)
        buckets.append(b)
        owners.append(o)
    word = ~SPACE[low]
    first = word.copy()
    first[1:] &= ~(word[:-1] & (owner[1:] == owner[:-1]))
    starts = np.flatnonzero(first)
    if len(starts):
        # polynomial hash of each word modulo 2^32: byte times odd^place, summed up, divided by odd^first place
        place = np.arange(len(low), dtype=np.uint32)
        values = (low.astype(np.uint32) + np.uint32(1)) * np.where(word, _powers(len(low)), np.uint32(0))
        h = np.add.reduceat(values, starts, dtype=np.uint32) * _inverse_powers(place[starts])
        of = owner[starts]
        buckets.append(_mix(h))
        owners.append(of)
        together = of[1:] == of[:-1]
        buckets.append(_mix((h[:-1] * np.uint32(31) + h[1:])[together]))
        owners.append(of[1:][together])
        same = together & (h[1:] == h[:-1])
        shares[0] = np.bincount(of[1:][same], minlength=len(texts)) / np.maximum(np.bincount(of, minlength=len(texts)), 1)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        shares[1, i] = 1 - len(set(lines)) / max(len(lines), 1) if lines else 0
    keys = np.concatenate(owners).astype(np.int64) << BUCKET_BITS | np.concatenate(buckets).astype(np.int64)
    counts = np.bincount(keys, minlength=0)
    at = np.flatnonzero(counts)
    return at >> BUCKET_BITS, at & (DIMS - 1), counts[at], shares


ODD, ODD_INVERSE = 0x01000193, pow(0x01000193, -1, 1 << 32)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, ODD, dtype=np.uint32)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint32)


def _inverse_powers(places: np.ndarray) -> np.ndarray:
    """ODD to the power of minus each place, by squaring."""
    out, base, left = np.ones(len(places), np.uint32), ODD_INVERSE, places.copy()
    while left.any():
        out = np.where(left & 1, out * np.uint32(base), out).astype(np.uint32)
        base, left = base * base % (1 << 32), left >> 1
    return out


def dense(texts: list[bytes]) -> np.ndarray:
    """Damped counts, texts x DIMS; the shares of repetition weigh up to as much as all n-grams of the text together."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    row, bucket, n, shares = count_features(texts)
    out[row, bucket] = np.log1p(n)
    norm = np.sqrt((out * out).sum(axis=1))
    out[:, REPEATED_WORD], out[:, REPEATED_LINE] = norm * np.minimum(REPETITION * shares, 1)
    return out


def blocks(column: pa.Array) -> Iterator[np.ndarray]:
    """Damped counts of a text column, step by step; a null counts as empty."""
    for _, texts in steps(column, STEP):
        for at in range(0, len(texts), 1024):
            yield dense(texts[at : at + 1024])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, folds: int | None, fold: int, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and crc32 of the id of ``per_class`` labelled rows per class at most, chosen by a hash of the id.

    With ``folds``, rows whose crc32 of the id leaves ``fold`` are never taken.  Ids labelled both 0 and 1 are left out.  The
    chosen ids are a bounded list; documents are filtered by it where they are read.  Of an id with several texts the one
    with the least hash is taken (then the least text), so that no id crowds out others.  Rows come in the order of their id.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    if folds:
        ids = ids.where(~held_out(F.col(id_col), folds, fold))
    ids = ids.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z").select("id", "y")
    chosen = {}
    for y in (0, 1):
        for r in ids.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect():
            chosen[r["id"]] = y
    if not chosen:
        return np.zeros((0, DIMS), np.float32), np.zeros(0), np.zeros(0, np.int64)
    picked = docs.where(F.col(id_col).isin(*chosen)).select(F.col(id_col).cast("bigint").alias("id"), F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")).alias("crc"), F.col(text_col).cast("string").alias("text"))

    one = picked.groupBy("id", "crc").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.tobytes() for block in blocks(batch.column("text")) for x in block.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("crc"), pa.array(rows, pa.binary())], names=["id", "crc", "x"])

    rows = sorted(one.mapInArrow(tidy(compute), "id bigint, crc bigint, x binary").collect(), key=lambda r: r["id"])  # a row for each chosen id
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, DIMS), np.float32)
    return x, np.array([chosen[r["id"]] for r in rows], dtype=float), np.array([r["crc"] for r in rows], dtype=np.int64)
