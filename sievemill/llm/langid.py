"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import held_out, steps, worker_store

#: n-gram sizes, hash buckets (a power of two) and added count of each bucket
SIZES, BUCKET_BITS, SMOOTHING = (1, 2, 3), 14, 0.5
UNKNOWN = "und"
#: characters handled at once
STEP = 1 << 20


def _letters() -> np.ndarray:
    """Which code points are letters."""
    kept = worker_store()
    if "letters" not in kept:
        kept["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return kept["letters"]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, text by text, the number of n-grams of each text, and whether it has a letter.

    Texts are lower-cased; each stretch of other characters than letters counts as one space, and so do both ends.
    """
    letters = _letters()
    codes = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) + 2 for t in texts], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)
    letter = letters[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (text[1:] != text[:-1])
    keep[0] = True
    codes, text = np.where(letter, codes, 32)[keep], text[keep]
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    per_text = np.diff(np.append(starts, len(text)))
    buckets, owners = [], []
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(SIZES) + 1):
        size = len(codes) - n + 1
        h = (h[: max(size, 0)] + codes[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in SIZES and size > 0:
            inside = text[:size] == text[n - 1 :]
            mixed = h * np.uint32(0x85EBCA77)
            buckets.append((mixed >> np.uint32(32 - BUCKET_BITS))[inside])
            owners.append(text[:size][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    has_letter = np.add.reduceat((codes != 32).astype(np.int64), starts) > 0
    assert len(per_text) == len(texts)
    return np.concatenate(buckets)[order], np.bincount(owner, minlength=len(texts)), has_letter


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, fold: int = 0) -> dict:
    """Log-probability of every bucket in each language, and the languages' priors, from all rows not held out.

    Each task counts its own texts; the counts are added up per language and bucket, and only the matrix (languages x
    2^14) reaches the driver.
    """
    usable = docs.where(~held_out(F.col(id_col), folds, fold) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    narrow = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for first, texts in steps(batch.column("text"), STEP):
                buckets, lengths, has_letter = ngrams([t.decode() for t in texts])
                mine = langs[first : first + len(texts)]
                owner = np.repeat(np.arange(len(texts)), lengths)
                for lang in set(mine.tolist()):
                    chosen = (mine == lang) & has_letter
                    total = totals.setdefault(lang, np.zeros((1 << BUCKET_BITS) + 1, dtype=np.int64))
                    total[:-1] += np.bincount(buckets[chosen[owner]], minlength=1 << BUCKET_BITS)
                    total[-1] += int(chosen.sum())  # after the buckets: the texts
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "bucket", "n"])

    counts = narrow.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns")).collect()
    langs = sorted(r["lang"] for r in rows)
    table = np.zeros((len(langs), (1 << BUCKET_BITS) + 1))
    for r in rows:
        table[langs.index(r["lang"]), r["buckets"]] = r["ns"]
    smooth = table[:, :-1] + SMOOTHING
    weights = np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))
    prior = np.log(np.maximum(table[:, -1:], 1) / max(table[:, -1].sum(), 1))[:, 0]
    return {"langs": langs, "weights": weights, "prior": prior}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row: the likeliest language and its posterior probability.

    A text that is null or has no letter, and any text where no language was learned, gives ``und`` and score 0.  A tie goes
    to the language that comes first by name.  The matrix is broadcast; its size is that of the languages, not of the texts.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col), folds, fold).alias("held_out"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights, prior = (shared.value[k] for k in ("langs", "weights", "prior"))
        for batch in batches:
            named, scores = [], []
            for _, texts in steps(batch.column("text"), STEP):
                buckets, lengths, has_letter = ngrams([t.decode() for t in texts])
                if not langs:
                    named += [UNKNOWN] * len(texts)
                    scores.append(np.zeros(len(texts)))
                    continue
                starts = np.cumsum(lengths) - lengths
                sums = np.stack([np.add.reduceat(w[buckets], starts) for w in weights]) + prior[:, None]
                best = sums.argmax(axis=0)
                posterior = 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
                named += [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has_letter.tolist())]
                scores.append(np.where(has_letter, posterior, 0.0))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(named, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
