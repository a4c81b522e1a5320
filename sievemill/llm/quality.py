"""Quality classifier: nearest-neighbour voting among labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.llm.common import annotate, held_out
from sievemill.llm.features import DIMS, blocks, labelled_sample

#: labelled rows kept per class, dimensions of the space, voting neighbours, and the power of the cosine that is a vote's weight
PER_CLASS, RANK, NEIGHBOURS, SHARPNESS = 1200, 48, 15, 16
#: documents that one product holds
BLOCK = 512


def _space(x: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of ``x`` by subspace iteration from a fixed start."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.standard_normal((x.shape[1], min(rank + 8, *x.shape))))[0].astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ vt.T)[:, :rank]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rank: int = RANK, folds: int = 3, fold: int = 1) -> dict:
    """Projection to the latent space, and the labelled vectors in it.

    At most ``per_class`` rows of each label are used, chosen by a hash of the id from those not held out; so what is
    broadcast has a fixed bound.  Features are weighted by their rarity in that sample.
    """
    x, y, _ = labelled_sample(docs, labels, per_class, folds, fold)
    if not len(x):
        return {"project": np.zeros((DIMS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": y, "share": 0.5}
    rarity = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1
    weighted = _unit(x * rarity.astype(np.float32))
    basis = _space(weighted, rank)
    project = (rarity[:, None] * basis).astype(np.float32)
    return {"project": project, "vectors": _unit(x @ project), "labels": y, "share": float(y.mean())}


def _score(counts: np.ndarray, model: dict, neighbours: int) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors, computed exactly.

    Cosines are told apart in steps of 2^-20; of equally near vectors those of the smaller ids are nearest.
    """
    vectors, labels = model["vectors"], model["labels"]
    if not len(vectors):
        return np.full(len(counts), model["share"])
    cosine = _unit(counts @ model["project"]) @ vectors.T
    k = min(neighbours, len(vectors))
    steps = np.rint(cosine.astype(np.float64) * (1 << 20)).astype(np.int64)
    place = np.arange(len(vectors) - 1, -1, -1)
    nearest = np.argpartition(-(steps * len(vectors) + place), k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(steps, nearest, axis=1) / (1 << 20), 0) ** SHARPNESS
    total = weight.sum(axis=1)
    voted = (weight * labels[nearest]).sum(axis=1)
    return np.clip(np.divide(voted, total, out=np.full(len(counts), model["share"]), where=total > 0), 0, 1)


def score(docs: DataFrame, model: dict, text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from 0.5 on).

    Only the text decides, so repeated rows score alike; an empty table gives no rows.  A null or empty text, or one that shares nothing with any neighbour, scores the share of label 1
    among the labelled rows; so does every text where no label was learned (0.5 then).  Columns that have these names
    already keep them, and the new ones get an underscore.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(columns: list[pa.Array]) -> tuple:
        found = [_score(counts[at : at + BLOCK], shared.value, neighbours) for counts in blocks(columns[0].cast(pa.string())) for at in range(0, len(counts), BLOCK)]
        all_scores = np.concatenate(found).astype(np.float64) if found else np.zeros(0)
        return all_scores, (all_scores >= 0.5).astype(np.int32)

    return annotate(docs, [text_col], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; further columns are left out and null ids are never held out."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = score(narrow, train(narrow, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is predicted to be good, with the columns they had."""
    scored = score(docs, model, text_col)
    return scored.where(F.col(scored.columns[-1]) == 1).select(*docs.columns)
