"""Quality rules: base counts per text, and a calibrated logistic regression over hashed n-grams against a fixed threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.llm.common import annotate
from sievemill.llm.features import DIMS, blocks, labelled_sample

#: labelled rows per class that are trained on, the share of them (by crc32 of the id) that calibrates, and the ridge penalty
PER_CLASS, FOLDS, RIDGE = 1200, 4, 1e-3
#: a text is kept if its calibrated probability of being good is at least so much
THRESHOLD = 0.5
#: bounds of the base rules: fewest words, and most per cent of words in repeated windows of WINDOW words
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice in the text, the first occurrence included.

    Windows are numbered exactly by doubling: those of 2k words by the numbers of their two halves.
    """
    n = len(words)
    if n <= window:
        return 0
    number = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    size = 1
    while size < window:
        number = np.unique(number[:-size] * (int(number.max()) + 1) + number[size:], return_inverse=True)[1]
        size *= 2
    often = np.bincount(number)[number] > 1
    if not often.any():
        return 0
    change = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(often)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    inside = b"".join(words)
    chars = len(inside) - np.count_nonzero((np.frombuffer(inside, np.uint8) & 0xC0) == 0x80)
    return len(words), chars, sum(text.count(c.encode()) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and offset of a ridge logistic regression by accelerated gradient steps; both classes weigh the same."""
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, c = w.copy(), b
    rate = np.float32(4.0 / (float((share * (x * x).sum(axis=1)).sum()) + 1 + 4 * ridge))
    for step in range(300):
        p = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30)))
        off = share * (p - y).astype(np.float32)
        new_w, new_b = v - rate * (x.T @ off + ridge * v), c - float(rate) * float(off.sum())
        push = step / (step + 3)
        v, c = new_w + np.float32(push) * (new_w - w), new_b + push * (new_b - b)
        w, b = new_w, new_b
    return w, b


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-back margins (Platt), with softened targets; Newton steps."""
    n1, n0 = float(y.sum()), float((1 - y).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.column_stack([margin, np.ones_like(margin)])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        bend = z.T @ (z * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(bend, z.T @ (target - p) - 1e-6 * theta)
        theta = theta + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def _rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """The calibrated regression, learned from at most ``per_class`` labelled rows of each class, chosen by a hash of the id.

    With one class or none there is nothing to tell apart, and every text gets probability 1.
    """
    x, y, crc = labelled_sample(docs, labels, per_class, None, 0)
    if len(set(y.tolist())) < 2:
        return {"weights": np.zeros(DIMS, np.float32), "offset": 0.0, "slope": 0.0, "shift": 40.0}
    x = _rows(x)
    back = crc % FOLDS == 0
    if len(set(y[~back].tolist())) < 2 or len(set(y[back].tolist())) < 2:
        back = np.zeros(len(y), dtype=bool)
    weights, offset = _fit(x[~back], y[~back], RIDGE)
    held = back if back.any() else ~back
    slope, shift = _calibrate((x[held] @ weights + offset).astype(np.float64), y[held])
    return {"weights": weights, "offset": offset, "slope": slope, "shift": shift}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``probability`` and ``kept``.

    A null text counts as one without words, which fails the base rules.  Texts that pass them are kept if their
    probability reaches ``threshold``.  Columns that have these names already keep them, and the new ones get an underscore.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(columns: list[pa.Array]) -> tuple:
        text = columns[0].cast(pa.string())
        m = shared.value
        margins = [_rows(x) @ m["weights"] + m["offset"] for x in blocks(text)]
        margin = np.concatenate(margins).astype(np.float64) if margins else np.zeros(0)
        probability = 1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["shift"], -40, 40)))
        counts = np.array([base_counts(t.as_py() or b"") for t in text.cast(pa.large_binary())], dtype=np.int64).reshape(-1, len(COUNTS))
        failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
        return *counts.T, failed, probability, ~failed & (probability >= threshold)

    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return annotate(docs, [text_col], fields, make)


def judge_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept and probability of every row; further columns are left out."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return apply_rules(narrow, train(narrow, labels)).drop("text")


def keep_passing(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are kept, with the columns they had."""
    judged = apply_rules(docs, model, text_col)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)
