"""Hashed text features and linear models shared by the two trained classifiers.

A word contributes its own hash, its first four, five and six letters, its last three and its
shape; a document's features are the shares of its words that have them.  The score of a
linear model is then the mean of its words' scores, which a worker computes once per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DIMENSIONS = 1 << 18
#: Shares are small; this brings the useful ones near 1.
GAIN = 30.0
#: Words whose scores a worker keeps.
SCORED_WORDS = 1_000_000
REPEAT = b"\x00repeat"
_SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[0-9]+"), "0"))


def word_features(word: bytes) -> list[int]:
    if word == REPEAT:
        return [0]
    w = word.decode("utf-8", "replace")
    shape = w
    for pattern, mark in _SHAPES:
        shape = pattern.sub(mark, shape)
    low = w.lower().strip(".,;:!?|*#$%&()\"'")
    keys = [f"w{low}", f"s{shape[:8]}"]
    keys += [f"p{low[:k]}" for k in (4, 5, 6) if len(low) > k]
    if len(low) > 3:
        keys.append(f"e{low[-3:]}")
    return [xxhash.xxh32_intdigest(k) % (DIMENSIONS - 1) + 1 for k in keys]


def words_of(text: object) -> list[bytes]:
    """Words of the text and one mark for each that repeats the word before it."""
    words = C.encoded(text).split()
    return words + [REPEAT] * sum(a == b for a, b in zip(words, words[1:], strict=False))


_features: dict[bytes, list[int]] = {}


def document_features(text: object) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature indexes and their shares times ``GAIN``."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
    if len(_features) > C.MEMO_LIMIT:
        _features.clear()
    flat: list[int] = []
    for w in words:
        f = _features.get(w)
        if f is None:
            f = _features[w] = word_features(w)
        flat += f
    index, count = np.unique(np.array(flat, dtype=np.int32), return_counts=True)
    return index, (count * (GAIN / len(words))).astype(np.float32)


class MeanScorer:
    """Mean over the words of a text of the word scores under ``weights`` (models x dimensions)."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self._clear()

    def _clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((1 << 16, len(self.weights)), dtype=np.float32)

    def __call__(self, text: object) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(len(self.weights))
        at = list(map(self.row.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(words, at, strict=True) if i is None))
            if len(self.row) + len(new) > SCORED_WORDS and self.row:
                self._clear()
                return self(text)
            while len(self.row) + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            features = [word_features(w) for w in new]
            sizes = np.array([len(f) for f in features])
            flat = np.array([x for f in features for x in f], dtype=np.int64)
            known = len(self.row)
            self.table[known : known + len(new)] = np.add.reduceat(self.weights[:, flat], np.cumsum(sizes) - sizes, axis=1).T
            self.row.update((w, known + i) for i, w in enumerate(new))
            at = list(map(self.row.__getitem__, words))
        return self.table[np.array(at, dtype=np.int64)].mean(axis=0, dtype=np.float64) * GAIN


class Design:
    """Sparse design matrix of the training rows, without features of fewer than ``least`` rows.

    With ``even`` features are scaled to about unit mean square (less for very rare ones), so
    that words which are telling but rare are learned as fast as common ones.
    """

    def __init__(self, index: list[np.ndarray], share: list[np.ndarray], dense: np.ndarray | None = None, least: int = 2, even: bool = False):
        self.rows = len(index)
        sizes = np.array([len(i) for i in index], dtype=np.int64)
        col = np.concatenate(index) if self.rows else np.empty(0, dtype=np.int64)
        row = np.repeat(np.arange(self.rows), sizes)
        val = np.concatenate(share).astype(np.float64) if self.rows else np.empty(0)
        often = np.bincount(col, minlength=DIMENSIONS) >= least
        keep = often[col]
        self.columns, self.col = np.unique(col[keep], return_inverse=True)
        self.row, self.val = row[keep], val[keep]
        square = np.bincount(self.col, weights=self.val**2, minlength=len(self.columns)) / max(1, self.rows)
        self.scale = 1 / np.sqrt(square + 1e-3) if even else np.ones(len(self.columns))
        self.val = self.val * self.scale[self.col]
        self.dense = np.zeros((self.rows, 0)) if dense is None else dense

    def take(self, rows: np.ndarray) -> "Design":
        out = object.__new__(Design)
        place = np.full(self.rows, -1)
        place[rows] = np.arange(len(rows))
        keep = place[self.row] >= 0
        out.rows, out.columns, out.scale, out.col = len(rows), self.columns, self.scale, self.col[keep]
        out.row, out.val, out.dense = place[self.row[keep]], self.val[keep], self.dense[rows]
        return out

    def scores(self, w: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col] * self.val, minlength=self.rows) + self.dense @ d

    def gradient(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.col, weights=residual[self.row] * self.val, minlength=len(self.columns)), residual @ self.dense

    def full(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(DIMENSIONS, dtype=np.float32)
        out[self.columns] = w * self.scale
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def adam(gradient, start: np.ndarray, steps: int, rate: float = 0.1) -> np.ndarray:
    """Full-batch descent on ``gradient(x)``."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x


def fit_logistic(design: Design, y: np.ndarray, steps: int = 150, sparsity: float = 2e-3, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray, float]:
    """Text weights (L1-penalized), dense weights and intercept of a logistic regression, by
    accelerated proximal gradient: few words are telling, and the rest must not add noise."""
    n, d = max(1, len(y)), design.dense.shape[1]
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    x, dense, b = np.zeros(len(design.columns)), np.zeros(d), float(np.log(base / (1 - base)))
    ahead, t = x, 1.0
    for _ in range(steps):
        r = (sigmoid(design.scores(ahead, dense) + b) - y) / n
        gw, gd = design.gradient(r)
        moved = ahead - rate * gw
        moved = np.sign(moved) * np.maximum(np.abs(moved) - rate * sparsity, 0)
        dense, b = dense - rate * gd, b - 4 * rate * float(r.sum())
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = moved + (before - 1) / t * (moved - x)
        x = moved
    return x, dense, b


def training_rows(docs: DataFrame, labels: DataFrame, columns: list[str], limit: int, key: str, text: str, extra: dict | None = None) -> DataFrame:
    """Features and label columns of at most ``limit`` labelled rows, those of least key hash; one row per document id.

    Of contradicting labels of an id the least counts (by ``columns`` in order), of the texts of an
    id the one of least fingerprint, so the rows and the model are the same in every run.
    """
    C.prepare(docs.sparkSession)
    known = F.col(key).isNotNull()
    for c in columns:
        known = known & F.col(c).isNotNull()
    some = labels.where(known).groupBy(key).agg(F.min(F.struct(*columns)).alias("_least")).select(key, "_least.*")
    some = some.orderBy(F.xxhash64(key), key).limit(limit)  # at most ``limit`` small rows
    texts = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    fields = some.dtypes
    # partial aggregation leaves one text of each id and task
    chosen = F.min(F.struct(F.xxhash64("_text").alias("fp"), F.col("_text").alias("text"))).alias("_first")
    joined = texts.join(F.broadcast(some), key).groupBy(*[c for c, _ in fields]).agg(chosen).withColumn("_text", F.col("_first.text")).drop("_first")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [document_features(t) for t in pdf["_text"]]
            out = pdf.drop(columns="_text").assign(index=[i for i, _ in pairs], share=[s for _, s in pairs])
            for name, f in (extra or {}).items():
                out[name] = [f(t) for t in pdf["_text"]]
            yield out

    schema = ", ".join([*(f"{c} {t}" for c, t in fields), "index array<int>", "share array<float>", *(f"{n} boolean" for n in extra or {})])
    return joined.mapInPandas(featured, schema)
