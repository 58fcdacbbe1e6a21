"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of hashed-text weights is shared by all grades; ordered thresholds turn the score
into P(grade <= k) = sigmoid(threshold_k - score).  A document gets its expected grade and the
probability of reaching ``accept``, the grade from which on it is kept.

Training takes at most ``train_rows`` labelled rows (a documented bound), whose features are
computed where the documents lie; one task fits the model, and every document is scored.

Defined cases: a text without words scores 0 and is judged by the thresholds alone.  Labels
that are null or without document are left out; of repeated labels of one id the least grade
counts, and of repeated ids one text trains (see ``training_rows``).  Very long texts are read
whole.  A tail probability equal to ``least`` keeps the row.  Without labelled rows, or with a single grade, there is no model: expected grade and
tail probability are null and every row is kept.  Repeated rows each get a row.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import text_model as M


def graded(labels: DataFrame) -> DataFrame:
    """Grade 0: poor; 1: good but toxic; 2: good."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return labels.select("doc_id", F.when(~good, 0).when(toxic, 1).when(good & ~toxic, 2).alias("grade"))


def fit_ordinal(design: M.Design, y: np.ndarray, grades: int, steps: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Text weights and ordered thresholds; these are a first one and positive gaps (as logarithms)."""
    k, n = len(design.columns), max(1, len(y))
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    start = np.concatenate([np.zeros(k), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.1))])

    def thresholds(x: np.ndarray) -> np.ndarray:
        return x[k] + np.append(0, np.cumsum(np.exp(x[k + 1 :])))

    def gradient(x: np.ndarray) -> np.ndarray:
        t = thresholds(x)
        s = design.scores(x[:k], np.zeros(0))
        below = M.sigmoid(np.append(t, np.inf)[y] - s)
        above = np.where(y > 0, M.sigmoid(np.append(-np.inf, t)[y] - s), 0.0)
        p = np.maximum(below - above, 1e-9)
        upper, lower = below * (1 - below) / p / n, above * (1 - above) / p / n
        gw, _ = design.gradient(upper - lower)  # d(-log p)/ds
        gt = np.zeros(grades)
        np.add.at(gt, y, -upper)
        np.add.at(gt, np.maximum(y - 1, 0), np.where(y > 0, lower, 0.0))
        gt = gt[: grades - 1]
        rest = np.cumsum(gt[::-1])[::-1]
        return np.concatenate([gw + penalty * x[:k], rest[:1], rest[1:] * np.exp(x[k + 1 :])])

    x = M.adam(gradient, start, steps)
    return x[:k], thresholds(x)


def train(docs: DataFrame, ratings: DataFrame, train_rows: int = 6000, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray, list[int]] | None:
    """Weights, thresholds and the grades they part; None if there is nothing to learn."""
    rows = M.training_rows(docs, ratings, ["grade"], train_rows, key, text)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        levels = sorted(pdf["grade"].unique().tolist())
        if len(levels) < 2:
            return pd.DataFrame({"weights": [], "thresholds": [], "grades": []})
        design = M.Design([np.asarray(i) for i in pdf["index"]], [np.asarray(s) for s in pdf["share"]])
        w, t = fit_ordinal(design, np.searchsorted(levels, pdf["grade"].to_numpy()), len(levels))
        return pd.DataFrame({"weights": [design.full(w).tobytes()], "thresholds": [t.tolist()], "grades": [levels]})

    model = rows.groupBy().applyInPandas(fit, "weights binary, thresholds array<double>, grades array<int>").first()
    if model is None:
        return None
    return np.frombuffer(model["weights"], dtype=np.float32), np.array(model["thresholds"]), model["grades"]


def grade_quality(docs: DataFrame, ratings: DataFrame, accept: int = 1, least: float = 0.5, train_rows: int = 6000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``expected_grade``, ``tail_probability`` (of ``accept`` or better) and ``kept``."""
    spark = docs.sparkSession
    C.prepare(spark)
    model = train(docs, ratings, train_rows, key, text)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    if model is None:
        none: Column = F.lit(None).cast("double")
        return rows.select(key, none.alias("expected_grade"), none.alias("tail_probability"), F.lit(True).alias("kept"))
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, thresholds, grades = sent.value
        scorer = M.MeanScorer(weights[None, :])
        grades = np.array(grades, dtype=float)
        for pdf in batches:
            s = np.array([scorer(t)[0] for t in pdf.pop("_text")])
            up_to = M.sigmoid(thresholds[None, :] - s[:, None])  # P(grade <= k)
            p = np.diff(np.concatenate([np.zeros((len(s), 1)), up_to, np.ones((len(s), 1))], axis=1), axis=1)
            tail = p[:, grades >= accept].sum(axis=1)
            yield pdf.assign(expected_grade=np.round(p @ grades, 4), tail_probability=np.round(tail, 4), kept=tail >= least)

    return rows.mapInPandas(score, f"{key} {dict(docs.dtypes)[key]}, expected_grade double, tail_probability double, kept boolean")


def keep_good(docs: DataFrame, ratings: DataFrame, accept: int = 1, least: float = 0.5, train_rows: int = 6000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; scored where they lie, no join."""
    spark = docs.sparkSession
    C.prepare(spark)
    model = train(docs, ratings, train_rows, key, text)
    if model is None:
        return docs
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, thresholds, grades = sent.value
        scorer = M.MeanScorer(weights[None, :])
        cut = int(np.searchsorted(grades, accept))  # P(grade >= accept) = 1 - P(grade <= the one below)
        for texts in batches:
            s = np.array([scorer(t)[0] for t in texts])
            yield pd.Series(1 - M.sigmoid(thresholds[cut - 1] - s) >= least if 0 < cut <= len(thresholds) else np.full(len(s), cut == 0))

    return docs.where(good(F.col(text)))
