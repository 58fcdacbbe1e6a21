"""Toxicity: a classifier chain over toxicity categories.

The categories are predicted in order by linear models on hashed text; each model also gets
the log-odds of the categories before it.  In training these are out-of-fold predictions, so
that a later model sees them as uncertain as they are on new documents.

Training takes at most ``train_rows`` labelled rows (a documented bound).  The models of a
category's folds are fitted as parallel tasks, one for each fold and one for all rows.

Defined cases: a text without words has probability 0 and is not toxic.  A row whose label
of a category is null does not train that category; a category without both labels has
probability 0.  Without labelled rows nothing is toxic.  Of repeated labels of one id the least
counts, and of repeated ids one text trains.  A probability equal to ``least`` is toxic.  Very
long texts are read whole.  Repeated rows each get a row, an empty table none.  Extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C
from . import text_model as M

#: Words that part the labelled toxic rows into the two weak categories.
INSULTS = ("idiot", "moron", "clown", "loser", "scum")
CONTEMPT = ("trash", "pathetic", "worthless", "disgusting", "stupid")
CATEGORIES = ("insult", "contempt", "toxic")


def has_word(words: tuple[str, ...]):
    pattern = re.compile(r"\b(?:" + "|".join(words) + r")\b", re.IGNORECASE)
    return lambda text: bool(pattern.search(text)) if isinstance(text, str) else False


def weak_labels(rows: DataFrame) -> DataFrame:
    """Category labels: toxic as rated; a toxic row is an insult or contempt by its words, and of
    unknown category (null) if it has none of these."""
    toxic = F.col("toxic") == 1
    unknown = toxic & ~F.col("has_insult") & ~F.col("has_contempt")
    by = lambda c: F.when(unknown, None).otherwise((toxic & F.col(c)).cast("int"))
    return rows.select("index", "share", by("has_insult").alias("insult"), by("has_contempt").alias("contempt"), toxic.cast("int").alias("toxic"), "fold", "row")


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


class Chain:
    """Text weights (category x dimension), weights of earlier categories, intercepts."""

    def __init__(self, weights: np.ndarray, earlier: list[np.ndarray], intercepts: list[float]):
        self.weights, self.earlier, self.intercepts = weights, earlier, intercepts

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """From text scores (rows x categories), category by category."""
        p = np.zeros_like(scores)
        for k in range(scores.shape[1]):
            p[:, k] = M.sigmoid(scores[:, k] + log_odds(p[:, :k]) @ self.earlier[k] + self.intercepts[k])
        return p


def _fitter(category: str, k: int, sent):
    """Fits the model of one fold (or -1: of all rows) of the k-th category and predicts the rows held out."""

    def fit(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row").reset_index(drop=True)
        model = int(group[0])
        dense = log_odds(sent.value[pdf["row"].to_numpy()]) if k else np.zeros((len(pdf), 0))
        design = M.Design([np.asarray(i) for i in pdf["index"]], [np.asarray(s) for s in pdf["share"]], dense, least=5, even=True)
        known = pdf[category].notna().to_numpy()
        learn = np.flatnonzero(known & (pdf["fold"].to_numpy() != model))
        y = pdf[category].fillna(0).to_numpy(dtype=float)
        if len(learn) and 0 < y[learn].mean() < 1:
            w, d, b = M.fit_logistic(design.take(learn), y[learn])
        else:
            w, d, b = np.zeros(len(design.columns)), np.zeros(k), -30.0
        p = M.sigmoid(design.scores(w, d) + b)
        held = np.flatnonzero(pdf["fold"].to_numpy() == model)
        return pd.DataFrame(
            {"model": [model], "w": [design.full(w).tobytes() if model < 0 else None], "d": [d.tolist()], "b": [b], "at": [pdf["row"].to_numpy()[held].tolist()], "p": [p[held].tolist()]}
        )

    return fit


def train_chain(rows: DataFrame, categories: tuple[str, ...], folds: int, scratch: C.Scratch) -> Chain:
    """Fit the chain; ``rows`` is a stored, bounded table with row, fold, index, share and one 0/1 column per category."""
    spark = rows.sparkSession
    n = rows.count()
    out_of_fold = np.zeros((n, 0))
    weights, earlier, intercepts = [], [], []
    for k, category in enumerate(categories):
        sent = spark.sparkContext.broadcast(out_of_fold)

        models = F.explode(F.array(*(F.lit(i) for i in range(-1, folds)))).alias("model")
        fitted = rows.select("row", "fold", "index", "share", category, models).groupBy("model")
        found = fitted.applyInPandas(_fitter(category, k, sent), "model int, w binary, d array<double>, b double, at array<int>, p array<double>").collect()  # folds + 1 rows
        column = np.zeros((n, 1))
        for r in found:
            column[r["at"], 0] = r["p"]
            if r["model"] < 0:
                weights.append(np.frombuffer(r["w"], dtype=np.float32))
                earlier.append(np.array(r["d"]))
                intercepts.append(r["b"])
        out_of_fold = np.concatenate([out_of_fold, column], axis=1)
    return Chain(np.stack(weights), earlier, intercepts)


def training_table(docs: DataFrame, labels: DataFrame, train_rows: int, folds: int, key: str, text: str, scratch: C.Scratch) -> DataFrame:
    """The stored, bounded table of the training rows with their features, categories and folds."""
    rows = M.training_rows(docs, labels, ["toxic"], train_rows, key, text, {"has_insult": has_word(INSULTS), "has_contempt": has_word(CONTEMPT)})
    # at most ``train_rows`` rows are numbered here
    rows = rows.withColumn("row", F.row_number().over(W.orderBy(F.xxhash64(key), key)) - 1).withColumn("fold", F.col("row") % folds)
    return scratch.table(weak_labels(rows), "toxicity-training")


def score_toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.5, train_rows: int = 4000, folds: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, the probability of each category and ``toxic``."""
    spark = docs.sparkSession
    C.prepare(spark)
    scratch = C.Scratch(spark)
    rows = training_table(docs, labels, train_rows, folds, key, text, scratch)
    picked = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = dict(docs.dtypes)[key]
    if rows.isEmpty():
        zero = [F.lit(0.0).alias(f"p_{c}") for c in CATEGORIES]
        return picked.select(key, *zero, F.lit(False).alias("toxic"))
    sent = spark.sparkContext.broadcast(train_chain(rows, CATEGORIES, folds, scratch))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = sent.value
        scorer = M.MeanScorer(chain.weights)
        for pdf in batches:
            texts = pdf.pop("_text")
            p = chain.probabilities(np.array([scorer(t) for t in texts]).reshape(len(pdf), len(CATEGORIES)))
            p[[not C.encoded(t).strip() for t in texts]] = 0
            for k, c in enumerate(CATEGORIES):
                pdf[f"p_{c}"] = np.round(p[:, k], 4)
            yield pdf.assign(toxic=p[:, -1] >= least)

    return picked.mapInPandas(score, f"{key} {kind}, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean")

