"""Quality rules: robust multivariate outliers by minimum covariance determinant.

1. ``text_statistics`` measures every whole text (words, characters, symbols, repeated
   lines and phrases) in Arrow batches; no shuffle.  ``transformed`` makes features of the counts: the
   logarithm of the length, of the mean word, and roots of shares.  Each share is that of the text and
   ``PRIOR_WORDS`` ordinary words (of the median of all rows), as the shares of a short text say little.
2. ``robust_outliers`` fits, for each group (language and source), the minimum covariance
   determinant estimate of the transformed statistics.  There are several starts: medians and
   MADs, and mean and covariance of small subsets chosen by hash.  A concentration step keeps the
   ``support`` share of rows with the smallest Mahalanobis distances and estimates centre and
   covariance from them, which never raises the determinant.  After two steps the start of least
   determinant goes on until no determinant changes any more.  A step is one aggregation over
   all rows: moments are summed per group, start and distance bin (partial sums on the map side, so
   a group with a third of all rows costs no skew) and a running sum over the bins gives the
   moments of the kept share.  Rows are never sampled for a step.
   A variance is never below a tenth of the group's own robust deviation (MAD) squared, so the
   fit decides.  A count that is the same in over half of a group's rows (most texts have no symbols or repeated
   lines) has no such deviation; its least deviation follows from the first outer quantile, over all fitted rows of all
   groups, that differs from the median.
3. Distances whose median is above that of a chi-squared variable are scaled down to it
   (the kept share understates the spread), and rows beyond its ``quantile`` are rejected.

Defined cases: a null or empty text has no words, is short and fails the base rule.  Null
group columns are groups of their own.  Groups of fewer than ``min_group`` fitted rows are
pooled per language (first group column), and those again overall; without any fitted row
nothing but the base rule rejects.  Repeated rows each count and each get a row.  Very long texts
are measured whole.  Rows at one distance are in one bin, which is kept or left as a whole; starts of
equal determinant: the first.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

SYMBOLS = "#*$%&|<>"
PHRASE = 5
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_capitals", "n_adjacent")
FEATURES = ("f_length", "f_word", "f_symbol", "f_upper", "f_adjacent", "f_lines", "f_repeat")
#: Ordinary words that every text is measured together with.
PRIOR_WORDS = 100
#: The least deviation of a feature, as a share of its MAD; and where that is zero, of which outer quantiles the first counts.
LEAST_SHARE, OUTER = 0.1, (0.98, 0.995)
BINS_PER_OCTAVE = 16
#: A log determinant that changes by less has converged.
TOLERANCE = 1e-3
TINY = 1e-12


def measure(text: object) -> tuple[int, int, int, int, int, int, int, int]:
    """The base counts of one text, then its lines with a word, capitals and words equal to the one before."""
    raw = C.encoded(text)
    words = raw.split()
    if not words:
        return 0, 0, sum(map(text.count, SYMBOLS)) if isinstance(text, str) else 0, 0, 0, 0, 0, 0
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    hashes = C.word_hashes(words)
    repeated = 0
    h = C.window_hashes(hashes, PHRASE)
    if len(h) > 1:
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[inverse] > 1)
        repeated = int(C.covered(starts, PHRASE, len(words)).sum()) if len(starts) else 0
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    adjacent = int((hashes[1:] == hashes[:-1]).sum())
    return len(words), chars, symbols, sum(v - 1 for v in Counter(lines).values()), repeated, len(lines), capitals, adjacent


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        m = np.array([measure(t) for t in pdf.pop("_text")], dtype=np.int64).reshape(-1, 8)
        for k, name in enumerate((*BASE_COLUMNS, *MORE_COUNTS)):
            pdf[name] = m[:, k]
        yield pdf


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Columns ``doc_key, g0, g1, ..`` and the counts of every row."""
    C.prepare(docs.sparkSession)
    picked = docs.select(
        F.col(key).alias("doc_key"),
        *(F.to_json(F.struct(F.col(g).cast("string").alias("v"))).alias(f"g{i}") for i, g in enumerate(groups)),
        F.col(text).cast("string").alias("_text"),
    )
    kind = dict(picked.dtypes)["doc_key"]
    schema = f"doc_key {kind}, " + "".join(f"g{i} string, " for i in range(len(groups)))
    schema += ", ".join(f"{c} long" for c in (*BASE_COLUMNS, *MORE_COUNTS))
    return picked.mapInPandas(_measured, schema)


def transformed(stats: DataFrame, eligible: Column, prior: int = PRIOR_WORDS) -> DataFrame:
    """Stored ``stats`` with ``FEATURES``; what an ordinary word is, is the median over all eligible rows."""
    n, chars = F.col("n_words"), F.col("word_chars")
    medians = stats.where(eligible & (n > 0) & (chars > 0)).agg(*(F.percentile_approx(c, 0.5, 2000) for c in (chars / n, F.col("n_capitals") / chars, F.col("n_adjacent") / n))).first()
    letters, capitals, adjacent = (float(x or d) for x, d in zip(medians, (5.0, 0.0, 0.0), strict=True))
    more = chars + prior * letters
    root = lambda part, whole: F.sqrt(part / whole)
    return stats.withColumns({
        "f_length": F.log1p(n.cast("double")),
        "f_word": F.log(more / (n + prior)),
        "f_symbol": root(F.col("n_symbols"), more),
        "f_upper": root(F.col("n_capitals") + prior * letters * capitals, more),
        "f_adjacent": root(F.col("n_adjacent") + prior * adjacent, n + prior),
        "f_lines": root(F.col("n_dup_lines"), F.col("n_lines") + prior // 10),
        "f_repeat": root(F.col("n_repeat_words"), n + prior),
    })


def chi2_quantile(q: float, df: int) -> float:
    """Wilson-Hilferty approximation."""
    z = NormalDist().inv_cdf(q)
    return df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3


def distance(features: tuple[str, ...]) -> Column:
    """Squared Mahalanobis distance from the columns ``mu`` and ``prec`` (row-major inverse covariance)."""
    d = [F.col(f) - F.col("mu")[i] for i, f in enumerate(features)]
    p = len(d)
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + d[i] * d[j] * F.col("prec")[i * p + j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


PARAMS = "fit string, start int, mu array<double>, prec array<double>, logdet double"


def _inverted(batches: Iterator[pd.DataFrame], p: int) -> Iterator[pd.DataFrame]:
    """Centre, inverse covariance and log determinant of each group and start from its sums and least deviations."""
    for pdf in batches:
        rows = []
        for fit, start, n, s, q, least in zip(pdf["fit"], pdf["start"], pdf["n"], pdf["s"], pdf["q"], pdf["least"], strict=True):
            mu = np.asarray(s, dtype=float) / n
            cov = np.zeros((p, p))
            cov[np.triu_indices(p)] = np.asarray(q, dtype=float) / n
            cov = cov + np.triu(cov, 1).T - np.outer(mu, mu)
            cov += np.diag(np.maximum(np.square(np.asarray(least, dtype=float)) - np.diag(cov), 0) + TINY)
            rows.append((fit, start, mu.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(rows, columns=["fit", "start", "mu", "prec", "logdet"])


def _share(df: DataFrame, share: float, *sums: Column) -> DataFrame:
    """Running sums over each group's distance bins up to the first bin that reaches ``share`` of its rows."""
    per_bin = df.groupBy("fit", "start", "bin").agg(F.count(F.lit(1)).alias("n_bin"), *sums)
    names = [c for c in per_bin.columns if c not in ("fit", "start", "bin")]
    up = W.partitionBy("fit", "start").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    run = per_bin.select("fit", "start", "bin", *(F.sum(c).over(up).alias(c) for c in names), F.sum("n_bin").over(W.partitionBy("fit", "start")).alias("n_all"))
    first = W.partitionBy("fit", "start").orderBy("bin")
    return run.where(F.col("n_bin") >= F.col("n_all") * share).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "n_all")


def _outer_deviations(fitted: DataFrame, features: tuple[str, ...]) -> list[float]:
    """Per feature the deviation of a normal variable with the first outer quantile (of the distances from the median) that is not zero."""
    median = fitted.agg(*(F.percentile_approx(f, 0.5, 2000) for f in features)).first()
    if median[0] is None:
        return [1.0] * len(features)
    far = fitted.agg(*(F.percentile_approx(F.abs(F.col(f) - m), list(OUTER), 2000) for f, m in zip(features, median, strict=True))).first()
    normal = [NormalDist().inv_cdf((1 + q) / 2) for q in OUTER]
    return [next((x / z for x, z in zip(row, normal, strict=True) if x > 1e-9), 1.0) for row in far]


def robust_outliers(
    stats: DataFrame,
    eligible: Column,
    features: tuple[str, ...] = FEATURES,
    floors: tuple[float, ...] | None = None,
    groups: tuple[str, ...] = ("g0", "g1"),
    support: float = 0.75,
    steps: int = 30,
    subsets: tuple[int, ...] = (3, 17),
    quantile: float = 0.999999,
    min_group: int = 100,
    broadcast_groups: int = 20_000,
    scratch: C.Scratch | None = None,
) -> DataFrame:
    """``stats`` with ``distance`` (scaled squared Mahalanobis, null if nothing was fitted) and ``outlier``.

    ``stats`` must be a stored table: it is read once for each concentration step.  These end when no determinant
    changes by more than ``TOLERANCE``, or after ``steps``.  ``floors``: least deviations, else those of each group.
    """
    spark = stats.sparkSession
    scratch = scratch or C.Scratch(spark)
    fitted = stats.where(eligible)
    sizes = fitted.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    every = stats.select(*groups).distinct().join(sizes, list(groups), "left").na.fill(0, ["n"])
    small = F.col("n") < min_group
    pooled = F.sum(F.when(small, F.col("n")).otherwise(0)).over(W.partitionBy(groups[0]))
    keys = every.select(
        *groups,
        F.when(~small, F.to_json(F.struct(*groups))).when(pooled >= min_group, F.to_json(F.struct(groups[0]))).otherwise(F.lit("all")).alias("fit"),
    )
    keys = scratch.table(keys, "mcd-groups")
    at_most = keys.limit(broadcast_groups + 1).count() <= broadcast_groups
    hint = F.broadcast if at_most else lambda df: df
    rows = stats.join(hint(keys), list(groups))
    fitted = rows.where(eligible)

    p = len(features)
    med = fitted.groupBy("fit").agg(*(F.percentile_approx(f, 0.5, 2000).alias(f"m_{f}") for f in features))
    spread = fitted.join(hint(med), "fit").groupBy("fit").agg(
        *(F.first(f"m_{f}").alias(f"m_{f}") for f in features),
        *(F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{f}")), 0.5, 2000).alias(f"s_{f}") for f in features),
    )
    digits = 9 if floors is None else 3
    if floors is None:
        tails = _outer_deviations(fitted, features)
        leasts = [F.when(F.col(f"s_{f}") > 1e-9, F.col(f"s_{f}") * 1.4826 * LEAST_SHARE).otherwise(tails[i]) for i, f in enumerate(features)]
    else:
        leasts = [F.lit(float(w)) for w in floors]
    inverse = [F.pow(F.greatest(F.round(F.col(f"s_{f}") * 1.4826, digits), w), F.lit(-2.0)) for f, w in zip(features, leasts, strict=True)]
    spread = spread.select(
        "fit",
        F.array(*(F.round(F.col(f"m_{f}"), digits) for f in features)).alias("mu"),
        F.array(*(inverse[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p))).alias("prec"),
        F.array(*leasts).alias("least"),
    )
    spread = scratch.table(spread, "mcd-spread")
    params = spread.select("fit", F.lit(0).alias("start"), "mu", "prec", F.lit(math.inf).alias("logdet"))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(features)]
    sums += [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"q{k}") for k, (i, j) in enumerate(pairs)]
    moments = [F.array(*(f"s{i}" for i in range(p))).alias("s"), F.array(*(f"q{k}" for k in range(len(pairs)))).alias("q")]
    fit_of = lambda df: df.join(hint(spread.select("fit", "least")), "fit").select("fit", "start", "n", *moments, "least").mapInPandas(lambda it: _inverted(it, p), PARAMS)
    # other starts: one row in 32 by hash, if these are enough for a covariance
    residue = F.pmod(F.xxhash64(*features), F.lit(32)).cast("int")
    some = fitted.where(residue.isin(*subsets)).groupBy("fit", residue.alias("start")).agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= 4 * p)
    params = scratch.table(params.unionByName(fit_of(some)), "mcd-starts")
    binned = F.floor(F.log2(distance(features) + 1e-6) * BINS_PER_OCTAVE).cast("int").alias("bin")

    def concentrated(params: DataFrame, step: int) -> DataFrame:
        near = fitted.join(hint(params), "fit").select("fit", "start", *features, binned)
        fresh = scratch.table(fit_of(_share(near, support, *sums).withColumnRenamed("n_bin", "n")), f"mcd-step{step}")
        return fresh

    for step in range(2):
        fresh = concentrated(params, step)
        scratch.drop(params)
        params = fresh
    best = F.min_by(F.struct("start", "mu", "prec", "logdet"), F.struct("logdet", "start")).alias("b")
    fresh = scratch.table(params.groupBy("fit").agg(best).select("fit", "b.*"), "mcd-best")
    scratch.drop(params)
    params = fresh
    for step in range(2, steps):
        fresh = concentrated(params, step)
        before = params.select("fit", F.col("logdet").alias("before"))
        change = fresh.join(hint(before), "fit").agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        scratch.drop(params)
        params = fresh
        if change is None or change < TOLERANCE:
            break
    near = fitted.join(hint(params), "fit").select("fit", "start", binned)
    middle = _share(near, 0.5).select("fit", F.pow(F.lit(2.0), (F.col("bin") + 0.5) / BINS_PER_OCTAVE).alias("middle"))
    final = scratch.table(params.join(middle, "fit").drop("start", "logdet"), "mcd-final")
    scratch.drop(params)
    half = chi2_quantile(0.5, p)
    scaled = distance(features) * (half / F.greatest(F.col("middle"), F.lit(half)))
    out = rows.join(hint(final), "fit", "left").withColumn("distance", scaled)
    return out.withColumn("outlier", F.coalesce(F.col("distance") > chi2_quantile(quantile, p), F.lit(False))).drop("mu", "prec", "middle", "fit")


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source"), **options) -> DataFrame:
    """Base statistics, ``base_failed``, ``distance`` and ``kept`` for every row of ``docs``."""
    scratch = C.Scratch(docs.sparkSession)
    stats = scratch.table(text_statistics(docs, key, text, groups), "quality-statistics")
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    judged = robust_outliers(transformed(stats, ~failed), ~failed, groups=tuple(f"g{i}" for i in range(len(groups))), scratch=scratch, **options)
    return judged.select(
        F.col("doc_key").alias(key), *BASE_COLUMNS,
        failed.alias("base_failed"),
        (~failed & ~F.col("outlier")).alias("kept"),
        F.round("distance", 3).alias("distance"),
    )
