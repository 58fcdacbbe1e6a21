"""Longest repeated runs of words inside a case, of any length: suffix arrays, one per case.

``repeated_windows`` needs the length of a window.  Here the suffixes of a case's words are sorted by prefix
doubling, which takes O(n log n) array operations for n words, and the longest common prefix of two neighbours in
that order is the longest run that occurs twice.  Spark deals out the cases; a task holds one transcript at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of all suffixes in sorted order, and per k the rank of every place by its next 2**k words."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    order = np.argsort(rank, kind="stable")
    while step < n and int(rank.max(initial=0)) < n - 1:
        behind = np.full(n, -1, dtype=np.int64)  # a suffix that ends comes first
        behind[: n - step] = rank[step:]
        key = rank * (n + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        held = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])])
        rank, step = new, 2 * step
        levels.append(rank)
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the next one in sorted order."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    size = np.zeros(max(n - 1, 0), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n) & (np.maximum(a, b) + (1 << k) <= n)
        same = np.flatnonzero(inside)
        same = same[levels[k][a[same]] == levels[k][b[same]]]
        size[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return size


def longest_repeat(codes: np.ndarray) -> tuple[int, int, int, int]:
    """Length, first and second place and number of places of the longest run that occurs twice (they may overlap); of
    several the one that starts first.  Zeros if no word occurs twice."""
    if len(codes) < 2:
        return 0, 0, 0, 0
    order, levels = suffix_order(codes)
    shared = common_prefixes(order, levels)
    most = int(shared.max())
    if most == 0:
        return 0, 0, 0, 0
    joined = np.concatenate([[False], shared >= most, [False]])
    edge = np.flatnonzero(joined[1:] != joined[:-1])
    groups = [np.sort(order[a : b + 1]) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    best = min(groups, key=lambda g: (int(g[0]), int(g[1])))
    return most, int(best[0]), int(best[1]), len(best)


def repeated_runs(segments: DataFrame, case: str = "case_number", segment: str = "segment", text: str = "text") -> DataFrame:
    """Per case: number of words, and of its longest repeated run the length, the words before its first and second
    place, its number of places and its words.

    Words are parted by white space and compared in lower case; a run does not go from one segment into the next.
    Null texts have no words; cases without a repeated word have length 0 and nulls.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\\s+"), lambda x: x != "")
    rows = segments.select(F.col(case).alias("case"), F.struct(F.col(segment).alias("at"), words.alias("words")).alias("s"))
    listed = rows.groupBy("case").agg(F.sort_array(F.collect_list("s")).alias("s")).select("case", F.col("s.words").alias("words"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lists in batch.column("words").to_pylist():
                number: dict[str, int] = {}
                codes, flat = [], []
                for i, part in enumerate(lists):
                    for w in part:
                        codes.append(number.setdefault(w, len(number)))
                        flat.append(w)
                    codes.append(-1 - i)  # parts the segments
                    flat.append("")
                codes_ = np.array(codes, dtype=np.int64)
                length, a, b, n = longest_repeat(codes_)
                real = np.concatenate([[0], np.cumsum(codes_ >= 0)])
                out.append((int(real[-1]), length, int(real[a]) if length else None, int(real[b]) if length else None, n, " ".join(flat[a : a + length]) if length else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("case"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["case", "n_words", "length", "first", "second", "places", "run"])

    kind = dict(listed.dtypes)["case"]
    out = listed.mapInArrow(found, f"case {kind}, n_words long, length long, first long, second long, places long, run string")
    return out.withColumnRenamed("case", case)
