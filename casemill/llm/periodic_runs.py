"""Periodic runs of words inside a document, caught online by dyadic square catchers.

A square is a stretch ``u u``; with ``|u| = q`` and ``2B <= q < 4B`` for a power of two B, its
first half holds a whole block of B words that starts at a multiple of B, and the same B words
stand q places later.  So for every completed block there is a catcher, which waits for its words
to come again at a distance of 2B to 4B.  ``SquareCatcher.append`` takes one more word or many:
each new word ends one suffix of B words per level, and that suffix is compared with the (exactly
two) catchers whose distance fits.  What a catcher reports is compared word by word to both sides;
if it is a square, it merges into the maximal run of its period.  (q = 1 compares neighbours.)

A level costs two comparisons a word, so a text of n words costs O(n log n) whatever repeats in
it; squares inside a known run whose period divides theirs are skipped.  Suffixes are compared by
fingerprint, reported stretches by the words themselves, so that runs are exact.

Spark deals out the documents; a task appends those of a batch one behind another, parted by
words that occur nowhere else, so that short texts share the array operations.  Nothing is shuffled.

Defined cases: null, empty and blank texts have no words and no runs.  Rows without id and repeated
rows are judged each for itself.  Very long texts are read whole.  Of runs that cover the same words
the smallest period counts; ties of the exponent go to the smaller start, then the smaller period.
Extra columns, whatever their names, don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

RUN = "array<struct<start:long,length:long,period:long>>"
#: Words a task appends together; a longer text is appended alone.
BATCH_WORDS = 200_000
_STEPS = 8


class SquareCatcher:
    """Words so far, per level the fingerprints of the last B words, and the runs found.

    ``runs()`` gives ``(start, end, period)`` of every maximal stretch that holds a square, with its
    smallest period.  Words are numbers; equal numbers are equal words.  How the words are dealt
    over calls of ``append`` makes no difference.
    """

    def __init__(self, longest: int | None = None):
        self.longest = longest  # no period above this one is looked for
        self.words = np.empty(0, dtype=np.int64)
        self.levels: list[tuple[int, np.ndarray]] = []  # first place kept, fingerprints of the 2**k words from each place on
        self.found: dict[int, list[tuple[int, int]]] = {}  # period -> (start, end), by start
        self.open: list[tuple[int, int]] = []  # reports (start, period) that agree up to the last word

    def append(self, words: np.ndarray) -> None:
        old = len(self.words)
        self.words = np.concatenate([self.words, np.asarray(words, dtype=np.int64)])
        n = len(self.words)
        for q, ends in self.found.items():  # runs that reached the end may go on
            if ends[-1][1] == old < n:
                ends[-1] = (ends[-1][0], self._right(old - q, q))
        if self.open:
            reports, self.open = np.array(sorted(set(self.open)), dtype=np.int64), []
            self._report(reports[:, 0], reports[:, 1])
        places = np.arange(max(old, 1), n)
        self._report(places[self.words[places] == self.words[places - 1]] - 1, 1)
        b, k = 1, 0
        while 3 * b <= n and (self.longest is None or 2 * b <= self.longest):
            first, names = self._grown(k, n)
            ends = np.arange(max(old - b + 1, 2 * b), n - b + 1)  # suffixes that the new words end
            near = (ends - 2 * b) // b * b  # the latest block at a distance of 2b or more
            for block in (near, near - b):
                at = np.flatnonzero((block >= 0) & (names[np.maximum(block - first, 0)] == names[ends - first]))
                self._report(block[at], ends[at] - block[at])
            b, k = 2 * b, k + 1
        for k, (first, names) in enumerate(self.levels):  # what later words look back to
            self._forget(k, first, names)

    def _forget(self, k: int, first: int, names: np.ndarray) -> None:
        spare = len(names) - (6 << k)
        if spare > 0:
            self.levels[k] = (first + spare, names[spare:].copy())

    def _grown(self, k: int, n: int) -> tuple[int, np.ndarray]:
        if k == len(self.levels):
            self.levels.append((0, np.empty(0, dtype=np.uint64)))
        first, names = self.levels[k]
        known, b = first + len(names), 1 << k
        if k == 0:
            new = C.mixed(self.words[known:].astype(np.uint64) * C.MULTIPLIER + np.uint64(1))
        else:
            half = b // 2
            low, below = self.levels[k - 1]
            heads = below[known - low : n - b + 1 - low]
            new = C.mixed(heads * C.MULTIPLIER + below[known + half - low : n - b + 1 + half - low])
            self._forget(k - 1, low, below)
        self.levels[k] = (first, np.concatenate([names, new]))
        return self.levels[k]

    def _report(self, starts: np.ndarray, periods: np.ndarray | int) -> None:
        """Words from ``starts`` on come again after ``periods``: extend to both sides, keep squares."""
        q = np.broadcast_to(np.asarray(periods, dtype=np.int64), np.shape(starts))
        if self.longest is not None:
            starts, q = starts[q <= self.longest], q[q <= self.longest]
        if len(starts) > 64:
            new = ~self._periodic(starts, q)
            starts, q = starts[new], q[new]
        if not len(starts):
            return
        if len(starts) > 64 and int(q.max()) <= 3:  # many reports of few periods: one comparison of all places each
            for p in np.unique(q).tolist():
                self._whole(p)
            return
        order = np.lexsort((starts, q))
        starts, q = starts[order].astype(np.int64), q[order]
        words, n = self.words, len(self.words)
        left, right = starts.copy(), starts.copy()
        live = np.arange(len(starts))
        for _ in range(_STEPS):  # most chance repeats end after a word or two
            live = live[right[live] + q[live] < n]
            live = live[words[right[live]] == words[right[live] + q[live]]]
            right[live] += 1
        going = np.zeros(len(starts), dtype=bool)
        going[live] = True
        live = np.arange(len(starts))
        for _ in range(_STEPS):
            live = live[left[live] > 0]
            live = live[words[left[live] - 1] == words[left[live] - 1 + q[live]]]
            left[live] -= 1
        going[live] = True
        for i in np.flatnonzero(going | (right - left >= q) | (right + q >= n)).tolist():
            self._keep(int(starts[i]), int(q[i]))

    def _periodic(self, starts: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Reports inside a known run whose period divides theirs, long enough that theirs can't go beyond it."""
        period = np.ones(len(self.words), dtype=np.int64)
        begin, end = np.zeros_like(period), np.zeros_like(period)
        for p in sorted(self.found, reverse=True):
            for a, b in self.found[p]:
                if b - a >= 8:
                    period[a:b], begin[a:b], end[a:b] = p, a, b
        p, b = period[starts], end[starts]
        return (q % p == 0) & (starts + q < b) & (b - begin[starts] >= q + p)

    def _whole(self, q: int) -> None:
        same = np.concatenate([[False], self.words[:-q] == self.words[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= q:
                if not self._inside(a, b + q, q):
                    self._add(a, b + q, q)
            elif b + q == len(self.words):
                self.open.append((a, q))

    def _keep(self, start: int, q: int) -> None:
        ends = self.found.get(q)
        if ends:
            at = self._before(ends, start)
            if at >= 0 and ends[at][1] >= start + q:  # the run of this period that holds the report is known
                return
        a, b = self._left(start, q), self._right(start, q)
        if b - a < 2 * q:
            if b == len(self.words):
                self.open.append((start, q))
        elif not self._inside(a, b, q):
            self._add(a, b, q)

    @staticmethod
    def _before(ends: list[tuple[int, int]], start: int) -> int:
        low, high = 0, len(ends)
        while low < high:
            mid = (low + high) // 2
            if ends[mid][0] <= start:
                low = mid + 1
            else:
                high = mid
        return low - 1

    def _inside(self, a: int, b: int, q: int) -> bool:
        """Whether a run of a period that divides ``q`` holds the words from ``a`` to ``b``."""
        for p, ends in self.found.items():
            if p < q and q % p == 0:
                at = self._before(ends, a)
                if at >= 0 and ends[at][1] >= b:
                    return True
        return False

    def _add(self, a: int, b: int, q: int) -> None:
        ends = self.found.setdefault(q, [])
        at = self._before(ends, a)
        if at >= 0 and ends[at][0] == a:
            ends[at] = (a, max(b, ends[at][1]))
        else:
            ends.insert(at + 1, (a, b))

    def _right(self, at: int, q: int) -> int:
        """End of the stretch of period ``q`` that holds the words at ``at`` and ``at + q``."""
        words, n, step = self.words, len(self.words), 32
        while at + q < n:
            stop = min(at + step, n - q)
            wrong = np.flatnonzero(words[at:stop] != words[at + q : stop + q])
            if len(wrong):
                return at + int(wrong[0]) + q
            at, step = stop, 2 * step
        return n

    def _left(self, at: int, q: int) -> int:
        words, step = self.words, 32
        while at > 0:
            low = max(at - step, 0)
            wrong = np.flatnonzero(words[low:at] != words[low + q : at + q])
            if len(wrong):
                return low + int(wrong[-1]) + 1
            at, step = low, 2 * step
        return 0

    def runs(self) -> list[tuple[int, int, int]]:
        """By start, then period; of stretches with the same words only the smallest period."""
        least: dict[tuple[int, int], int] = {}
        for q in sorted(self.found):
            for a, b in self.found[q]:
                least.setdefault((a, b), q)
        return sorted((a, b, q) for (a, b), q in least.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=len(words))


def runs_of(texts: list[list[bytes]], least_length: int, least_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Of each list of words the runs ``(start, length, period)`` of the given least size, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    base = np.cumsum([0] + [len(w) + 1 for w in texts])
    longest = max(map(len, texts), default=0) // max(least_exponent, 2)
    if longest == 0:
        return out
    row = np.empty(int(base[-1]), dtype=np.int64)
    codes = numbered([w for t in texts for w in t])
    at = 0
    for i, w in enumerate(texts):
        row[base[i] : base[i] + len(w)] = codes[at : at + len(w)]
        row[base[i] + len(w)] = -1 - i  # occurs once
        at += len(w)
    catcher = SquareCatcher(longest)
    catcher.append(row)
    for a, b, q in catcher.runs():
        if b - a >= max(least_length, least_exponent * q):
            i = int(np.searchsorted(base, a, side="right")) - 1
            out[i].append((a - int(base[i]), b - a, q))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Without those that a run holds after its first period."""
    if not runs:
        return words
    delta = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        delta[start + period] += 1
        delta[start + length] -= 1
    return [w for w, c in zip(words, np.cumsum(delta[:-1]).tolist(), strict=True) if not c]


def find_runs(docs: DataFrame, least_length: int = 24, least_exponent: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``runs`` (start and length in words, smallest period) and ``collapsed``,
    the words left when each run keeps its first period only, joined by one space."""
    if least_exponent < 2:
        raise ValueError("a run holds a square")
    C.prepare(docs.sparkSession)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            runs, collapsed, group, size = [], [], [], 0

            def flush() -> None:
                for words, r in zip(group, runs_of(group, least_length, least_exponent), strict=True):
                    runs.append([{"start": a, "length": n, "period": q} for a, n, q in r])
                    collapsed.append(b" ".join(kept_words(words, r)).decode("utf-8", "surrogatepass"))

            for t in texts:
                words = C.white_words(C.encoded(t))
                if group and size + len(words) > BATCH_WORDS:
                    flush()
                    group, size = [], 0
                group.append(words)
                size += len(words)
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(runs, pa.list_(kind)), pa.array(collapsed, pa.string())], names=["doc", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    rows = rows.mapInArrow(found, f"doc {dict(rows.dtypes)['doc']}, runs {RUN}, collapsed string")
    return rows.select(F.col("doc").alias(key), "runs", "collapsed")


def repeated_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with periods planted by a rule: with h the CRC of the decimal id, g = h / 10 and n words, a
    text with h divisible by 10 repeats from word a = g % n on the p = 1 + (n - a) / (3 + g % 8) words that follow."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = F.when(h % 10 == 0, words)
    names = {k: C.fresh(docs, k) for k in ("tail_words", "tail_g")}
    w, g = F.col(names["tail_words"]), F.col(names["tail_g"])
    n = F.size(w)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (1 + a + (i - a) % p).cast("int"))))
    out = docs.withColumns({names["tail_words"]: split, names["tail_g"]: F.floor(h / 10)})
    return out.withColumn(text, F.when(n > 0, F.array_join(again, " ")).otherwise(F.col(text))).drop(*names.values())


def _stronger(best: Column, run: Column) -> Column:
    more = run["length"] * best["period"] > best["length"] * run["period"]
    return F.when(best.isNull() | more, run).otherwise(best)


def run_digest(docs: DataFrame, least_length: int = 24, least_exponent: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_runs``, the run of the greatest exponent, and digests of all runs and of the collapsed text."""
    found = find_runs(docs, least_length, least_exponent, key, text)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("best")
    return found.withColumn("best", F.aggregate("runs", none, _stronger)).select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
