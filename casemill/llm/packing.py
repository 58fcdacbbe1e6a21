"""Packing: each seed document's window is filled with its unused BM25 neighbours.

1. Documents are tokenized where they are read; every full window of a long document is a
   sequence of its own, and what remains (fewer ids than a window) goes on.
2. Term frequencies and the mean length are counted over all remainders (one row per term of
   the vocabulary), so a score means the same in every shard.
3. Remainders are sorted by their heaviest shared terms, then by a hash of id and text, and cut
   into shards of about ``shard_documents``: copies and documents on one subject lie together,
   and a term of many documents is parted by the next terms.
4. In a shard the longest unused remainder is the seed.  Its rarest terms query the shard's
   BM25 index, and unused neighbours that fit are taken in order of score; when none fits
   any more, the best one is cut to fill the window and its rest stays unused.
5. There is a round for each of ``SHARES``.  A window is closed only if neighbours of at least
   that share of the seed's own score fill it; what stays is dealt anew by its next terms, so
   it meets other documents.  The last round takes any neighbour and closes every window.
6. A shard's last, short window is cut into parts whose lengths are powers of two, which need
   no padding.

A seed sees the documents of one shard a round, chosen by content, and not the whole corpus:
the exact BM25 neighbours of all documents would need the postings of every query term for
every seed, which is quadratic.

Defined cases: null and empty texts have only the end id.  Rows that repeat an id are packed
each on its own.  A very long text fills windows of its own; its last part goes on like a short
text.  Of equal scores the smaller id comes first.  An empty table gives no pieces.  Extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import tokenizer

K1, B = 1.2, 0.75
#: Terms of a seed that query the index: those with the largest weights.
QUERY_TERMS = 24
#: Least score of a neighbour, as a share of the seed's own, in each round; the last takes any.
SHARES = (0.5, 0.35, None)
#: Terms that a remainder is sorted by.
KEYS = ("k0", "k1", "k2", "k3", "k4")
#: Of these so many in a row, from the number of the round on.
SORTED_BY = 3
#: Seeds whose scores are computed together.
SEEDS = 64
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


@dataclass(frozen=True)
class Statistics:
    """Of all remainders: their number, mean length and, by term, the number that hold it."""

    n: int
    mean: float
    df: np.ndarray


def described(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its distinct terms and how often it has them."""
    if not texts:
        return []
    flat = np.concatenate(texts).astype(np.int64)
    width = int(flat.max(initial=0)) + 1
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    pair, tf = np.unique(owner * width + flat, return_counts=True)
    ends = np.searchsorted(pair, (np.arange(len(texts)) + 1) * width)
    term, tf = (pair % width).astype(texts[0].dtype), np.minimum(tf, 65535).astype(np.uint16)
    return [(term[i:j], tf[i:j]) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Bm25Shard:
    """Inverted index of one shard: postings (document, weight) by term.

    Weights are those of ``whole``, of the shard's own texts without it.
    """

    def __init__(self, terms: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], whole: Statistics | None = None):
        self.n = n = len(terms)
        sizes = np.array(sizes, dtype=np.int64)
        held = np.array([len(t) for t, _ in terms], dtype=np.int64)
        self.term = np.concatenate([t for t, _ in terms])
        tf = np.concatenate([f for _, f in terms]).astype(np.float64)
        doc = np.repeat(np.arange(n), held)
        df = whole.df if whole else np.bincount(self.term)
        total, mean = (whole.n, whole.mean) if whole else (n, sizes.mean())
        self.df = df[self.term]
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, mean))
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm[doc])
        # each document's query: its heaviest terms
        self.order = np.argsort(doc - self.weight / (1.001 * max(self.weight.max(initial=0), 1e-9)), kind="stable")
        self.begin = np.concatenate([[0], np.cumsum(held)])
        self.doc, self.postings = doc, None

    def _index(self) -> None:
        by_term = np.argsort(self.term, kind="stable")
        self.postings = self.doc[by_term], self.weight[by_term]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(self.term))])

    def scores(self, seeds: list[int]) -> np.ndarray:
        """Score of every document under the query of each seed (seeds x documents)."""
        if self.postings is None:
            self._index()
        docs, weights = self.postings
        begin = self.begin[seeds]
        terms = np.minimum(self.begin[np.asarray(seeds) + 1] - begin, QUERY_TERMS)
        at = np.arange(terms.sum()) + np.repeat(begin - (np.cumsum(terms) - terms), terms)
        row = np.repeat(np.arange(len(seeds)), terms)
        term = self.term[self.order[at]].astype(np.int64)
        first = self.bounds[term]
        held = self.bounds[term + 1] - first
        posting = np.arange(held.sum()) + np.repeat(first - (np.cumsum(held) - held), held)
        cell = np.repeat(row, held) * self.n + docs[posting]
        return np.bincount(cell, weights=weights[posting], minlength=len(seeds) * self.n).reshape(len(seeds), self.n)

    def keys(self, least_df: int) -> np.ndarray:
        """Each document's terms to be sorted by: its heaviest that ``least_df`` documents hold, again from the first where they are fewer."""
        out = np.full((self.n, len(KEYS)), -1, dtype=np.int32)
        shared = self.df[self.order] >= least_df
        for i, (a, b) in enumerate(zip(self.begin[:-1].tolist(), self.begin[1:].tolist(), strict=True)):
            b = min(b, a + QUERY_TERMS)
            terms = self.term[self.order[a:b][shared[a:b]]]
            if len(terms):
                out[i] = np.resize(terms, len(KEYS))
        return out


def pack_shard(texts: list[np.ndarray], window: int, index: Bm25Shard | None = None, share: float | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, from, to) that use every id of every text once.

    With ``share`` only the windows that neighbours of at least this share of the seed's own
    score fill; the rest of each text stays unused.
    """
    index = index or Bm25Shard(described(texts), [len(t) for t in texts])
    used = np.zeros(len(texts), dtype=np.int64)  # ids of each text that are placed
    left = np.array([len(t) for t in texts], dtype=np.int64)
    by_size = np.argsort(-left, kind="stable")
    out: list[list[tuple[int, int, int]]] = []

    def take(sequence: list, doc: int, size: int) -> None:
        sequence.append((doc, int(used[doc]), int(used[doc]) + size))
        used[doc] += size
        left[doc] -= size

    rows: dict[int, np.ndarray] = {}  # scores of the seeds to come, some at a time
    spare: list[int] = []  # documents that were cut, and so are shorter than their place in by_size says
    for place, seed in enumerate(by_size.tolist()):
        if not left[seed] or used[seed]:
            continue
        sequence: list[tuple[int, int, int]] = []
        gap = window - int(left[seed])
        if gap:
            if seed not in rows:
                coming = by_size[place : place + 2 * SEEDS]
                coming = coming[(left[coming] > 0) & (used[coming] == 0)][:SEEDS].tolist()
                rows = dict(zip(coming, index.scores(coming), strict=True))
            score = rows[seed]
            near = (score > 0 if share is None else score >= max(share * score[seed], 1e-12)) & (left > 0)
            near[seed] = False
            found = np.flatnonzero(near)
            if share is not None and left[found].sum() < gap:
                continue
            found = found[np.argsort(-score[found], kind="stable")]
        take(sequence, seed, int(left[seed]))
        if gap:
            for doc in found[left[found] <= gap].tolist():
                size = int(left[doc])
                if size <= gap:
                    take(sequence, doc, size)
                    gap -= size
                    if not gap:
                        break
            if gap:  # cut the best neighbour that is left; without any, the next documents by length
                found = found[left[found] > 0]
                rest = found.tolist() or [d for d in spare if left[d]] or [int(d) for d in by_size[left[by_size] > 0][:window]]
                for doc in rest:
                    size = min(gap, int(left[doc]))
                    take(sequence, doc, size)
                    gap -= size
                    if left[doc]:
                        spare.append(doc)
                    if not gap:
                        break
        out.append(sequence)
    if share is not None:
        return out
    # what was cut and not used again
    tail = [d for d in dict.fromkeys(spare) if left[d]]
    sequence, gap = [], window
    for doc in tail:
        while left[doc]:
            size = min(gap, int(left[doc]))
            take(sequence, doc, size)
            gap -= size
            if not gap:
                out.append(sequence)
                sequence, gap = [], window
    if sequence:
        out.append(sequence)
    return [part for s in out for part in powers_of_two(s, window)]


def powers_of_two(sequence: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """A short sequence as parts of lengths 2^k, largest first; a full one as it is."""
    total = sum(b - a for _, a, b in sequence)
    if total == window:
        return [sequence]
    out, part, room = [], [], 1 << (total.bit_length() - 1)
    for doc, a, b in sequence:
        while a < b:
            size = min(room, b - a)
            part.append((doc, a, a + size))
            a, room, total = a + size, room - size, total - size
            if not room:
                out.append(part)
                part, room = [], 1 << (total.bit_length() - 1) if total else 0
    return out


def statistics(rest: DataFrame, wide: np.dtype) -> Statistics:
    """Statistics of the remainders; to the driver come at most as many rows as there are terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, dtype=np.int64)
        for batch in batches:
            more = np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype=wide), minlength=len(df))
            more[: len(df)] += df
            df = more
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    rows = rest.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(int(rows["term"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    df[rows["term"]] = rows["df"]
    n, mean = rest.agg(F.count(F.lit(1)), F.avg("length")).first()
    return Statistics(n, mean or 0.0, df)


def pack(
    docs: DataFrame, path: str, space_leads: bool = True, end_id: int = 0, window: int = 1024,
    key: str = "doc_id", text: str = "text", shard_documents: int = 2000, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset`` and the ids themselves (little-endian; null unless ``with_ids``)."""
    spark = docs.sparkSession
    C.prepare(spark)
    scratch = C.Scratch(spark)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(key), F.col(text)).alias("mark"), F.col(text).cast("string").alias("text"))
    wide = np.dtype(tokenizer(path, space_leads).dtype)

    def terms_of(terms: list[bytes], tfs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.frombuffer(t, dtype=wide), np.frombuffer(f, dtype=np.uint16)) for t, f in zip(terms, tfs, strict=True)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, space_leads)
        task = TaskContext.get().partitionId() << 32
        sequence = row = task
        for batch in batches:
            out, ends = [], []
            for i, ids in enumerate(t.many(batch.column("text"))):
                ids = np.append(ids, np.array(end_id, dtype=wide))
                whole = len(ids) // window * window
                for a in range(0, whole, window):
                    piece = ids[a : a + window]
                    out.append((i, row, False, a, window, crc(piece), len(ids), sequence, 0, piece.astype("<u4").tobytes() if with_ids else None, None, None))
                    sequence += 1
                if whole < len(ids):
                    ends.append((i, row, True, whole, len(ids) - whole, None, len(ids), None, None, ids[whole:]))
                row += 1
            for e, (terms, tf) in zip(ends, described([e[-1] for e in ends]), strict=True):
                out.append((*e[:-1], e[-1].tobytes(), terms.tobytes(), tf.tobytes()))
            which, *columns = zip(*out, strict=True) if out else [()] * 12
            which = pa.array(which, pa.int64())
            types = [pa.int64(), pa.bool_()] + [pa.int64()] * 6 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(which), batch.column("mark").take(which), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))],
                names=["doc", "mark", "row", "open", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "terms", "tf"],
            )

    described_by = "terms binary, tf binary"
    pieces = rows.mapInArrow(cut, f"doc {kind}, mark long, row long, open boolean, {PIECE}, {described_by}")
    pieces = scratch.table(pieces, "pieces", "open")
    columns = [c.split()[0] for c in PIECE.split(", ")]
    full = pieces.where("not open").select("doc", *columns)
    rest = pieces.where("open")
    sent = spark.sparkContext.broadcast(statistics(rest, wide))
    least_df = max(2, shard_documents // 16)
    sort_by = ", ".join(f"{k} int" for k in KEYS)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                terms = terms_of(batch.column("terms").to_pylist(), batch.column("tf").to_pylist())
                keys = Bm25Shard(terms, [len(x) // wide.itemsize for x in batch.column("ids").to_pylist()], sent.value).keys(least_df)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(k) for k in keys.T)], names=[*batch.schema.names, *KEYS])

    def filler(turn: int, share: float | None):
        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shard = [b for b in batches if len(b)]  # about shard_documents rows
            if not shard:
                return
            pdf = pd.concat(shard).sort_values(["doc", "mark", "row", "start"], kind="stable").reset_index(drop=True)
            texts = [np.frombuffer(x, dtype=wide) for x in pdf["ids"]]
            docs_, marks, rows_, starts, totals, terms, tfs = (pdf[c].tolist() for c in ("doc", "mark", "row", "start", "doc_tokens", "terms", "tf"))
            index = Bm25Shard(terms_of(terms, tfs), [len(t) for t in texts], sent.value)
            used, out = [0] * len(texts), []
            number = (1 << 62) + (turn << 58) + (TaskContext.get().partitionId() << 24)
            for k, s in enumerate(pack_shard(texts, window, index, share)):
                offset = 0
                for d, a, b in s:
                    piece = texts[d][a:b]
                    out.append((docs_[d], marks[d], rows_[d], False, starts[d] + a, b - a, crc(piece), totals[d], number + k, offset, piece.astype("<u4").tobytes() if with_ids else None, None, None, *[None] * len(KEYS)))
                    offset += b - a
                    used[d] = b
            if share is not None:
                keys = pdf[list(KEYS)].to_numpy().tolist()
                out += [
                    (docs_[d], marks[d], rows_[d], True, starts[d] + a, len(texts[d]) - a, None, totals[d], None, None, texts[d][a:].tobytes(), terms[d], tfs[d], *keys[d])
                    for d, a in enumerate(used) if a < len(texts[d])
                ]
            names = ["doc", "mark", "row", "open", *columns, "terms", "tf", *KEYS]
            whole = {c: "Int64" for c in ("ids_crc32", "sequence_id", "offset")} | {k: "Int32" for k in KEYS}
            yield pd.DataFrame({c: pd.Series(v, dtype=whole.get(c)) for c, v in zip(names, zip(*out, strict=True), strict=True)})

        return fill

    needed = ("doc", "mark", "row", "start", "doc_tokens", "ids", "terms", "tf")
    types = dict(rest.dtypes)
    remaining = rest.select(*needed).mapInArrow(keyed, ", ".join(f"{c} {types[c]}" for c in needed) + f", {sort_by}")
    out, n = full, sent.value.n
    for turn, share in enumerate(SHARES):
        # rows that repeat id and text differ by their number, so a shard never grows with them
        dealt = remaining.repartitionByRange(max(1, -(-n // shard_documents)), *KEYS[turn : turn + SORTED_BY], "mark", "row")
        filled = dealt.mapInPandas(filler(turn, share), f"doc {kind}, mark long, row long, open boolean, {PIECE}, {described_by}, {sort_by}")
        if share is not None:
            filled = scratch.table(filled, f"round-{turn}", "open")
            remaining = filled.where("open").select(*needed, *KEYS)
            n = remaining.count()
        out = out.unionByName(filled.where("not open").select("doc", *columns))
    out = out.withColumnRenamed("doc", key)
    return out if with_ids else out.drop("ids")
