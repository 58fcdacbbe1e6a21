"""Benchmark decontamination: a prefix-filtered set join of documents with item windows.

A window is ``window`` consecutive words of an item (a shorter item is one window) and is a
set of ``shingle``-word shingles.  A document window contains it only if it holds every
shingle, so for containment 1 the necessary prefix is one shingle, and with shingles
ordered by rarity (documents that hold them, over the whole corpus) it is the rarest one.

1. Count, for every shingle of the benchmark, the documents that hold it.
2. Key each item window by its rarest shingle.
3. Join the keys with document positions; the length bound (the document has room for the
   window) and the positional bound (the window starts where the shingle's offset says)
   leave one candidate, whose words are compared one by one.

Documents stay where they are read.  The benchmark is dealt into blocks of at most
``block_windows`` windows, each block is broadcast in turn, its hits are stored and it is
released, so that neither the driver nor a worker ever holds more than one block, however large
the benchmark is; a longer item is dealt to several blocks.  A block costs two scans.

Defined cases: null or empty texts have no words: such documents are clean and such items
occur nowhere.  Very long texts are read whole.  Repeated items and documents each count by
their own rows (items with one id are one item).  An item without id counts for hits and
contamination, but has no id to list, so it does not count among the items.  Items of fewer
words than a shingle are keyed by all their words.  Equally rare shingles: the smaller
fingerprint is the key.  An empty benchmark leaves every document clean; an empty table of
documents gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def item_words(text: object) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return C.encoded(text).translate(C.ALNUM).split()


def item_windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    size = min(window, len(words))
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if size else []


class WindowBlock:
    """The windows of one block of items, by item and start; after ``order`` also by their rarest shingle."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int, shingle: int):
        self.shingle = shingle
        self.items = [name for name, _ in items]
        known: dict[bytes, bytes] = {}
        self.words = [[known.setdefault(w, w) for w in words] for _, words in items]
        self.sizes = [min(window, len(words)) for words in self.words]
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for words, size in zip(self.words, self.sizes, strict=True):
            k = min(shingle, size)
            found[k].append(C.window_hashes(C.word_hashes(words), k))
        #: for each shingle length (below ``shingle`` only for very short items) the sorted fingerprints
        self.wanted = {k: np.unique(np.concatenate(v)) for k, v in found.items()}
        #: for each shingle length, sorted: key, item, start of the window in the item, place of the key in the window
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def present(self, words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """The block's shingles that a document holds, each once: length, and places in ``wanted``."""
        hashes = C.word_hashes(words)
        for k, wanted in self.wanted.items():
            h = C.window_hashes(hashes, k)
            if len(h):
                at = np.searchsorted(wanted, h)
                at[at == len(wanted)] = 0
                yield k, np.unique(at[wanted[at] == h])

    def order(self, documents_with: dict[int, np.ndarray]) -> None:
        """Key every window that can occur at all by its rarest shingle; ties go to the smaller fingerprint."""
        rank, rare = {}, {}
        for k, n in documents_with.items():  # fingerprints ascend and the sort is stable
            rank[k] = np.empty(len(n), dtype=np.int64)
            rank[k][np.argsort(n, kind="stable")] = np.arange(len(n))
            rare[k] = n == 0
        parts: dict[int, list[tuple]] = defaultdict(list)
        for i, (words, size) in enumerate(zip(self.words, self.sizes, strict=True)):
            k = min(self.shingle, size)
            h = C.window_hashes(C.word_hashes(words), k)
            at = np.searchsorted(self.wanted[k], h)
            span = size - k + 1
            r = np.lib.stride_tricks.sliding_window_view(rank[k][at], span)
            place = r.argmin(axis=1)
            start = np.arange(len(place))
            occurs = ~np.lib.stride_tricks.sliding_window_view(rare[k][at], span).any(axis=1)
            parts[k].append((h[start + place][occurs], np.full(occurs.sum(), i), start[occurs], place[occurs]))
        for k, p in parts.items():
            key, item, start, place = (np.concatenate(x) for x in zip(*p, strict=True))
            by = np.argsort(key, kind="stable")
            self.keys[k] = key[by], item[by], start[by], place[by]

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(item, start in the document) of every occurrence of a window, exactly."""
        hashes = C.word_hashes(words)
        for k, (key, item, start, place) in self.keys.items():
            h = C.window_hashes(hashes, k)
            hits = np.flatnonzero(_among(h, key))
            first, last = np.searchsorted(key, h[hits], "left"), np.searchsorted(key, h[hits], "right")
            for at, a, b in zip(hits.tolist(), first.tolist(), last.tolist(), strict=True):
                for e in range(a, b):
                    i, s, begin = int(item[e]), int(start[e]), at - int(place[e])
                    size = self.sizes[i]
                    if begin >= 0 and begin + size <= len(words) and words[begin : begin + size] == self.words[i][s : s + size]:
                        yield i, begin


def _among(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted) or not len(h):
        return np.zeros(len(h), dtype=bool)
    at = np.searchsorted(wanted, h)
    at[at == len(wanted)] = 0
    return wanted[at] == h


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, block_windows: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, streamed to the driver in blocks of at most ``block_windows`` windows; parts of a longer item overlap by a window."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    block, total = [], 0
    for row in rows.toLocalIterator():
        words = item_words(row["t"])
        n = max(1, len(words) - window + 1) if words else 0
        for a in range(0, n, block_windows):
            part = words[a : a + block_windows + window - 1]
            some = max(1, len(part) - window + 1)
            if block and total + some > block_windows:
                yield block
                block, total = [], 0
            block.append((row["i"], part))
            total += some
    if block:
        yield block


def _ordered(texts: DataFrame, rows: list[tuple[str, list[bytes]]], window: int, shingle: int) -> Broadcast:
    """A block with its windows keyed by the rarest shingle over all documents, sent to the executors."""
    spark = texts.sparkSession
    block = WindowBlock(rows, window, shingle)
    counting = spark.sparkContext.broadcast(block)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {k: np.zeros(len(wanted), dtype=np.int64) for k, wanted in counting.value.wanted.items()}
        for pdf in batches:
            for t in pdf["_text"]:
                for k, at in counting.value.present(item_words(t)):
                    totals[k][at] += 1
        for k, n in totals.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"k": np.full(len(at), k, dtype=np.int32), "at": at, "n": n[at]})

    frequency = texts.select("_text").mapInPandas(count, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
    documents_with = {k: np.zeros(len(wanted), dtype=np.int64) for k, wanted in block.wanted.items()}
    for r in frequency.toLocalIterator():  # at most as many rows as the block has shingles
        documents_with[r["k"]][r["at"]] = r["n"]
    block.order(documents_with)
    counting.unpersist()
    return spark.sparkContext.broadcast(block)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shingle: int = 4,
    block_windows: int = 1_000_000,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``hit`` (packed bits of hit words, null if none) and the distinct ``items``."""
    spark = docs.sparkSession
    C.prepare(spark)
    kind = dict(docs.dtypes)[key]
    texts = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def schema_of(df: DataFrame) -> str:
        return ", ".join(f"{c} {t}" for c, t in df.dtypes if c != "_text") + ", n_words long, hit binary, items array<string>"

    def joined(df: DataFrame, sent: Broadcast) -> DataFrame:
        def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b = sent.value
            for pdf in batches:
                counts, hits, items = [], [], []
                for t in pdf.pop("_text"):
                    words = item_words(t)
                    hit, owners = np.zeros(len(words), dtype=bool), set()
                    for i, start in b.occurrences(words):
                        hit[start : start + b.sizes[i]] = True
                        owners.add(i)
                    counts.append(len(words))
                    hits.append(np.packbits(hit).tobytes() if owners else None)
                    items.append(sorted({b.items[o] for o in owners if b.items[o] is not None}))
                yield pdf.assign(n_words=counts, hit=hits, items=items)

        return df.mapInPandas(join, schema_of(df))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(n_words=[len(item_words(t)) for t in pdf.pop("_text")], hit=None, items=[[] for _ in range(len(pdf))])

    blocks = _blocks(benchmark, item, item_text, window, block_windows)
    block = next(blocks, None)
    if block is None:
        return texts.mapInPandas(counted, schema_of(texts))
    following = next(blocks, None)
    if following is None:
        return joined(texts, _ordered(texts, block, window, shingle))
    # several blocks: what each found is stored and put together by id and text, so repeated rows stay apart
    scratch = C.Scratch(spark)
    marked = texts.withColumn("_fp", F.xxhash64(F.coalesce("_text", F.lit(""))))
    found = None
    while block is not None:
        sent = _ordered(texts, block, window, shingle)
        hits = scratch.table(joined(marked, sent).where("hit is not null").dropDuplicates([key, "_fp"]), "contamination-block")
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
        block, following = following, next(blocks, None)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:  # one row of each block
        hit = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in pdf["hit"]]).tobytes()
        row = (pdf[key].iloc[0], pdf["_fp"].iloc[0], hit, sorted({x for names in pdf["items"] for x in names}))
        return pd.DataFrame([row], columns=["_key", "_fp2", "hit", "items"])

    found = found.groupBy(key, "_fp").applyInPandas(merged, f"_key {kind}, _fp2 long, hit binary, items array<string>")
    every = marked.mapInPandas(counted, schema_of(marked)).drop("hit", "items")
    out = every.join(found, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_fp") == F.col("_fp2")), "left")
    return out.select(key, "n_words", "hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_count(hit: bytes | None, n: int) -> int:
    return int(np.unpackbits(np.frombuffer(hit, dtype=np.uint8), count=n).sum()) if hit is not None else 0


def contamination_digest(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per row: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n_hit = [hit_count(h, int(n)) for h, n in zip(pdf.pop("hit"), pdf["n_words"], strict=True)]
            items = pdf.pop("items")
            yield pdf.assign(
                n_hit=n_hit, n_items=[len(x) for x in items],
                items_sha256=[hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                contaminated=[n > 0 for n in n_hit],
            )

    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return contamination(docs, benchmark, key=key, **options).mapInPandas(digest, schema)


def _without(sent: Broadcast):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([next(sent.value.occurrences(item_words(t)), None) is None for t in texts], dtype=bool)

    return clean


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 4, block_windows: int = 1_000_000,
    text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` without its contaminated rows: each row is judged by its own text where it lies, whatever its id."""
    C.prepare(docs.sparkSession)
    scratch = C.Scratch(docs.sparkSession)
    blocks = _blocks(benchmark, item, item_text, window, block_windows)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        sent = _ordered(docs.select(F.col(text).cast("string").alias("_text")), block, window, shingle)
        docs = docs.where(_without(sent)(F.col(text).cast("string")))
        if following is not None:
            docs = scratch.table(docs, "decontaminated")
            sent.destroy()
        block = following
    return docs
