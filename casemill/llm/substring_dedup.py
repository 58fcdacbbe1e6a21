"""Substring dedup: relative Lempel-Ziv parsing against an index of reference blocks.

The reference of a document is every document with a smaller id.  Its index is dealt by hash
into blocks (the shuffle partitions) of *anchors*: the anchor of a phrase of ``window``
words is the least fingerprint among its ``anchor``-word shingles, so equal phrases have
equal anchors and one anchor stands for about ``(window - anchor + 2) / 2`` phrases.

1. The first document of each anchor is its reference; anchors of one document only drop
   out (a bitmap keeps them from being shuffled again, an exact join follows).
2. Every document's phrases meet the reference's phrases of their anchor, with their places, in
   the anchor's block.  Phrases that the first document does not hold are looked up in a second
   index, by phrase: the first document that holds one, and where.
3. ``factors`` parses each document greedily: a factor starts at a phrase with a reference and
   goes on as long as the next word of the text is the next word of the same reference document;
   it is (start, end, reference document, start there).  Where it ends, the phrases across the
   boundary have references of their own, so factors overlap there and no duplicate is lost.  A
   factor has at least ``window`` words, and all factors become duplicate spans.

An anchor of a third of all documents has one reference row; the other side of that join is
split by adaptive execution, and both indexes are built by partial aggregation.  A lookup sorts
the reference's phrases once, so a text that repeats a phrase costs no more than its length.

Defined cases: null or empty texts and texts of fewer than ``window`` words lose nothing.
Very long texts are parsed whole.  Exact copies lose all words but in the document of smallest
id.  Rows that repeat an id are one document: they are no earlier reference for each other, and
a place is in one of their texts.  A row without id comes after all others and is a reference
for none.  A phrase that the reference repeats is found at its first place.  An empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SLICE = 1 << 22


def _text_mark(text: str) -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(2_147_483_647)).cast("int")


def phrases(words: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and anchor of the phrase at every start."""
    hashes = C.word_hashes(words)
    whole = C.window_hashes(hashes, window)
    if not len(whole):
        return whole, whole
    short = C.window_hashes(hashes, anchor)
    least = short[: len(whole)].copy()
    for j in range(1, window - anchor + 1):
        np.minimum(least, short[j : j + len(whole)], out=least)
    return whole, least


def _anchors(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, rows = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            _, least = phrases(C.encoded(text).split(), window, anchor)
            if len(least):
                u = np.unique(least)
                found.append(u)
                rows.append(np.full(len(u), i, dtype=np.int64))
        if found:
            doc = batch.column("doc").take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), doc], names=["anchor", "doc"])


def _flagged(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """One bit for each anchor, in slices."""
    slices: dict[int, np.ndarray] = {}
    for pdf in batches:
        at = pdf["anchor"].to_numpy().astype(np.int64).view(np.uint64) & np.uint64(bits - 1)
        number, inside = (at // np.uint64(SLICE)).astype(np.int64), (at % np.uint64(SLICE)).astype(np.int64)
        for k in np.unique(number):
            slices.setdefault(int(k), np.zeros(SLICE // 8, dtype=np.uint8))
            here = inside[number == k]
            np.bitwise_or.at(slices[int(k)], here >> 3, (1 << (here & 7)).astype(np.uint8))
    yield pd.DataFrame([(k, v.tobytes()) for k, v in slices.items()], columns=["slice", "bits"])


def _candidates(batches: Iterator[pa.RecordBatch], window: int, anchor: int, flags) -> Iterator[pa.RecordBatch]:
    """For each document and anchor that may be shared: the phrases' fingerprints and starts."""
    bits = flags.value
    mask = np.uint64(len(bits) * 8 - 1)
    for batch in batches:
        keys, rows, sizes, starts, prints = [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            whole, least = phrases(C.encoded(text).split(), window, anchor)
            if not len(whole):
                continue
            at = least & mask
            hit = np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            if not len(hit):
                continue
            order = hit[np.argsort(least[hit], kind="stable")]
            key, first = np.unique(least[order], return_index=True)
            keys.append(key)
            rows.append(np.full(len(key), i, dtype=np.int64))
            sizes.append(np.diff(np.append(first, len(order))))
            starts.append(order)
            prints.append(whole[order])
        if not keys:
            continue
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
        which = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(keys).view(np.int64)), batch.column("doc").take(which), batch.column("fp").take(which),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(starts).astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prints).view(np.int64))),
            ],
            names=["anchor", "doc", "fp", "at", "w"],
        )


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's phrases that its reference has (``hit``, and ``there``, the place) and those that it has not (``at``, ``w``)."""

    def flat(column: pa.ListArray, dtype) -> tuple[np.ndarray, np.ndarray]:
        values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
        return values, np.repeat(np.arange(len(column)), pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))

    def lists(rows: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
        offsets = pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        (w, row), (at, _) = flat(batch.column("w"), np.int64), flat(batch.column("at"), np.int32)
        (ref, ref_row), (place, _) = flat(batch.column("ref_w"), np.int64), flat(batch.column("ref_at"), np.int32)
        salt = lambda v, r: v.view(np.uint64) + C.mixed(r.astype(np.uint64) + np.uint64(1))  # noqa: E731  # rows of the batch stay apart
        known = salt(ref, ref_row)
        order = np.lexsort((place, known))
        known, place = known[order], place[order]
        key = salt(w, row)
        found = np.searchsorted(known, key)  # the first place
        found[found == len(known)] = 0
        hit = known[found] == key if len(known) else np.zeros(len(key), dtype=bool)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"), batch.column("fp"), batch.column("first"),
                *lists(row[hit], n, at[hit], place[found[hit]]), *lists(row[~hit], n, at[~hit], w[~hit]),
            ],
            names=["doc", "fp", "first", "hit", "there", "at", "w"],
        )


def factors(starts: np.ndarray, refs: np.ndarray, places: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, reference, start there) in words from the matched phrases of a text, in order of start.

    A factor goes on while the next phrase is found one word further in the same reference.
    """
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, r, p = starts[order], refs[order], places[order]
    breaks = np.flatnonzero((np.diff(s) != 1) | (np.diff(r) != 0) | (np.diff(p) != 1))
    first, last = np.append(0, breaks + 1), np.append(breaks, len(s) - 1)
    return list(zip(s[first].tolist(), (s[last] + window).tolist(), r[first].tolist(), p[first].tolist(), strict=True))


def phrase_references(docs: DataFrame, window: int = 13, anchor: int = 6, most_bits: int = 1 << 30, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, fp, parts``: the phrases of each document that an earlier document holds, as lists
    of starts and of places in the reference ``first``."""
    spark = docs.sparkSession
    C.prepare(spark)
    scratch = C.Scratch(spark)
    texts = docs.select(F.col(key).alias("doc"), _text_mark(text).alias("fp"), F.col(text).cast("string").alias("text"))
    kind = dict(texts.dtypes)["doc"]

    anchors = texts.select("doc", "text").mapInArrow(lambda it: _anchors(it, window, anchor), f"anchor long, doc {kind}")
    index = anchors.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("loose"))
    index = scratch.table(index.where("first is not null and (first < last or loose)").select("anchor", "first"), "anchor-index")

    # about eight bits for each anchor, and 2^30 (128 MB) at most; the join below is exact in any case
    bits = min(max(SLICE, 1 << (8 * index.count()).bit_length()), most_bits)
    flags = np.zeros(bits // 8, dtype=np.uint8)
    width = SLICE // 8
    number = F.shiftright(F.col("anchor").bitwiseAND(F.lit(bits - 1)), SLICE.bit_length() - 1)
    sliced = index.select("anchor").repartition(max(1, bits // SLICE), number).mapInPandas(lambda it: _flagged(it, bits), "slice int, bits binary")
    for r in sliced.toLocalIterator():
        flags[r["slice"] * width : (r["slice"] + 1) * width] |= np.frombuffer(r["bits"], dtype=np.uint8)
    sent = spark.sparkContext.broadcast(flags)

    found = texts.mapInArrow(lambda it: _candidates(it, window, anchor, sent), f"anchor long, doc {kind}, fp int, at array<int>, w array<long>")
    found = scratch.table(found.join(index, "anchor"), "phrases")
    later = F.coalesce(F.col("doc") > F.col("first"), F.lit(True))
    # one row, or the rows of a repeated id
    reference = found.where(F.col("doc") == F.col("first")).groupBy("anchor").agg(F.flatten(F.collect_list("w")).alias("ref_w"), F.flatten(F.collect_list("at")).alias("ref_at"))
    met = found.where(later).join(reference, "anchor").select("doc", "fp", "first", "at", "w", "ref_w", "ref_at")
    met = met.mapInArrow(_looked_up, f"doc {kind}, fp int, first {kind}, hit array<int>, there array<int>, at array<int>, w array<long>")
    met = scratch.table(met, "looked-up")
    scratch.drop(found)
    rest = met.where(F.size("w") > 0).select("doc", "fp", F.explode(F.arrays_zip("at", "w")).alias("x")).select("doc", "fp", "x.at", "x.w")
    first = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "at"))).alias("one")  # a row without id is no reference
    second = rest.groupBy("w").agg(first, F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("loose"))
    second = second.where("one is not null and (one.doc < last or loose)").select("w", F.col("one.doc").alias("first"), F.col("one.at").alias("there"))
    more = rest.join(second, "w").where(later).groupBy("doc", "fp", "first").agg(F.collect_list("at").alias("hit"), F.collect_list("there").alias("there"))
    hits = met.where(F.size("hit") > 0).select("doc", "fp", "first", "hit", "there").unionByName(more)
    return hits.groupBy("doc", "fp").agg(F.collect_list(F.struct("first", "hit", "there")).alias("parts"))


def remove_spans(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: id, ``n_words``, ``factors`` (start, end in words, reference document and start there) and the kept words joined by spaces."""
    parts = phrase_references(docs, window, key=key, text=text, **options)
    parts = parts.select(F.col("doc").alias("_doc"), F.col("fp").alias("_fp"), F.col("parts").alias("_parts"))
    rows = docs.select(key, F.col(text).cast("string").alias("_text"), _text_mark(text).alias("_own"))
    rows = rows.join(parts.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_fp")), "left").select(key, "_text", "_parts")
    kind = dict(docs.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, kept = [], [], []
            for t, found in zip(batch.column("_text").to_pylist(), batch.column("_parts"), strict=True):
                words = C.encoded(t).split()
                keep = None
                own = []
                if found.is_valid:
                    number: dict = {}
                    parts = found.values
                    size = pa.compute.list_value_length(parts.field("hit")).to_numpy(zero_copy_only=False)
                    refs = np.repeat([number.setdefault(x, len(number)) for x in parts.field("first").to_pylist()], size)
                    names = list(number)
                    own = factors(parts.field("hit").flatten().to_numpy(), refs, parts.field("there").flatten().to_numpy(), window)
                    keep = np.ones(len(words), dtype=bool)
                    for a, b, _, _ in own:
                        keep[a:b] = False
                    own = [{"start": a, "end": b, "ref": names[r], "ref_start": p} for a, b, r, p in own]
                counts.append(len(words))
                spans.append(own)
                kept.append(b" ".join(words if keep is None else [words[i] for i in np.flatnonzero(keep).tolist()]).decode("utf-8", "surrogatepass"))
            of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref", batch.schema.field(key).type), ("ref_start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64()), pa.array(spans, of), pa.array(kept, pa.string())], names=[key, "n_words", "factors", "kept"])

    return rows.mapInArrow(cut, f"{key} {kind}, n_words long, factors array<struct<start:int,end:int,ref:{kind},ref_start:int>>, kept string")


def removal_digest(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed`` and ``kept_sha256``."""
    out = remove_spans(docs, key=key, **options)
    kept_words = F.when(F.col("kept") == "", 0).otherwise(F.length("kept") - F.length(F.replace("kept", F.lit(" "), F.lit(""))) + 1)
    return out.select(key, "n_words", (F.col("n_words") - kept_words).cast("long").alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
