"""Line dedup: range-partitioned line hashes, streamed with a secondary sort.

Every document yields one row for each distinct line key (128-bit hash) with the positions
it holds.  The rows are range-partitioned by (key, document), so that even one key with a
third of all rows is spread over partitions, sorted by key and document, and streamed:
each partition decides the keys that lie inside it and holds back at most ``min_docs - 1``
rows of a key that touches its edge.  One marker row for each edge key and partition gives
the totals that settle those.  The result is a zlib-compressed bitmap of kept lines per
document; ``apply_bitmaps`` turns bitmaps and documents into text.

Defined cases: null and empty texts are one empty line, which has no key and stays.  Lines
whose key has fewer than ``min_chars`` code points stay.  Repeated rows (the same id and
text) count as one document and each gets the result; the same id with another text is
judged by its own lines.  A null id is an id like any other.  Very long texts are read whole.  Ties in
the order of a key's documents are rows of one id, ordered by text.  An empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import common as C


def line_keys(text: object, min_chars: int = 1) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and the positions of each key's hash: stripped of white space, A-Z lower-cased."""
    found: dict[bytes, list[int]] = {}
    lines = C.encoded(text).translate(C.LOWER).split(b"\n")
    for i, line in enumerate(lines):
        key = line.strip(b" \t\n\x0b\x0c\r")
        if key and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            found.setdefault(C.digest128(key), []).append(i)
    return len(lines), found


def _keyed(batches: Iterator[pd.DataFrame], min_chars: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, fp, text in zip(pdf["doc"], pdf["fp"], pdf["text"], strict=True):
            n, found = line_keys(text, min_chars)
            out += [(key, doc, fp, n, at) for key, at in found.items()]
        yield pd.DataFrame(out, columns=["key", "doc", "fp", "n_lines", "at"])


def _streamed(batches: Iterator[pd.DataFrame], min_docs: int, keep_first: bool) -> Iterator[pd.DataFrame]:
    """Decide runs of equal keys; hold no more than ``min_docs`` documents of a run.

    Emits rows to drop (``state`` 0), rows left to the totals (1; 2 if it is the partition's
    first row of the key) and one marker with the partition's count for each edge key (3).
    """
    part = TaskContext.get().partitionId()
    columns = ["state", "key", "part", "n_docs", "doc", "fp", "n_lines", "at"]
    key, count, last, held, first_run = None, 0, None, [], True

    def close(edge: bool) -> list[tuple]:
        out = []
        if edge:
            out = [(2 if h[0] else 1, key, part, 0, *h[1:]) for h in held]
            out.append((3, key, part, count, None, None, None, None))
        elif keep_first:  # a run inside the partition that reaches min_docs has no held rows but its first document's
            out = [(0, None, None, None, *h[1:4], h[4][1:]) for h in held if count >= min_docs and len(h[4]) > 1]
        return out

    for pdf in batches:
        out = []
        for k, doc, fp, n, at in zip(pdf["key"], pdf["doc"], pdf["fp"], pdf["n_lines"], pdf["at"], strict=True):
            if k != key:
                if key is not None:
                    out += close(first_run)
                    first_run = False
                key, count, last, held = k, 0, None, []
            doc_key = None if pd.isna(doc) else doc
            first = count == 0
            if first or doc_key != last:
                count, last = count + 1, doc_key
            row = (first, doc, fp, n, list(at))
            if count < min_docs or (keep_first and (first or count == 1)):
                held.append(row)
                continue
            if held:
                keep = [h for h in held if keep_first and h[0]]
                out += [(0, None, None, None, *h[1:]) for h in held if h not in keep]
                held = keep
            out.append((0, None, None, None, doc, fp, n, list(at)))
        yield pd.DataFrame(out, columns=columns, dtype=object)  # objects: ids must not pass through floats
    if key is not None:
        yield pd.DataFrame(close(True), columns=columns, dtype=object)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        maps, dropped = [], []
        for n, at in zip(pdf.pop("n_lines"), pdf.pop("at"), strict=True):
            keep = np.ones(int(n), dtype=bool)
            keep[np.asarray(at, dtype=np.int64)] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
            dropped.append(int(len(keep) - keep.sum()))
        yield pdf.assign(n_dropped=dropped, keep_bitmap=maps)


def with_fingerprint(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("fp"), F.col(text).alias("text"))


def line_bitmaps(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, fp, n_dropped, keep_bitmap`` of each document that loses a line.

    A key in at least ``min_docs`` documents loses its lines: all of them, or with
    ``keep_first`` all but the first in order of document and position.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    scratch = C.Scratch(spark)
    keyed = with_fingerprint(docs, key, text)
    kind = dict(keyed.dtypes)["doc"]
    keyed = keyed.mapInPandas(lambda it: _keyed(it, min_chars), f"key binary, doc {kind}, fp long, n_lines int, at array<int>")
    keyed = scratch.table(keyed, "line-keys")
    ordered = keyed.repartitionByRange(C.range_partitions(keyed, 500_000), "key", "doc").sortWithinPartitions("key", "doc", "fp")
    rows = ordered.mapInPandas(
        lambda it: _streamed(it, min_docs, keep_first),
        f"state int, key binary, part int, n_docs long, doc {kind}, fp long, n_lines int, at array<int>",
    )
    rows = scratch.table(rows, "line-states")
    scratch.drop(keyed)
    # at most two edge keys for each of the range partitions
    totals = rows.where("state = 3").groupBy("key").agg(F.sum("n_docs").alias("total"), F.min("part").alias("first_part"))
    held = rows.where("state in (1, 2)").join(F.broadcast(totals), "key").where(F.col("total") >= min_docs)
    is_first = (F.col("state") == 2) & (F.col("part") == F.col("first_part")) & F.lit(keep_first)
    held = held.withColumn("at", F.when(is_first, F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0)))).otherwise(F.col("at"))).where(F.size("at") > 0)
    drops = rows.where("state = 0").select("doc", "fp", "n_lines", "at").union(held.select("doc", "fp", "n_lines", "at"))
    merged = drops.groupBy("doc", "fp").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("at")).alias("at"))
    return merged.mapInPandas(_packed, f"doc {kind}, fp long, n_dropped int, keep_bitmap binary")


def kept_lines(text: object, bitmap: bytes | None) -> tuple[int, str]:
    """Number of lines and the kept ones joined by newlines."""
    text = text if isinstance(text, str) else ""
    if bitmap is None:
        return text.count("\n") + 1, text
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines))
    return len(lines), "\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def join_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, str]:
    """Every row of ``docs`` with its bitmap and number of dropped lines (null if it loses none), and
    the names of these two columns.  The bitmaps are the hashed side."""
    doc, mark, dropped, bitmap = (C.fresh(docs, n) for n in ("_doc", "_fp", "_dropped", "_bitmap"))
    found = bitmaps.select(F.col("doc").alias(doc), F.col("fp").alias(mark), F.col("n_dropped").alias(dropped), F.col("keep_bitmap").alias(bitmap))
    fp = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    joined = docs.join(found.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(doc)) & (fp == F.col(mark)), "left")
    return joined.drop(doc, mark), bitmap, dropped


@F.pandas_udf(StringType())
def _kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    return pd.Series([t if b is None else kept_lines(t, b)[1] for t, b in zip(text, bitmap, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; all other columns unchanged."""
    joined, bitmap, dropped = join_bitmaps(docs, line_bitmaps(docs, key=key, text=text, **options), key, text)
    return joined.withColumn(text, _kept_text(F.col(text), F.col(bitmap))).select(*docs.columns)


def dedup_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: id, ``n_lines`` before, ``n_dropped`` and ``kept_sha256`` of the lines that stay."""
    bitmaps = line_bitmaps(docs, key=key, text=text, **options)
    joined, _, _ = join_bitmaps(docs.select(key, text), bitmaps, key, text)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [kept_lines(t, b) for t, b in zip(pdf.pop(text), pdf.pop("_bitmap"), strict=True)]
            dropped = pdf.pop("_dropped").fillna(0).astype("int64")
            yield pdf.assign(
                n_lines=[n for n, _ in kept], n_dropped=dropped,
                kept_sha256=[hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for _, x in kept],
            )

    kind = dict(docs.dtypes)[key]
    return joined.mapInPandas(digest, f"{key} {kind}, n_lines long, n_dropped long, kept_sha256 string")
