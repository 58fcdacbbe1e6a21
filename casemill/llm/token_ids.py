"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding.

Format.  Ids are replaced by their rank of frequency over all documents (rank 0 is the most
frequent; ties go to the smaller id).  A rank takes 1, 2, 3 or 4 bytes, little-endian.  The
lengths (less one) are 2-bit codes, four to a control byte, lowest bits first; control bytes
and data bytes are separate streams, as in Stream VByte.  Decoding looks the lengths of four
ranks up in a 256-row numpy table by control byte and gathers the data bytes with them.

A stored file set has three tables: ``tokens`` (one row per document in ascending order of
id: shard, place in the shard, ids before it in the shard, number of ids, control and data
bytes), ``shards`` (ids of all shards before) and ``ranks`` (id of each rank).  A shard is one
range of ids and is written as one file; Parquet is the container, so that tasks that
are repeated leave no trace.

Defined cases: null and empty texts have only the end id.  Rows that repeat an id follow each
other, ordered by text; rows without id come first.  Very long texts are one document.  Equally
frequent ids: the smaller one first.  An empty table gives empty tables.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C
from .tokens import tokenizer

#: Byte lengths of the four ranks of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])[None, :] & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    n = len(ranks)
    r = ranks.astype("<u4")
    codes = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros((n + 3) // 4 * 4, dtype=np.uint8)
    padded[:n] = codes
    q = padded.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    each = r.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), each[np.arange(4)[None, :] <= codes[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    at = np.cumsum(sizes) - sizes
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(sizes > k)
        if not len(longer):
            break
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenized(docs: DataFrame, path: str, space_leads: bool, key: str, text: str) -> DataFrame:
    """``doc, mark, ids``: the ids of every text as little-endian bytes, without an end id."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, space_leads)
        for batch in batches:
            ids = [t.ids(x or "").tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(ids, pa.binary())], names=["doc", "mark", "ids"])

    return rows.mapInArrow(encode, f"doc {kind}, mark long, ids binary")


class TokenFiles:
    """The stored tables, and what reads them back."""

    def __init__(self, tokens: DataFrame, shards: DataFrame, ranks: DataFrame, vocabulary: int):
        self.tokens, self.shards, self.ranks, self.vocabulary = tokens, shards, ranks, vocabulary

    def digest(self, key: str) -> DataFrame:
        """Decode every document: ``start``, ``n_tokens`` and ``ids_crc32``."""
        spark = self.tokens.sparkSession
        table = np.zeros(self.vocabulary, dtype=np.uint32)
        for r in self.ranks.toLocalIterator():  # as many rows as the vocabulary has ids
            table[r["rank"]] = r["id"]
        sent = spark.sparkContext.broadcast(table)

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids_of = sent.value
            for pdf in batches:
                crc = [
                    zlib.crc32(ids_of[decode_ranks(c, d, n)].astype("<u4").tobytes())
                    for c, d, n in zip(pdf.pop("control"), pdf.pop("data"), pdf["n_tokens"], strict=True)
                ]
                yield pdf.assign(ids_crc32=crc)

        kind = dict(self.tokens.dtypes)["doc"]
        rows = self.tokens.select("shard", "doc", "before", "n_tokens", "control", "data")
        rows = rows.mapInPandas(read, f"shard int, doc {kind}, before long, n_tokens long, ids_crc32 long")
        rows = rows.join(F.broadcast(self.shards), "shard")  # one row per shard
        return rows.select(F.col("doc").alias(key), (F.col("before") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def write_token_files(docs: DataFrame, path: str, space_leads: bool = False, end_id: int = 1, key: str = "doc_id", text: str = "text", scratch: C.Scratch | None = None) -> TokenFiles:
    """Encode every whole text and store it in the file format, in ascending order of id."""
    spark = docs.sparkSession
    C.prepare(spark)
    scratch = scratch or C.Scratch(spark)
    raw = scratch.table(tokenized(docs, path, space_leads, key, text), "token-ids")
    t = tokenizer(path, space_leads)
    size, kind_of = max(t.tokenizer.get_vocab_size(), end_id + 1), t.dtype

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(ids, dtype=kind_of), minlength=size) if len(ids) > 1 << 16 else 0
            small = b"".join(x for x in batch.column("ids").to_pylist() if len(x) <= 1 << 16)
            total += np.bincount(np.frombuffer(small, dtype=kind_of), minlength=size)
            total[end_id] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    counts = raw.select("ids").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # the vocabulary bounds these rows, so one task may rank them
    ranks = scratch.table(counts.select((F.row_number().over(W.orderBy(F.desc("n"), "id")) - 1).cast("int").alias("rank"), "id", "n"), "token-ranks")
    rank_of = np.zeros(size, dtype=np.uint32)
    for r in ranks.toLocalIterator():
        rank_of[r["id"]] = r["rank"]
    sent = spark.sparkContext.broadcast(rank_of)

    ordered = raw.repartitionByRange(C.range_partitions(raw, 20_000), "doc", "mark").sortWithinPartitions("doc", "mark")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, place = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n, befores, control, data = [], [], [], []
            for ids in batch.column("ids").to_pylist():
                ranked = sent.value[np.append(np.frombuffer(ids, dtype=kind_of), np.array(end_id, dtype=kind_of))]
                c, d = encode_ranks(ranked)
                n.append(len(ranked))
                befores.append(before)
                before += len(ranked)
                control.append(c)
                data.append(d)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(n), pa.int32()), pa.array(range(place, place + len(n)), pa.int64()), batch.column("doc"),
                    pa.array(befores, pa.int64()), pa.array(n, pa.int64()), pa.array(control, pa.binary()), pa.array(data, pa.binary()),
                ],
                names=["shard", "place", "doc", "before", "n_tokens", "control", "data"],
            )
            place += len(n)

    kind = dict(raw.dtypes)["doc"]
    tokens = ordered.mapInArrow(coded, f"shard int, place long, doc {kind}, before long, n_tokens long, control binary, data binary")
    tokens = scratch.table(tokens, "token-files")
    scratch.drop(raw)
    totals = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    shards = scratch.table(totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "token-shards")
    return TokenFiles(tokens, shards, ranks, size)


def token_digest(docs: DataFrame, path: str, space_leads: bool = False, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files, read them back: per row of ``docs`` the id, ``start``, ``n_tokens`` and ``ids_crc32``."""
    return write_token_files(docs, path, space_leads, end_id, key, text).digest(key)
