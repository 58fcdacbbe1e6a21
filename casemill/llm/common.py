"""Shared helpers: scratch tables, code shipping, word splitting and fingerprints."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MEMO_LIMIT = 400_000
BATCH_BYTES = 64 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per SparkContext, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_casemill_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="casemill-"), "casemill_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._casemill_shipped = True


def prepare(spark: SparkSession, batch_rows: int = 500) -> None:
    """Ship the code and bound Arrow batches, by rows and by bytes: documents can be long."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; one of our own only in local mode and where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/casemill/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what runs inside as soon as it has ended, and not when the
    driver happens to collect its garbage; what was written does not need them any more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Intermediate tables of one operator run, written to the shared folder.

    ``table`` cuts the lineage by a written Parquet table, which survives the loss of
    executors; ``drop`` deletes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def table(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = scratch_path(self.spark, name)
        w = df.write.option("compression", "zstd")
        with shuffle_files_removed(self.spark):
            (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.paths.pop(id(t), None)
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def range_partitions(stored: DataFrame, rows_each: int) -> int:
    """The session's number of shuffle partitions, or more, so that one has about ``rows_each`` rows at most, whatever the table's size."""
    return max(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // rows_each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_broadcast(df: DataFrame, limit_rows: int) -> DataFrame:
    """Mark a stored table for broadcast if it has at most ``limit_rows`` rows; else leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(limit_rows + 1).count() <= limit_rows else df


# Words ---------------------------------------------------------------------------------

#: Maps A-Z to a-z and keeps all else.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Maps A-Z to a-z and every ASCII byte but digits and letters to a space.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def encoded(text: object) -> bytes:
    """UTF-8 bytes of a text; null (None or NaN) is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def white_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; ``bytes.split`` parts at exactly these six bytes."""
    return raw.split()


class _Memo(dict):
    """Word -> 64-bit fingerprint, computed once per word and worker; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_memo = _Memo()


def forget_words() -> None:
    """Free the fingerprints that this worker remembers."""
    _memo.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of every ``size`` consecutive word hashes; empty if there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = hashes[:n].copy()
    for j in range(1, size):
        h *= MULTIPLIER
        h += hashes[j : j + n]
    return mixed(h)


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct shingle fingerprints; a shorter text is one shingle, an empty one has none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(size, len(words))))


def digest128(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Boolean mask over ``n`` words of those inside windows of ``size`` words at ``starts``."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + size, n), -1)
    return np.cumsum(delta[:n]) > 0
