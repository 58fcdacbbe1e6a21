"""Incremental loading with keyed state: which keys the target has is held by the stream, not read from the target.

Each key has an entry in the state store (RocksDB, partitioned by key and checkpointed), that of Spark's streaming
``dropDuplicates``.  The first batch fills it from the keys that the target has; from then on a batch costs what its own
keys cost, however large the target has become.  Of a key's records in a batch the first in an order that must be total is
passed on: batches are reduced to it before they reach the state, in Arrow, where they lie and again by key.

The target is a Parquet table with one folder per batch.  A batch that is repeated after a failure gets the same
records from the restored state and replaces its own folder, so nothing is lost or added twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, MapType, StructType

BATCH = "load_batch"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Marks records to load (false: the key is known); prefix of columns that nested ones are ordered by.
NEW, BY = "_load_new", "_load_by_"
#: Rows that a task gathers before it reduces them.
GATHERED = 200_000


def _firsts(rows: pa.Table, key: str, order: Sequence[str]) -> pa.Table:
    """The first row of each key; nulls come last."""
    rows = rows.sort_by([(c, "ascending") for c in (key, *order)])
    keys = rows.column(key).combine_chunks()
    first = np.ones(len(keys), dtype=bool)
    first[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    return rows.filter(pa.array(first))


def first_of_each(batches: Iterator[pa.RecordBatch], key: str, order: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The first record of each key among those of a task, which holds one record a key and at most as many more."""
    held, waiting, size = [], [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= max(GATHERED, sum(b.num_rows for b in held)):
            held, waiting, size = _firsts(pa.Table.from_batches([*held, *waiting]), key, order).to_batches(), [], 0
    if held or waiting:
        yield from (_firsts(pa.Table.from_batches([*held, *waiting]), key, order) if waiting else pa.Table.from_batches(held)).to_batches(max_chunksize=10_000)


def known_keys(spark: SparkSession, checkpoint: str, known: DataFrame | None, key: str, kind: str) -> str:
    """Folder of the keys that the target has; it is written until the stream has been started, which then goes on from its state."""
    begun = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    if not begun.getFileSystem(spark._jsc.hadoopConfiguration()).exists(begun):
        keys = spark.createDataFrame([], f"`{key}` {kind}") if known is None else known.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias(key)).distinct()
        keys.write.mode("overwrite").parquet(f"{checkpoint}/known")
    return f"{checkpoint}/known"


def append_batch(target: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that writes a batch to its own folder of ``target``, replacing what an earlier try left there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")

    return write


def keyed_stream(
    spark: SparkSession, source: str, target: str, schema: StructType | str, checkpoint: str, known: DataFrame | None = None, key: str = "case_number",
    order: Sequence[str] = (), source_format: str = "parquet", prepare: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1000, **options: str,
) -> StreamingQuery:
    """Load what has arrived in ``source`` into ``target``, each key once, then stop.

    ``known``: records (of ``key`` at least) loaded before the stream was first started; their keys are stored beside its
    state when it starts for the first time and read in its first batch only.
    Records without key are not loaded.  ``order``: which of a key's records in a batch is taken (all other columns by default).
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    rows = spark.readStream.schema(schema).options(**options).option("maxFilesPerTrigger", files_per_batch).format(source_format).load(source)
    fields, columns = {f.name: f.dataType for f in rows.schema.fields}, rows.columns
    kind = fields[key].simpleString()
    before = spark.readStream.schema(f"`{key}` {kind}").parquet(known_keys(spark, checkpoint, known, key, kind))  # all in the first batch
    rows = rows.where(F.col(key).isNotNull()).withColumn(NEW, F.lit(True)).unionByName(before.withColumn(NEW, F.lit(False)), allowMissingColumns=True)
    nested = {c: f"{BY}{c}" for c in columns if isinstance(fields[c], (ArrayType, MapType, StructType))}
    rows = rows.withColumns({by: F.col(c).cast("string") for c, by in nested.items()}) if nested else rows
    rest = [NEW, *(nested.get(c, c) for c in list(order) or [c for c in columns if c != key])]
    reduce = lambda batches: first_of_each(batches, key, rest)
    firsts = rows.mapInArrow(reduce, rows.schema).repartition(F.col(key)).mapInArrow(reduce, rows.schema)
    out = firsts.dropDuplicates([key]).where(NEW).select(*columns).writeStream.outputMode("append").foreachBatch(append_batch(target, prepare))
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loaded(spark: SparkSession, target: str, schema: StructType | str) -> DataFrame:
    """What the stream has written so far."""
    return spark.read.schema(schema).option("basePath", target).parquet(f"{target}/{BATCH}=*")
