"""Incremental loading as a stream.

A batch is normalised, records whose key the target already has are left out by an anti-join,
and the rest is appended.  The key and not the time decides, so late records do no harm and a
repeated batch adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.build import new_records
from ..operators.reports import counts


def append_new(target: str, key: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that appends the batch's new keys to the Parquet table ``target``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        known = batch.sparkSession.read.schema(rows.schema).parquet(target)
        new_records(rows, known, key).write.mode("append").parquet(target)

    return write


def incremental_stream(
    spark: SparkSession, source: str, target: str, schema: StructType | str, checkpoint: str, key: str = "case_number",
    source_format: str = "parquet", prepare: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1000, **options: str,
) -> StreamingQuery:
    """Load what has arrived in ``source`` into ``target`` (which must exist), then stop."""
    rows = spark.readStream.schema(schema).options(**options).option("maxFilesPerTrigger", files_per_batch).format(source_format).load(source)
    return rows.writeStream.foreachBatch(append_new(target, key, prepare)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streaming_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts per key of a stream; write it in complete mode."""
    return counts(rows, *keys)
