"""Tables that a job of several steps writes in a folder all executors share, and joins with hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, limit_rows: int = 10_000) -> DataFrame:
    """Marked for broadcast if it has at most ``limit_rows`` rows, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(limit_rows + 1).count() <= limit_rows else df


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what runs inside as soon as it has ended, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Stored:
    """Steps of one job, each a Parquet table under ``root``: lineage ends there, so a lost executor costs its tasks only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.paths: dict[int, str] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        with shuffle_files_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            path = self.paths.pop(id(t), None)
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, hot_rows: int = 100_000, how: str = "left") -> DataFrame:
    """Join stored ``rows`` with a ``lookup`` of one row per key.

    A key with more than ``hot_rows`` rows is dealt over as many parts as it has such multiples,
    and its lookup row is sent to each, so no task gets a key whole.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = hot.select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    hot = bounded_broadcast(hot)
    dealt = rows.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left")
    dealt = dealt.withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise((F.rand(7) * F.col("_parts")).cast("int"))).drop("_hot", "_parts")
    copies = lookup.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left")
    copies = copies.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")
    return dealt.join(copies, [key, "_part"], how).drop("_part")
