"""Streams that run over files written from the given tables, and what they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import keyed, volume
from .bindings import CASES_SQL, Tables
from .queries import query


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 4 <> 0")
def keyed_stream_load(t: Tables) -> DataFrame:
    """Events as a stream of several batches, each event twice, against a known quarter held as keyed state."""
    at = t.folder("keyed")
    rows = t.raw("events").select("event_id", "user_id", "event_type")
    rows.unionAll(rows).repartition(6, "user_id").write.parquet(f"{at}/incoming")
    known = rows.where("event_id % 4 = 0")
    stream = keyed.keyed_stream(t.spark, f"{at}/incoming", f"{at}/target", rows.schema, f"{at}/checkpoint", known, "event_id", files_per_batch=3)
    stream.awaitTermination()
    return keyed.loaded(t.spark, f"{at}/target", rows.schema).select("event_id", "user_id", "event_type")


_LATE = "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAYS FROM events)"


@query(f"SELECT CAST(day AS DATE) AS day, n FROM ({_LATE})")
def event_volume_stream(t: Tables) -> DataFrame:
    """Days of events that a watermark of two days has closed."""
    at = t.folder("volume")
    rows = t.raw("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{at}/incoming")
    source = t.spark.readStream.schema(rows.schema).parquet(f"{at}/incoming")
    volume.volume_stream(source, f"{at}/days", f"{at}/checkpoint", "ts", lateness="2 days").awaitTermination()
    return t.spark.read.parquet(f"{at}/days").groupBy("day").agg(F.sum("n").alias("n"))


def _calendar(unit: str, step: str) -> str:
    return f"""+ p AS (SELECT CAST(date_trunc('{unit}', date_issued) AS DATE) AS period, count(*) AS n FROM cases WHERE status = 'P' AND month(date_issued) <> 7 GROUP BY 1)
    SELECT CAST(c.period AS DATE) AS period, CAST(coalesce(p.n, 0) AS BIGINT) AS n
    FROM (SELECT unnest(generate_series((SELECT CAST(min(period) AS TIMESTAMP) FROM p), (SELECT CAST(max(period) AS TIMESTAMP) FROM p), INTERVAL {step})) AS period) c LEFT JOIN p ON p.period = c.period"""


def _pending(t: Tables) -> DataFrame:
    return volume.dates(t.cases.where("status = 'P' AND month(date_issued) <> 7"), "date_issued")


@query(_calendar("week", "7 DAYS"), CASES_SQL)
def orders_per_week(t: Tables) -> DataFrame:
    """Orders of one status, none of them from a July; those weeks have 0."""
    return volume.volume(_pending(t), "week")


@query(_calendar("month", "1 MONTH"), CASES_SQL)
def orders_per_month(t: Tables) -> DataFrame:
    return volume.volume(_pending(t), "month")
