"""Order volume per day as an event-time stream, and per week or month with a calendar without gaps.

The stream counts days (of UTC, which the session should have as its time zone): a day is final, and written once, when the watermark has passed its end; records that come
later than the watermark allows are left out.  Weeks (from Monday) and months are sums of stored days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Truncation unit and step of each period.
PERIODS = {"day": ("day", "INTERVAL 1 DAY"), "week": ("week", "INTERVAL 7 DAYS"), "month": ("month", "INTERVAL 1 MONTH"), "quarter": ("quarter", "INTERVAL 3 MONTHS"), "year": ("year", "INTERVAL 1 YEAR")}


def daily_counts(rows: DataFrame, time: str, *groups: str, lateness: str = "7 days") -> DataFrame:
    """``day``, the groups and ``n``, of a stream or a table; for a stream, write it in append mode."""
    if rows.isStreaming:
        rows = rows.withWatermark(time, lateness)
    counted = rows.groupBy(F.window(time, "1 day"), *groups).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast("date").alias("day"), *groups, "n")


def volume_stream(rows: DataFrame, target: str, checkpoint: str, time: str, *groups: str, lateness: str = "7 days") -> StreamingQuery:
    """Append final days to the Parquet table ``target`` (exactly once: the sink logs its batches), then stop."""
    out = daily_counts(rows, time, *groups, lateness=lateness).writeStream.outputMode("append").format("parquet")
    return out.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def volume(days: DataFrame, every: str = "week", day: str = "day", n: str = "n") -> DataFrame:
    """``period`` (its first day) and ``n``: sums of daily counts, with 0 for periods between the first and the last
    that have none.  Rows without day are left out; without days there are no periods."""
    unit, step = PERIODS[every]
    start = F.date_trunc(unit, F.col(day)).cast("date")
    summed = days.where(F.col(day).isNotNull()).groupBy(start.alias("period")).agg(F.sum(n).alias("n"))
    calendar = days.agg(F.min(start).alias("a"), F.max(start).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(step))).alias("period"))
    return calendar.join(summed, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n"))


def dates(rows: DataFrame, date: str) -> DataFrame:
    """Daily counts of a table by a date column."""
    return rows.where(F.col(date).isNotNull()).groupBy(F.col(date).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
