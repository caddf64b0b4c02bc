"""Streams: request logs, de-duplication across pages, per-day measures of late events.

Each function takes a streaming or a batch frame and gives the same rows for both once the input is closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_requests(log: DataFrame, key: str = "platform", at: str = "ts", n: int = 20) -> DataFrame:
    """The last ``n`` requests of every platform (batch; a stream calls it in foreachBatch on the merged table)."""
    order = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col("pos").desc())
    return log.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def without_repeats(items: DataFrame, keys: list[str], at: str, lateness: str = "1 day") -> DataFrame:
    """First arrival of every key; state older than ``lateness`` is dropped in a stream."""
    if items.isStreaming:
        return items.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)
    return items.dropDuplicates(keys)


def per_window(events: DataFrame, at: str = "ts", width: str = "1 day", lateness: str = "2 days", by: str = "event_type", value: str = "value") -> DataFrame:
    """(start, by, n, total) per tumbling window; late events count until the watermark passes their window."""
    used = events.withWatermark(at, lateness) if events.isStreaming else events
    return used.groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def request_health(log: DataFrame) -> DataFrame:
    """Error rate and last error of every platform."""
    failed = F.col("status_code") >= 400
    return log.groupBy("platform").agg(F.count("*").alias("requests"), F.avg(failed.cast("int")).alias("error_rate"), F.max_by(F.when(failed, F.col("status_code")), F.when(failed, F.col("ts"))).alias("last_error"))
