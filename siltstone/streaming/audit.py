"""The audit trail as a stream: fixed-window limits and daily counts. An extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import AUDIT


def client(forwarded: str = "forwarded_for", address: str = "address"):
    """The first hop a request names, else its address."""
    first = F.trim(F.split(F.col(forwarded), ",")[0])
    return F.when(first != "", first).otherwise(F.col(address))


def nearest_second(time: str):
    """The whole second nearest to a time, of two the even one, as SQL's cast of a fractional epoch gives it."""
    return F.rint(F.unix_micros(F.col(time).cast("timestamp")) / 1e6).cast("long")


def limited(events: DataFrame, key: str, time: str, limit: int, seconds: int = 60, tie: str | None = None, nearest: bool = False) -> DataFrame:
    """events with allowed: whether each is among the first `limit` of its key in its fixed window.

    nearest: the nearest whole second tells the window, not the second that a time lies in.
    """
    bucket = F.floor((nearest_second(time) if nearest else F.unix_timestamp(time)) / seconds)
    order = Window.partitionBy(key, bucket).orderBy(*([time, tie] if tie else [time]))
    return events.withColumn("allowed", F.row_number().over(order) <= limit)


def read_trail(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(AUDIT).json(path)


def requests(events: DataFrame, key: str, time: str, limit: int, late: str = "10 minutes", width: str = "1 minute", nearest: bool = False) -> DataFrame:
    """(window, key, n, rejected) of a stream or a batch: requests by fixed window, and how many were over the limit. nearest: see limited()."""
    if nearest:
        events = events.withColumn(time, F.timestamp_seconds(nearest_second(time)))
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("window", key, "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))


def daily(events: DataFrame, time: str = "timestamp", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), kind, "n")
