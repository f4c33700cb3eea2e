"""Event logs: replay from a cursor, latest ones, and windows with a watermark, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_event_time(events: DataFrame) -> DataFrame:
    """Event time as an instant (UTC), which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def replay(events: DataFrame, after: int) -> DataFrame:
    """Events beyond a cursor, oldest first."""
    return events.filter(F.col("event_id") > after).orderBy("event_id")


def latest(events: DataFrame, by: str, n: int) -> DataFrame:
    """The n latest events of each key."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("event_id")))
    return events.withColumn("nth", nth).filter(F.col("nth") <= n).drop("nth")


def daily(events: DataFrame) -> DataFrame:
    """day, event_type, n, total of each tumbling day; the same expression for a batch and a stream."""
    days = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return days.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream of events with event time."""
    return with_event_time(spark.readStream.schema(schema).parquet(path))


def stream_daily(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Daily windows of a stream; events later than ``late`` are dropped, and their state with them."""
    return daily(events.withWatermark("ts", late))


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes in all that is there and stops; a second run goes on where the first ended."""
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
