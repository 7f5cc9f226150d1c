"""The daily panel as a stream: event time, watermark, tumbling days. An extension; the batch panel is the same aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_stream(events: DataFrame, time: str = "ts", group: str = "event_type", value: str = "value", late: str = "1 day") -> DataFrame:
    """group, day, n, y of closed days; events that come later than ``late`` are left out."""
    typed = events.withColumn("_t", F.col(time).cast("timestamp"))
    g = typed.withWatermark("_t", late).groupBy(F.window("_t", "1 day"), group).agg(F.count("*").alias("n"), F.sum(value).alias("y"))
    return g.select(group, F.to_date("window.start").alias("day"), "n", "y")


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Processes what is there and stops; Parquet and its checkpoint make each row appear once, also after a restart."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
