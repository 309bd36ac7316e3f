"""Event-time windows over a stream of readings, and running it to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """A stream of Parquet files; a zoneless ``ts`` becomes a timestamp, as watermarks need one."""
    return spark.readStream.schema(schema).options(**options).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, key: str, value: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, window_start, n, total, mean) of tumbling or sliding windows; what is later than ``late`` is dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(key, F.col("w.start").alias("window_start"), "n", "total", "mean")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first reading of each key; state is kept for ``late`` only."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is available into Parquet at ``path``. Whole results (``complete``) overwrite, others are appended."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    else:
        writer = writer.format("parquet").option("path", path)
    writer.start().awaitTermination()
