"""Steps on streams. Filters, projections and scalar functions of this package are stateless and work on a streaming
DataFrame as they are; counts by time window need a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_table(spark, path: str, schema, files: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(df: DataFrame, ts: str, by: str, value: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, by, n, total for each tumbling window; rows later than late are dropped."""
    c = F.col(ts).cast("timestamp")
    seen = df.withColumn(ts, c).withWatermark(ts, late)
    return seen.groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """All that is there now, in micro-batches."""
    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
