"""Extension: monitoring of predictions as they arrive, with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def drift_stream(rows: DataFrame, time: str, value: str, group: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, group, n, mean, std) by tumbling windows; rows later than ``late`` go. The
    same plan runs over a batch."""
    out = rows.withWatermark(time, late).groupBy(F.window(time, window), group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.select(F.col("window.start").alias("start"), group, "n", "mean", "std")


def start(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows; exactly once, by the checkpoint and the file sink's log."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
