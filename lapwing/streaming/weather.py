"""Event-time weather means and wet fraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lapwing.operators.conditions import METRICS


def weather_windows(samples: DataFrame, width: str = "1 hour", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Tumbling windows over a stream (or a batch) of samples; a window is final once the watermark passes it."""
    wet = (F.coalesce(F.col("rainfall").cast("double"), F.lit(0.0)) > 0).cast("double")
    out = samples.withWatermark(time, delay).groupBy(F.window(time, width).alias("w")).agg(
        F.count(F.lit(1)).alias("samples"), *[F.avg(m).alias(m) for m in METRICS], F.avg(wet).alias("rain_fraction")
    )
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "samples", *METRICS, "rain_fraction")


def weather_stream(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes closed windows as they close, then stops when the input is used up."""
    return (
        windows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
