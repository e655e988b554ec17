"""Heart rates over a stream of beats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(beats: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Beats a page and time window, and their mean value; beats later than `late` are dropped by the watermark. For batches as for streams."""
    b = beats.withWatermark(ts, late) if beats.isStreaming else beats
    return b.groupBy("page", F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("page", F.col("w.start").alias("start"), "n", "total")
