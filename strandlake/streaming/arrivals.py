"""Structured Streaming beside the batch operators: arriving variants joined with annotation, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotation import genes_in_intervals


def annotate_arrivals(variants: DataFrame, genes: DataFrame) -> DataFrame:
    """Stream of variants (variant_id, chrom, position) with the genes that hold them; a stream-static join."""
    points = variants.withColumns({"wstart": F.col("position") - 1, "wend": F.col("position")})
    return genes_in_intervals(genes, points)


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per key and tumbling window; rows later than ``late`` behind the watermark are left out, and state stays bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to Parquet until what is available now is processed."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
