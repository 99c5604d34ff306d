"""Additive aggregates of fragments in Structured Streaming: histograms that grow with arriving files.

Coverage events, length counts and motif counts are sums of rows, so they need no order: updates add up. State is
bounded by the number of keys (windows times bins), or by the watermark where keys carry an arrival window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import int_div, length_bin

FRAG_SCHEMA = "chrom string, start_pos long, end_pos long, mapq int, strand string, gc_weight double, arrived timestamp"


def fragments(spark: SparkSession, path: str, schema: str = FRAG_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet fragment files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def length_counts(stream: DataFrame, size: int, edges: list[int], weight: str | None = None) -> DataFrame:
    """(chrom, window_start, length_start, count) by the window of each fragment's first base; complete or update mode."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    binned = stream.withColumn("length_start", length_bin(F.col("end_pos") - F.col("start_pos"), edges)).where("length_start is not null")
    return binned.groupBy("chrom", (int_div("start_pos", size) * size).alias("window_start"), "length_start").agg(F.sum(w).alias("count"))


def coverage_events(stream: DataFrame) -> DataFrame:
    """(chrom, pos, delta): net coverage change at each position; a running sum over pos gives coverage."""
    ends = F.array(F.struct(F.col("start_pos").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end_pos").alias("pos"), F.lit(-1).alias("d")))
    return stream.select("chrom", F.explode(ends).alias("e")).groupBy("chrom", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("delta"))


def arrivals(stream: DataFrame, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Fragments and bases per chromosome and arrival window; windows close once the watermark has passed."""
    told = stream.withWatermark("arrived", late).groupBy(F.window("arrived", every), "chrom")
    return told.agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))
