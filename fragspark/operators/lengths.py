"""Length histograms: keyed, weighted counts of fragment lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import length_bin, steady_sum


def counts(assigned: DataFrame, keys: list[str], edges: list[int], weight: Column | None = None, size: Column | None = None) -> DataFrame:
    """(keys, length_start, count) in long form; rows outside all bins go, near-zero sums too."""
    size = F.col("end_pos") - F.col("start_pos") if size is None else size
    binned = assigned.withColumn("length_start", length_bin(size, edges)).where("length_start is not null")
    total = F.sum(F.lit(1.0)) if weight is None else steady_sum(weight)
    return binned.groupBy(*keys, "length_start").agg(total.alias("count")).where(F.abs(F.col("count")) > 1e-12)


def count_overlap_weight() -> Column:
    """Share of the fragment that lies in the window."""
    return F.col("overlap") / (F.col("end_pos") - F.col("start_pos")).cast("double")


def wide(long: DataFrame, keys: list[str], edges: list[int]) -> DataFrame:
    """One row per key with a zero-filled column for each bin, named as the TSV writer names them."""
    name = lambda a, b: f"count_{a}" if b == a + 1 else f"count_{a}_{b}"
    bins = list(zip(edges, edges[1:]))
    cells = [F.coalesce(F.sum(F.when(F.col("length_start") == a, F.col("count"))), F.lit(0.0)).alias(name(a, b)) for a, b in bins]
    return long.groupBy(*keys).agg(*cells) if keys else long.agg(*cells)


def short_long_ratio(long: DataFrame, keys: list[str], short: tuple[int, int], longer: tuple[int, int]) -> DataFrame:
    """(keys, short, long, ratio) of counts whose bins begin in two half-open ranges; NaN without long ones."""
    part = lambda r: F.sum(F.when((F.col("length_start") >= r[0]) & (F.col("length_start") < r[1]), F.col("count")).otherwise(0.0))
    out = long.groupBy(*keys).agg(part(short).alias("short"), part(longer).alias("long"))
    return out.withColumn("ratio", F.when(F.col("long") == 0, F.lit(float("nan"))).otherwise(F.col("short") / F.when(F.col("long") == 0, 1.0).otherwise(F.col("long"))))
