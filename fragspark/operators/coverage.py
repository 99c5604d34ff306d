"""Fragment coverage: segments of constant value, and what windows make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio_or_nan, round_half_up
from . import intervals


def segments(frags: DataFrame, weight: Column | None = None, tile: int = intervals.TILE, keep_zero: bool = False) -> DataFrame:
    """(chrom, start_pos, end_pos, value): where coverage is constant, value > 0 unless ``keep_zero``.

    Fragments are cut at tile edges, so that the running sum of +weight / -weight events restarts in each
    tile and no task holds a chromosome. Values don't depend on the tile width; a segment may end at a tile's edge.
    """
    weighted = frags.withColumn("_w", F.lit(1.0) if weight is None else weight.cast("double"))
    cut = intervals.by_tile(weighted.select("chrom", "start_pos", "end_pos", "_w"), tile)
    events = cut.select("chrom", "tile", F.explode(F.array(F.struct(F.col("start_pos").alias("p"), F.col("_w").alias("d")), F.struct(F.col("end_pos").alias("p"), (-F.col("_w")).alias("d")))).alias("e"))
    steps = events.groupBy("chrom", "tile", F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("chrom", "tile").orderBy("p")
    value = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    # what is left of a sum of many weights near zero is rounding
    value = F.when(F.abs(value) < 1e-9, 0.0).otherwise(value)
    out = steps.select("chrom", F.col("p").alias("start_pos"), F.lead("p").over(w).alias("end_pos"), value.alias("value")).where("end_pos is not null")
    return out if keep_zero else out.where("value > 0")


def runs(covered: DataFrame, decimals: int = 2, keys: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """Segments with values rounded and equal touching neighbours joined, as a bedGraph has them."""
    rounded = covered.withColumn("value", round_half_up("value", decimals))
    return intervals.merge(rounded, [*keys, "value"]).select(*keys, "start_pos", "end_pos", "value")


def in_windows(covered: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Segments clipped to each window they meet: keys, start_pos, end_pos, value."""
    right = intervals.renamed(windows.select("chrom", "start_pos", "end_pos", *[k for k in keys if k != "chrom"]))
    met = intervals.overlap_join(covered, right)
    return met.select(*keys, F.greatest("start_pos", "b_start").alias("start_pos"), F.least("end_pos", "b_end").alias("end_pos"), "value")


def scaled(covered: DataFrame, bins: DataFrame) -> DataFrame:
    """Segments cut at the edges of bins(chrom, start_pos, end_pos, factor) and multiplied by their factors."""
    met = intervals.overlap_join(covered, intervals.renamed(bins.select("chrom", "start_pos", "end_pos", "factor")))
    return met.select("chrom", F.greatest("start_pos", "b_start").alias("start_pos"), F.least("end_pos", "b_end").alias("end_pos"), (F.col("value") * F.col("factor")).alias("value"))


def sums(covered: DataFrame, windows: DataFrame, keys: list[str], mask: DataFrame | None = None) -> DataFrame:
    """Per window, of all its bases that the mask leaves: span, blacklisted, eligible, nonzero, total, total_squared.

    ``keys`` tell windows apart; windows without coverage have zeros. Several windows of one key (a group) add
    up, overlapping ones repeatedly: merge them per group first where bases should count once. The mask is taken out of
    the windows, which are few, and never out of the segments.
    """
    own = windows.select("chrom", "start_pos", "end_pos", *[k for k in keys if k != "chrom"])
    left = own if mask is None else intervals.subtract(own, mask, [k for k in keys if k != "chrom"])
    met = intervals.with_overlap(intervals.overlap_join(covered.select("chrom", "start_pos", "end_pos", "value"), intervals.renamed(left)))
    size = F.col("overlap").cast("double")
    got = met.groupBy(*keys).agg(
        F.sum(F.col("value") * size).alias("total"), F.sum(F.col("value") * F.col("value") * size).alias("total_squared"), F.sum(F.when(F.col("value") > 0, F.col("overlap")).otherwise(0)).alias("nonzero")
    )
    bases = F.sum(F.col("end_pos") - F.col("start_pos"))
    span = own.groupBy(*keys).agg(bases.alias("span"))
    span = span.withColumn("eligible", F.col("span")) if mask is None else span.join(left.groupBy(*keys).agg(bases.alias("eligible")), keys, "left").fillna(0, ["eligible"])
    span = span.select(*keys, "span", (F.col("span") - F.col("eligible")).alias("blacklisted"), "eligible")
    return span.join(got, keys, "left").fillna(0, ["total", "total_squared", "nonzero"])


def summary(per_window: DataFrame) -> DataFrame:
    """Adds covered_fraction, average, variance (population, never negative), sd and cv; NaN where undefined."""
    mean = ratio_or_nan("total", "eligible")
    out = per_window.withColumn("covered_fraction", ratio_or_nan("nonzero", "eligible")).withColumn("average", mean)
    variance = ratio_or_nan("total_squared", "eligible") - mean * mean
    out = out.withColumn("variance", F.when(variance < 0, 0.0).otherwise(variance))
    out = out.withColumn("sd", F.sqrt("variance"))
    near_zero = F.abs(F.col("average")) <= 4.440892098500626e-16
    return out.withColumn("cv", F.when(near_zero, F.lit(float("nan"))).otherwise(F.col("sd") / F.when(near_zero, 1.0).otherwise(F.col("average"))))


def merged_groups(windows: DataFrame, group: str = "group_name") -> DataFrame:
    """Windows of each group merged, touching ones too, so that each of its bases counts once."""
    return intervals.merge(windows, ["chrom", group])


def unit_mass(size: Column) -> Column:
    """Weight under which every fragment adds 1 to total coverage."""
    return F.lit(1.0) / size
