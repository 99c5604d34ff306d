"""Weights: GC tags, scaling factors along the genome, triangular smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, ratio_or_nan
from ..storage import settled
from . import coverage, intervals, windows

#: Usable GC weights; outside of it and of zero they are invalid.
LEAST_GC, MOST_GC, TOLERANCE = 1e-3, 1e3, 4.440892098500626e-16


def gc_state(tag) -> Column:
    """'missing', 'zero', 'usable' or 'invalid' (NaN, negative, infinite, out of range)."""
    x = col(tag).cast("double")
    return (
        F.when(x.isNull(), "missing").when(F.isnan(x), "invalid").when(F.abs(x) <= TOLERANCE, "zero").when((x >= LEAST_GC) & (x <= MOST_GC), "usable").otherwise("invalid")
    )


def combined_gc(a, b) -> tuple[Column, Column]:
    """(state, weight) of a pair of mates: zero wins, then invalid; one missing leaves the other; else the mean."""
    a, b = col(a), col(b)
    sa, sb = gc_state(a), gc_state(b)
    either = lambda s: (sa == s) | (sb == s)
    state = F.when(either("zero"), "zero").when(either("invalid"), "invalid").when((sa == "missing") & (sb == "missing"), "missing").otherwise("usable")
    weight = F.when(either("zero"), 0.0).when(either("invalid"), F.lit(None)).when(sa == "missing", b).when(sb == "missing", a).otherwise((a + b) / 2)
    return state, weight


def smooth_triangular(bins: DataFrame, half: int, value: str = "value", support: str = "support") -> DataFrame:
    """bins(chrom, i, value, support) with ``smoothed``: the triangular mean over up to ``half`` neighbours a side.

    Weight half + 1 - distance, times the bin's support; bins without a finite value don't count; NaN where none does.
    """
    if half == 0:
        return bins.withColumn("smoothed", F.col(value))
    w = Window.partitionBy("chrom").orderBy("i").rangeBetween(-half, half)
    near = F.collect_list(F.struct(F.col("i"), F.col(value).alias("v"), F.col(support).alias("s"))).over(w)
    usable = F.filter(near, lambda x: ~F.isnan(x.v) & (x.s > 0))
    kernel = lambda x: (F.lit(half + 1) - F.abs(x.i - F.col("i"))) * x.s
    top = F.aggregate(usable, F.lit(0.0), lambda t, x: t + kernel(x) * x.v)
    bottom = F.aggregate(usable, F.lit(0.0), lambda t, x: t + kernel(x))
    return bins.withColumn("smoothed", ratio_or_nan(top, bottom))


def inverted(bins: DataFrame, value: str = "smoothed", support: str = "eligible") -> DataFrame:
    """bins with scaling_factor: the support-weighted mean of all usable bins over the bin's value; 0 if unusable."""
    ok = ~F.isnan(F.col(value)) & (F.col(value) > 0)
    total = bins.where(ok).agg((F.sum(F.col(value) * F.col(support)) / F.sum(support)).alias("_mean"))
    return bins.crossJoin(F.broadcast(total)).withColumn("scaling_factor", F.when(ok, F.col("_mean") / F.col(value)).otherwise(0.0)).drop("_mean")  # one row


def scaling_factors(frags: DataFrame, chroms: DataFrame, stride: int, width: int, mask: DataFrame | None = None, unit_mass: bool = False, weight: Column | None = None) -> DataFrame:
    """Factors per stride bin: coverage (or unit-mass fragment) averages, smoothed over ``width``, inverted."""
    size = F.col("end_pos") - F.col("start_pos")
    own = coverage.unit_mass(size) if unit_mass else F.lit(1.0)
    covered = coverage.segments(frags, own if weight is None else own * weight)
    bins = windows.fixed_size(chroms, stride)
    # the sums are small beside the fragments and are read twice, for the smoothing and for the mean
    told = settled(coverage.sums(covered, bins, ["chrom", "window_idx"], mask)).join(bins, ["chrom", "window_idx"])
    value = F.col("total") if unit_mass else ratio_or_nan("total", "eligible")
    told = told.withColumn("stride_value", F.when(F.col("eligible") > 0, value).otherwise(F.lit(float("nan"))))
    told = told.withColumn("support", F.col("eligible") / F.col("span").cast("double")).withColumn("i", F.col("window_idx"))
    smoothed = smooth_triangular(told, width // stride - 1, "stride_value")
    return inverted(smoothed).select("chrom", "start_pos", "end_pos", "window_idx", "eligible", "stride_value", "smoothed", "scaling_factor")


def average_factor(frags: DataFrame, bins: DataFrame, keys: list[str], start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """frags with ``factor``: the length-weighted mean of bins(chrom, start_pos, end_pos, factor) over [start, end).

    Equal spans are looked up once; every span must lie within bins.
    """
    spans = frags.select("chrom", F.col(start).alias("start_pos"), F.col(end).alias("end_pos")).distinct()
    met = intervals.with_overlap(intervals.overlap_join(spans, intervals.renamed(bins.select("chrom", "start_pos", "end_pos", F.col("factor").alias("_f")))))
    told = met.groupBy("chrom", "start_pos", "end_pos").agg((F.sum(F.col("overlap") * F.col("_f")) / F.sum("overlap")).alias("factor"))
    told = told.withColumnRenamed("start_pos", "_s").withColumnRenamed("end_pos", "_e").withColumnRenamed("chrom", "_c")
    return frags.join(told, (F.col("chrom") == F.col("_c")) & (F.col(start) == F.col("_s")) & (F.col(end) == F.col("_e"))).drop("_c", "_s", "_e")


def overlap_factor(assigned: DataFrame, bins: DataFrame) -> DataFrame:
    """Assigned fragments (with b_start, b_end) with ``factor``: the mean over the part that lies in their window.

    A fragment whose part is empty, as clips may make it, takes the bin of its nearest base in the window.
    """
    low, high = F.greatest("start_pos", "b_start"), F.least("end_pos", "b_end")
    first = F.least(low, F.col("b_end") - 1)
    told = assigned.withColumn("_from", F.when(low < high, low).otherwise(first)).withColumn("_to", F.when(low < high, high).otherwise(first + 1))
    return average_factor(told, bins, [], "_from", "_to").drop("_from", "_to")
