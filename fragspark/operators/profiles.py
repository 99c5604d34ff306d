"""Profiles around sites: midpoint counts, Savitzky-Golay smoothing, binning; protection scores and their peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import int_div, length_bin, midpoint
from . import coverage, intervals


def midpoint_profile(frags: DataFrame, sites: DataFrame, edges: list[int], weight: Column | None = None, group: str = "group_name", width: int = intervals.BIN) -> DataFrame:
    """(group, length_start, position, count): fragment midpoints by place within sites of one width.

    sites(chrom, start_pos, end_pos, group[, strand]); places of '-' sites run from their end.
    """
    stranded = sites if "strand" in sites.columns else sites.withColumn("strand", F.lit("+"))
    binned = frags.withColumn("length_start", length_bin(F.col("end_pos") - F.col("start_pos"), edges)).where("length_start is not null")
    w = F.lit(1.0) if weight is None else weight.cast("double")
    points = binned.withColumn("_w", w).withColumn("_m", midpoint("start_pos", "end_pos"))
    points = points.select("chrom", F.col("_m").alias("start_pos"), (F.col("_m") + 1).alias("end_pos"), "length_start", "_w")
    points = points.groupBy("chrom", "start_pos", "end_pos", "length_start").agg(F.sum("_w").alias("_w"))  # equal midpoints once
    right = intervals.renamed(stranded.select("chrom", "start_pos", "end_pos", group, F.col("strand").alias("_strand")))
    met = intervals.overlap_join(points, right, width=width)
    place = F.when(F.col("_strand") == "-", F.col("b_end") - 1 - F.col("start_pos")).otherwise(F.col("start_pos") - F.col("b_start"))
    return met.groupBy(group, "length_start", place.alias("position")).agg(F.sum("_w").alias("count"))


def savgol_coefficients(window: int) -> list[float]:
    """Savitzky-Golay weights of order 3 (and 2) for an odd window of at least 5, in closed form."""
    if window < 5 or window % 2 == 0:
        raise ValueError("the window must be odd and at least 5")
    m = window // 2
    scale = (2 * m + 1) * (4 * m * m + 4 * m - 3)
    return [3 * (3 * m * m + 3 * m - 1 - 5 * x * x) / scale for x in range(-m, m + 1)]


def savgol(profile: DataFrame, keys: list[str], window: int, value: str = "count") -> DataFrame:
    """Profiles smoothed over position; places that lack part of the window go (sites are widened by it first).

    Absent positions are zeros: sparse rows are spread to the places they add to, an equi-aggregate without windows.
    """
    m = window // 2
    kernel = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(c).alias("c")) for x, c in zip(range(-m, m + 1), savgol_coefficients(window))])
    spread = profile.withColumn("_k", F.explode(kernel)).withColumn("position", F.col("position") - F.col("_k.x"))
    return spread.groupBy(*keys, "position").agg(F.sum(F.col("_k.c") * F.col(value)).alias(value))


def binned_profile(profile: DataFrame, keys: list[str], size: int, length: int, value: str = "count") -> DataFrame:
    """Means of ``size`` adjacent positions of a profile of ``length``; the last bin goes by its own width."""
    bins = profile.groupBy(*keys, int_div("position", size).alias("bin")).agg(F.sum(value).alias("_sum"))
    width = F.least(F.lit(size), F.lit(length) - F.col("bin") * size)
    return bins.select(*keys, "bin", (F.col("_sum") / width).alias(value))


def protection_score(frags: DataFrame, window: int = 120, lengths: tuple[int, int] = (120, 180), weight: Column | None = None, tile: int = intervals.TILE) -> DataFrame:
    """Windowed protection score as segments: fragments that span the window minus ends inside it, at each centre.

    With left = window div 2 and right = window - left a fragment [s, e) protects [s + left, e - right] (inclusive) and its
    ends count against [s - right + 1, s + left) and [e - right + 1, e + left - 1), merged where they meet.
    """
    left = window // 2
    right = window - left
    size = F.col("end_pos") - F.col("start_pos")
    w = F.lit(1.0) if weight is None else weight
    s, e = F.col("start_pos"), F.col("end_pos")
    part = lambda a, b, sign: F.struct(a.alias("a"), b.alias("b"), (w * sign).alias("w"))
    parts = F.array(part(s + left, e - right + 1, F.lit(1.0)), part(s - right + 1, s + left, F.lit(-1.0)), part(e - right + 1, e + left - 1, F.lit(-1.0)))
    ranges = frags.where(size.between(*lengths)).select("chrom", F.explode(parts).alias("r")).select("chrom", F.greatest(F.lit(0), F.col("r.a")).alias("start_pos"), F.col("r.b").alias("end_pos"), F.col("r.w").alias("w"))
    return coverage.segments(ranges.where("start_pos < end_pos"), F.col("w"), tile, keep_zero=True).where("value <> 0")


# --- peaks: per base on short stretches, in numpy, one stretch of a tile with its halo at a time

SMOOTH_WINDOW, BASELINE, LEAST_BASELINE, LEAST_HEIGHT, LONGEST_GAP, RUN, BEST = 21, 1000, 400, 5.0, 5, (50, 450), (50, 150)


def _smoothed(x: np.ndarray, window: int = SMOOTH_WINDOW) -> np.ndarray:
    """Savitzky-Golay of order 2 with mirrored edges."""
    m = window // 2
    if len(x) < window:
        return x.copy()
    return np.convolve(np.concatenate([x[m:0:-1], x, x[-2 : -m - 2 : -1]]), savgol_coefficients(window), "valid")


def _normalized(x: np.ndarray) -> np.ndarray:
    """Values minus the median of the centred baseline window, to nine places, so that equal bases of a plateau are equal
    whatever the order of sums; NaN where too few bases are usable."""
    series = pd.Series(x)
    base = series.rolling(BASELINE + 1, center=True, min_periods=LEAST_BASELINE).median()
    return np.round((series - base).to_numpy(), 9)


def call_peaks(x: np.ndarray, start: int, least: float = LEAST_HEIGHT) -> list[tuple[int, int, int, float]]:
    """(start, end, peak position, height) of runs above zero, with short gaps filled.

    Runs of 50 to 450 bases count. Of a run, the stretches at or above its median are looked at: in a run of at most 150
    the stretch of the greatest sum is the peak, in a longer one each stretch of 50 to 150. Height must exceed ``least``.
    """
    above = np.nan_to_num(x, nan=-1.0) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], above.view(np.int8), [0]])))
    runs = [list(r) for r in edges.reshape(-1, 2)]
    joined: list[list[int]] = []
    for a, b in runs:
        if joined and a - joined[-1][1] <= LONGEST_GAP:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    out = []
    for a, b in joined:
        if not RUN[0] <= b - a <= RUN[1]:
            continue
        values = np.maximum(np.nan_to_num(x[a:b], nan=0.0), 0)
        high = values >= np.median(values)
        cuts = np.flatnonzero(np.diff(np.concatenate([[0], high.view(np.int8), [0]]))).reshape(-1, 2)
        if b - a <= BEST[1]:
            picks = [max(cuts.tolist(), key=lambda c: values[c[0] : c[1]].sum())]
        else:
            picks = [c for c in cuts.tolist() if BEST[0] <= c[1] - c[0] <= BEST[1]]
        for c, d in picks:
            top = int(np.argmax(values[c:d]))
            if values[c + top] > least:
                out.append((start + a + c, start + a + d, start + a + c + top, float(values[c + top])))
    return out


def peaks(score: DataFrame, tile: int = 1_000_000, least: float = LEAST_HEIGHT) -> DataFrame:
    """(chrom, start_pos, end_pos, peak_position, height) from protection score segments.

    Each tile is handled with a halo of its neighbours' bases on both sides that covers baseline, run and smoothing; a
    peak belongs to the tile that holds its highest base. Memory is that of one tile with its halo.
    """
    halo = BASELINE + RUN[1] + SMOOTH_WINDOW
    wide = score.withColumn("tile", F.explode(F.sequence(int_div(F.greatest(F.lit(0), F.col("start_pos") - halo), tile), int_div(F.col("end_pos") + halo, tile))))

    def run(key, pdf):
        chrom, number = key
        lo, hi = max(0, number * tile - halo), (number + 1) * tile + halo
        x = np.zeros(hi - lo)
        for a, b, v in zip(pdf.start_pos, pdf.end_pos, pdf.value):
            x[max(lo, a) - lo : max(0, min(hi, b) - lo)] += v
        found = call_peaks(_normalized(_smoothed(x)), lo, least)
        rows = [(chrom, a, b, p, h) for a, b, p, h in found if number * tile <= p < (number + 1) * tile]
        return pd.DataFrame(rows, columns=["chrom", "start_pos", "end_pos", "peak_position", "height"])

    return wide.groupBy("chrom", "tile").applyInPandas(run, "chrom string, start_pos long, end_pos long, peak_position long, height double")


def peak_stats(found: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Per window: peaks, and mean and median distance of neighbouring peaks in it."""
    points = found.select("chrom", F.col("peak_position").alias("start_pos"), (F.col("peak_position") + 1).alias("end_pos"))
    met = intervals.overlap_join(points, intervals.renamed(windows.select("chrom", "start_pos", "end_pos", *[k for k in keys if k != "chrom"])))
    from pyspark.sql import Window

    gap = F.col("start_pos") - F.lag("start_pos").over(Window.partitionBy(*keys).orderBy("start_pos"))
    return met.withColumn("gap", gap).groupBy(*keys).agg(F.count("*").alias("n_peaks"), F.avg("gap").alias("mean_distance"), F.percentile("gap", F.lit(0.5)).alias("median_distance"))
