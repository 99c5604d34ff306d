"""Windows: fixed-size bins, interval files, groups; and the rules that assign fragments to them."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import int_div, midpoint, overlap_bp
from . import intervals


class Assigner(Enum):
    """When a fragment belongs to a window; proportions are of the fragment, never of the window."""

    ANY = "any"
    ALL = "all"
    MIDPOINT = "midpoint"
    PROPORTION = "proportion"
    COUNT_OVERLAP = "count-overlap"


def fixed_size(chroms: DataFrame, size: int) -> DataFrame:
    """Bins of each chromosome with a global row number in chromosome order: chrom, start_pos, end_pos, window_idx.

    chroms(chrom, chrom_len[, ord]); the last bin ends with its chromosome. Without ``ord`` chromosomes go by the number that
    their name ends in, then by name: chr2 before chr10, and those without a number last.
    """
    number = F.nullif(F.regexp_extract("chrom", r"(\d+)$", 1), F.lit("")).cast("long")
    natural = F.struct(number.isNull().alias("last"), number.alias("number"), F.col("chrom").alias("name"))
    ordered = chroms if "ord" in chroms.columns else chroms.withColumn("ord", natural)
    counted = ordered.withColumn("_n", int_div(F.col("chrom_len") + (size - 1), size))
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chromosome
    offset = counted.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bins = offset.where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return bins.select("chrom", (F.col("_i") * size).alias("start_pos"), F.least((F.col("_i") + 1) * size, "chrom_len").alias("end_pos"), (F.col("_offset") + F.col("_i")).alias("window_idx"))


def assign_fixed(frags: DataFrame, size: int, how: Assigner = Assigner.ANY, proportion: float = 0.5) -> DataFrame:
    """Fragments with window_start and overlap of each bin they are assigned to; no join is needed."""
    point = how is Assigner.MIDPOINT
    a, b = (midpoint("start_pos", "end_pos"), midpoint("start_pos", "end_pos") + 1) if point else (F.col("start_pos"), F.col("end_pos"))
    out = frags.withColumn("_a", a).withColumn("_b", b)
    out = out.withColumn("_i", F.explode(F.sequence(int_div("_a", size), int_div(F.col("_b") - 1, size))))
    out = out.withColumn("window_start", F.col("_i") * size).withColumn("overlap", overlap_bp("_a", "_b", F.col("_i") * size, (F.col("_i") + 1) * size))
    return out.where(_enough(how, proportion, F.col("_b") - F.col("_a"))).drop("_a", "_b", "_i")


def _enough(how: Assigner, proportion: float, size: Column) -> Column:
    if how is Assigner.ALL:
        return F.col("overlap") == size
    if how is Assigner.PROPORTION:
        return F.col("overlap") >= F.lit(float(proportion)) * size
    return F.col("overlap") > 0


def assign(frags: DataFrame, windows: DataFrame, how: Assigner = Assigner.ANY, proportion: float = 0.5, width: int = intervals.BIN) -> DataFrame:
    """Fragments joined with windows(chrom, start_pos, end_pos, ...) by the rule; adds overlap.

    The windows' bounds come back as b_start, b_end. For midpoints start_pos and end_pos stay those of the fragment.
    """
    right = intervals.renamed(windows)
    if how is Assigner.MIDPOINT:
        moved = frags.withColumn("_s", F.col("start_pos")).withColumn("_e", F.col("end_pos")).withColumn("start_pos", midpoint("_s", "_e")).withColumn("end_pos", F.col("start_pos") + 1)
        joined = intervals.with_overlap(intervals.overlap_join(moved, right, width=width))
        return joined.withColumn("start_pos", F.col("_s")).withColumn("end_pos", F.col("_e")).drop("_s", "_e")
    joined = intervals.with_overlap(intervals.overlap_join(frags, right, width=width))
    return joined.where(_enough(how, proportion, F.col("end_pos") - F.col("start_pos")))


def covered_bp(windows: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """windows with ``covered``: bases of each window under the merged mask. ``keys`` tell windows apart."""
    hit = intervals.with_overlap(intervals.overlap_join(windows.select("chrom", "start_pos", "end_pos", *keys), intervals.renamed(intervals.merge(mask))))
    sums = hit.groupBy(*keys).agg(F.sum("overlap").alias("covered"))
    return windows.join(sums, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
